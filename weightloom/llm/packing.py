"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest capacity give whole sequences of that length; what
is left is packed in shards of bounded size. A shard goes through its pieces from long
to short: each enters the open bin with the least room that holds it; if none does, the
capacity of least cost for each token it is going to hold is opened. In the end every
bin shrinks to the smallest capacity that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weightloom.llm.common import bounded_batches, column_bytes, slices
from weightloom.session import materialize

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence of c tokens: c * (1 + c / ATTENTION) + OVERHEAD.
ATTENTION = 16_384
OVERHEAD = 64
#: Pieces packed together.
SHARD = 50_000
PACKED = "doc_id {0}, piece int, start long, length int, bin string, capacity int, offset int"


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / ATTENTION) + OVERHEAD


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the capacity of each bin. Lengths are 1 to the largest capacity.

    Equal lengths keep their order; of bins with equal room the last one opened is taken.
    """
    capacities = tuple(sorted(capacities))
    price = [cost(c) for c in capacities]
    where, offset, size, used = [0] * len(lengths), [0] * len(lengths), [], []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted, only those that some bin has
    rest = sum(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        rest -= need
        at = bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            k = min(range(bisect_left(capacities, need), len(capacities)), key=lambda k: price[k] / min(capacities[k], need + rest))
            b, room = len(size), capacities[k]
            size.append(room)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += need
        if room := room - need:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return where, offset, [capacities[bisect_left(capacities, u)] for u in used]


def lengths(docs: DataFrame) -> DataFrame:
    """doc_id and ``length``: words ``[^\\x20\\x09-\\x0D]+`` of the text and one end of document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.split()) + 1 for t in column_bytes(part, "text")], pa.int64())], ["doc_id", "length"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, length long")


def pack_lengths(sized: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """Packs rows (doc_id, length): one row per piece with its bin, the bin's final capacity and its offset there.

    Rows are dealt over shards by their place in the written table, so neither a repeated id
    nor a common length makes a shard large. A null or non-positive length takes no room and
    gives no row; null and repeated ids are packed row by row; an empty table gives an empty table.
    """
    largest = max(capacities)
    table = materialize(sized.select("doc_id", F.col("length").cast("long").alias("length")).filter("length > 0").withColumn("uid", F.monotonically_increasing_id()), "lengths")
    full = F.expr(f"length DIV {largest}")
    kind = table.schema["doc_id"].dataType.simpleString()
    whole = table.filter(full > 0).select("doc_id", "uid", F.explode(F.sequence(F.lit(1), full.cast("int"))).alias("k")).select(
        "doc_id", (F.col("k") - 1).alias("piece"), (F.lit(largest).cast("long") * (F.col("k") - 1)).alias("start"), F.lit(largest).alias("length"),
        F.concat_ws("-", F.lit("whole"), F.col("uid").cast("string"), F.col("k").cast("string")).alias("bin"), F.lit(largest).alias("capacity"), F.lit(0).alias("offset"),
    )
    rest = table.select("doc_id", "uid", full.cast("int").alias("piece"), (full * largest).alias("start"), (F.col("length") % largest).cast("int").alias("length")).filter("length > 0")
    shards = max(1, -(-table.count() // shard))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid")
        n = t["length"].to_pylist()
        where, offset, size = pack(n, capacities)
        name = t["shard"][0].as_py()
        return pa.table({
            "doc_id": t["doc_id"], "piece": t["piece"], "start": t["start"], "length": t["length"], "bin": pa.array([f"{name}-{b}" for b in where], pa.string()),
            "capacity": pa.array([size[b] for b in where], pa.int32()), "offset": pa.array(offset, pa.int32()),
        })

    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(run, PACKED.format(kind))
    return packed.union(whole.select(packed.columns))


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """Packs whole texts by their number of words and an end each; a null text is one end."""
    return pack_lengths(lengths(docs), capacities)
