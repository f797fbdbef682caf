"""Reproducible pseudo-random draws as column expressions.

A draw is 32 bits of an MD5 digest of its coordinates, so the same value is
obtained on any executor, after any retry, and by any other SQL engine.  One
digest carries four draws.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = 4
SPAN = 4294967296  # 2**32


def digest(*parts) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def lane(hex_digest: Column, k: int | Column) -> Column:
    """k-th (0..3) unsigned 32-bit draw of a digest."""
    start = (k * 8 + 1) if isinstance(k, int) else (k * 8 + 1).cast("int")
    part = hex_digest.substr(F.lit(start) if isinstance(start, int) else start, F.lit(8))
    return F.conv(part, 16, 10).cast("bigint")


def uniform(hex_digest: Column, k: int = 0) -> Column:
    return lane(hex_digest, k).cast("double") / float(SPAN)


def shuffle_rank_key(seed, item) -> Column:
    """Sort key whose order is a seeded permutation of the items."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), item.cast("string")))
