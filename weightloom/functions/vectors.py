"""Weight vectors held as ``ARRAY<DOUBLE>`` in universe order.

All expressions work inside one row, so a table of vectors needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weightloom.functions.scalars import finite


def bind(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once.

    A column referenced inside a lambda is inlined by the optimizer and would be
    recomputed for every element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def scale_to_one(v: Column) -> Column:
    return bind(v, lambda w: bind(total(w), lambda s: F.transform(w, lambda x: F.try_divide(x, s))))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def herfindahl(v: Column) -> Column:
    return total(F.transform(v, lambda x: x * x))


def entropy(v: Column) -> Column:
    return -total(F.transform(v, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def equal_like(v: Column) -> Column:
    return F.array_repeat(F.lit(1.0) / F.size(v), F.size(v))


def first_argmax(v: Column) -> Column:
    """1-based position of the first maximum (ties go to the lower order)."""
    return F.array_position(v, F.array_max(v)).cast("int")


def first_argmin(v: Column) -> Column:
    return F.array_position(v, F.array_min(v)).cast("int")


def top_k(v: Column, k: int) -> Column:
    """Positions of the k largest entries, ties to the lower position."""
    ranked = F.array_sort(
        F.transform(v, lambda x, i: F.struct((-x).alias("s"), (i + 1).alias("i")))
    )
    return F.transform(F.slice(ranked, 1, k), lambda e: e["i"])


def topk_overlap(a: Column, b: Column, k: int = 3) -> Column:
    """Shared members of the two top-k sets over k, even if fewer assets exist."""
    return F.size(F.array_intersect(top_k(a, k), top_k(b, k))) / F.lit(float(max(k, 1)))


def project_capped(v: Column, cap: Column | float) -> Column:
    """Euclidean projection on {sum w = 1, 0 <= w <= cap}.

    g(u) = sum clip(v + u, 0, cap) is piecewise linear with kinks at -v and
    cap - v.  One pass over the sorted kinks finds the segment where g reaches 1.
    An infeasible cap (cap * n < 1) gives equal weights.
    """
    cap = F.lit(cap).cast("double") if not isinstance(cap, Column) else cap.cast("double")

    def kinks(a):
        return F.sort_array(
            F.concat(
                F.transform(a, lambda x: F.struct((-x).alias("u"), F.lit(1.0).alias("s"))),
                F.transform(a, lambda x: F.struct((cap - x).alias("u"), F.lit(-1.0).alias("s"))),
            )
        )

    def step(acc, k):
        reached = acc["g"] + acc["slope"] * (k["u"] - acc["at"])
        return (
            F.when(acc["hit"].isNotNull(), acc)
            .when(
                (acc["slope"] > 0) & (reached >= 1.0),
                F.struct(
                    acc["g"].alias("g"),
                    acc["slope"].alias("slope"),
                    acc["at"].alias("at"),
                    (acc["at"] + F.try_divide(F.lit(1.0) - acc["g"], acc["slope"])).alias("hit"),
                ),
            )
            .otherwise(
                F.struct(
                    reached.alias("g"),
                    (acc["slope"] + k["s"]).alias("slope"),
                    k["u"].alias("at"),
                    F.lit(None).cast("double").alias("hit"),
                )
            )
        )

    def shift(ks):
        start = F.struct(
            F.lit(0.0).alias("g"),
            F.lit(0.0).alias("slope"),
            ks[0]["u"].alias("at"),
            F.lit(None).cast("double").alias("hit"),
        )
        return F.aggregate(ks, start, step, lambda acc: F.coalesce(acc["hit"], acc["at"]))

    def clipped(a):
        return bind(bind(kinks(a), shift), lambda u: F.transform(a, lambda x: F.least(F.greatest(x + u, F.lit(0.0)), cap)))

    finite_or_0 = lambda x: F.coalesce(finite(x), F.lit(0.0))
    solved = lambda w: F.when(cap * F.size(w) < 1.0 - 1e-12, equal_like(w)).otherwise(scale_to_one(bind(F.transform(w, finite_or_0), clipped)))
    return bind(v, solved)


def from_map(weights: Column, universe: Column) -> Column:
    """Map ticker -> weight as a vector in universe order, missing entries 0."""
    return F.transform(universe, lambda a: F.coalesce(weights[a], F.lit(0.0)))


def to_map(universe: Column, v: Column) -> Column:
    return F.map_from_arrays(universe, v)
