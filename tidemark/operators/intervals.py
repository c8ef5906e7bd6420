"""Closed ranges: overlap join and union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(a: DataFrame, b: DataFrame, low: str = "lo", high: str = "hi") -> DataFrame:
    """All pairs of rows whose closed integer ranges overlap, as struct columns a and b.

    A range's level is the least power of two that its length fits; at its level or above it touches two cells at most. Pairs
    meet in an equi-join at the higher of their levels, in the first cell that both touch, so no pair comes twice and no
    range is spread over many cells. Ranges with a null end or with low > high overlap nothing.
    """

    def leveled(df: DataFrame, name: str) -> DataFrame:
        lo, hi = F.col(low).cast("long"), F.col(high).cast("long")
        ok = df.where(lo.isNotNull() & hi.isNotNull() & (lo <= hi))
        return ok.select(F.struct(*[F.col(c) for c in df.columns]).alias(name), lo.alias(f"{name}_lo"), hi.alias(f"{name}_hi"), F.ceil(F.log2((hi - lo + 1).cast("double"))).cast("int").alias(f"{name}_level"))

    x, y = leveled(a, "a"), leveled(b, "b")
    # at most 64 levels exist; each side goes to its own and to those above that the other side has
    xs, ys = (sorted(r[0] for r in d.select(c).distinct().collect()) for d, c in ((x, "a_level"), (y, "b_level")))
    levels = sorted({*xs, *ys})

    def celled(df: DataFrame, name: str, other: list[int]) -> DataFrame:
        wanted = F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")
        others = F.array(*[F.lit(v) for v in other]) if other else F.array().cast("array<int>")
        own = F.col(f"{name}_level")
        at = df.withColumn("level", F.explode(F.filter(wanted, lambda v: (v == own) | ((v > own) & F.array_contains(others, v)))))
        first, last = (F.expr(f"shiftright({name}_{e}, level)") for e in ("lo", "hi"))
        return at.withColumn("cell", F.explode(F.sequence(first, last)))

    j = celled(x, "a", ys).join(celled(y, "b", xs), ["level", "cell"])
    here = F.greatest(F.expr("shiftright(a_lo, level)"), F.expr("shiftright(b_lo, level)"))
    return j.where((F.col("level") == F.greatest("a_level", "b_level")) & (F.col("cell") == here) & (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))).select("a", "b")


def merge_ranges(df: DataFrame, low: str = "lo", high: str = "hi", by: list[str] | None = None) -> DataFrame:
    """The range from the least low to the greatest high, of all rows or for each group."""
    return df.groupBy(*(by or [])).agg(F.min(low).alias(low), F.max(high).alias(high))
