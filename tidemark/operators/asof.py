"""As-of search in batch: for each probe the greatest key at or below it, or the least at or above it.

Probes and keys are dealt to ranges; within a range a window carries the last key forward, and a range without an earlier
key takes the best of the ranges before it, which is one value for each range. The bounds of the ranges come from a bounded
sample of both and decide balance only, never results. Equal probes are searched once.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are looked at for the bounds of each range.
SAMPLE = 64
#: Distinct keys and probes for each range, about, where the session's partitions would get more.
ROWS = 1 << 20


def range_bounds(keys: DataFrame, key: str, ranges: int, rows: int | None = None) -> list:
    """Up to ranges - 1 ascending bounds that cut the distinct keys about evenly; more where ranges would have more than `rows` keys. SAMPLE
    keys for each range, chosen by a hash, reach the driver at most, however often a key repeats."""
    k, by = keys.select(F.col(key).alias("k")).where("k is not null"), F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    n = k.agg(F.approx_count_distinct("k")).head()[0]
    ranges = max(ranges, n // rows) if rows else ranges
    want = SAMPLE * ranges
    some = k if n <= want else k.where(by < int((1 << 30) * want / n))
    found = sorted(r[0] for r in some.distinct().orderBy(by, "k").limit(want).collect())
    return list(dict.fromkeys(found[i * len(found) // ranges] for i in range(1, ranges) if found))


def range_of(bounds: list, col: Column, kind) -> Column:
    """Number of bounds at or below a value, by bisection over a literal array."""
    if not bounds:
        return F.lit(0)
    array, n = F.array(*[F.lit(b).cast(kind) for b in bounds]), len(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

    def step(at: Column, by: Column) -> Column:
        further = (at + by <= n) & (F.get(array, F.least(at + by, F.lit(n)) - 1) <= col)
        return F.when(further, at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def asof(probes: DataFrame, keys: DataFrame, probe: str = "q", key: str = "key", direction: str = "backward", ranges: int | None = None, bounds: list | None = None) -> DataFrame:
    """All rows of probes with one more column, `found`: the key, null if there is none (or the probe is null). A column of that name
    that probes has is replaced; others may have any names.

    keys may repeat (each counts once, before any shuffle); null keys are ignored. direction: backward (greatest key <= probe) or forward (least key >= probe).
    bounds: of the ranges, where they are known from range_bounds.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    forward = direction == "forward"
    kind = probes.schema[probe].dataType
    k = keys.select(F.col(key).cast(kind).alias("p")).where("p is not null").distinct()
    q = probes.select(F.col(probe).alias("p")).where("p is not null").distinct()
    parts = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if bounds is None:
        # of probes, too: those beyond the last key, or between two far apart, are dealt as evenly as others
        bounds = range_bounds(keys.select(F.col(key).cast(kind).alias("p")).union(probes.select(F.col(probe).alias("p"))), "p", ranges or parts, None if ranges else ROWS)
    both = k.withColumn("probe", F.lit(False)).union(q.withColumn("probe", F.lit(True))).withColumn("range", range_of(bounds, F.col("p"), kind))
    if len(bounds) + 1 > parts:
        both = both.repartition(len(bounds) + 1, "range")
    own = F.when(~F.col("probe"), F.col("p"))
    # at an equal value the key comes first, in either direction
    w = Window.partitionBy("range").orderBy(F.col("p").desc() if forward else F.col("p").asc(), F.col("probe").asc()).rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("near", F.last(own, ignorenulls=True).over(w)).where("probe")
    edge = both.where(~F.col("probe")).groupBy("range").agg((F.min if forward else F.max)("p").alias("edge"))
    # one row for each range: the edges of the ranges before it
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("range").desc() if forward else F.col("range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    every = probes.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("range"))
    carried = every.join(edge, "range", "left").withColumn("carry", F.last("edge", ignorenulls=True).over(order)).select("range", "carry")
    found = within.join(F.broadcast(carried), "range", "left").select("p", F.coalesce("near", "carry").alias("found"))
    return with_found(probes, F.col(probe), found.select(F.col("p").alias("key"), F.struct("found").alias("value")), lambda hit: [hit["found"].alias("found")])


def with_found(probes: DataFrame, at: Column, table: DataFrame, cols) -> DataFrame:
    """probes left-joined to a table (key, value) whose keys are unique, by a column of theirs; with the columns that `cols` makes of the
    value, null on a miss, in place of any of those names. Probes travel as one struct, so no other name can clash."""
    rows = probes.select(F.struct(*[F.col(c) for c in probes.columns]).alias("row"), at.alias("at"))
    hit = table.select(F.col("key").alias("at"), F.col("value").alias("hit"))
    joined, new = rows.join(hit, "at", "left"), cols(F.col("hit"))
    names = joined.select(*new).columns
    return joined.select(*[F.col("row")[c].alias(c) for c in probes.columns if c not in names], *new)


def floor(probes: DataFrame, keys: DataFrame, probe: str = "q", key: str = "key") -> DataFrame:
    return asof(probes, keys, probe, key, "backward")


def ceil(probes: DataFrame, keys: DataFrame, probe: str = "q", key: str = "key") -> DataFrame:
    return asof(probes, keys, probe, key, "forward")


def locate(bounds: list, value) -> int:
    """range_of for one value, on the driver."""
    return bisect.bisect_right(bounds, value)
