"""Ordered maps and sets over DataFrames: unique, non-null keys; equality and order look at the key alone.

Operations return new maps; those that replace or remove also return the old entries. All of them are joins and
aggregations by key that Catalyst plans: nothing is collected, and a value may be null without being missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import check_key_type
from .asof import asof, range_bounds, range_of, with_found


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in ascending order of the order columns; partial aggregation before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in df.columns])


class _Keyed:
    """What maps and sets share. Rows: the key column, then for maps the value columns."""

    def __init__(self, df: DataFrame, key: str = "key"):
        check_key_type(df, key)
        self.df, self.key = df, key

    @classmethod
    def empty(cls, spark: SparkSession, schema: str | T.StructType, key: str = "key"):
        return cls(spark.createDataFrame([], schema), key)

    @classmethod
    def from_rows(cls, df: DataFrame, key: str = "key", order: list[str] | None = None):
        """From rows whose keys may repeat or be null: null keys go; of a repeated key the last row in `order` stays,
        where none is given the one with the greatest values."""
        rest = order or [c for c in df.columns if c != key]
        df = df.where(F.col(key).isNotNull())
        return cls(latest(df, key, rest) if rest else df.dropDuplicates([key]), key)

    def _new(self, df: DataFrame):
        out = type(self).__new__(type(self))
        out.df, out.key = df, self.key
        return out

    def _keys(self, keys: DataFrame) -> DataFrame:
        """The distinct keys of another table, under this one's name."""
        name = self.key if self.key in keys.columns else keys.columns[0]
        return keys.select(F.col(name).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()

    def _only(self, other, how: str) -> DataFrame:
        """Rows whose key the other side has (left_semi) or has not (left_anti)."""
        return self.df.join(other.df.select(F.col(other.key).alias(self.key)), self.key, how).select(self.df.columns)

    # size and ends

    def len(self) -> int:
        return self.df.count()

    def count(self) -> DataFrame:
        """(len) as a table."""
        return self.df.agg(F.count(F.lit(1)).alias("len"))

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def clear(self):
        return self._new(self.df.limit(0))

    def ends(self) -> DataFrame:
        """(min_key, max_key), nulls for an empty table."""
        return self.df.agg(F.min(self.key).alias("min_key"), F.max(self.key).alias("max_key"))

    def summary(self) -> DataFrame:
        """(len, min_key, max_key, is_empty) in one pass."""
        n = F.count(F.lit(1))
        return self.df.agg(n.alias("len"), F.min(self.key).alias("min_key"), F.max(self.key).alias("max_key"), (n == 0).alias("is_empty"))

    def min(self):
        return self.df.agg(F.min(self.key)).head()[0]

    def max(self):
        return self.df.agg(F.max(self.key)).head()[0]

    def first(self, n: int = 1) -> DataFrame:
        """The n rows with the least keys."""
        return self.df.orderBy(self.key).limit(n)

    def last(self, n: int = 1) -> DataFrame:
        return self.df.orderBy(F.desc(self.key)).limit(n)

    # scans

    def scan(self) -> DataFrame:
        """All rows in key order."""
        return self.df.orderBy(self.key)

    def ranked(self, name: str = "rank", ranges: int | None = None) -> DataFrame:
        """Each row with its place in key order, from 0. Ranges of keys are numbered on their own and shifted by the sizes
        of the ranges before them, so no task sees all rows."""
        kind = self.df.schema[self.key].dataType
        ranges = ranges or int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bounds = range_bounds(self.df.select(F.col(self.key).alias("_p")), "_p", ranges)
        dealt = self.df.withColumn("_range", range_of(bounds, F.col(self.key), kind))
        sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
        before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        own = F.row_number().over(Window.partitionBy("_range").orderBy(self.key)) - 1
        return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).select(*self.df.columns, name)

    # lookups

    def contains(self, probes: DataFrame) -> DataFrame:
        """probes (a column of keys) with found, in place of a column of theirs of that name."""
        name = self.key if self.key in probes.columns else probes.columns[0]
        mine = self.df.select(F.col(self.key).alias("key"), F.lit(True).alias("value"))
        return with_found(probes, F.col(name), mine, lambda hit: [F.coalesce(hit, F.lit(False)).alias("found")])

    def contains_key(self, key) -> bool:
        return not self.df.where(F.col(self.key) == F.lit(key)).isEmpty()

    def floor(self, probes: DataFrame, probe: str = "q") -> DataFrame:
        """probes with found: the greatest key at or below each, or null."""
        return asof(probes, self.df, probe, self.key, "backward")

    def ceil(self, probes: DataFrame, probe: str = "q") -> DataFrame:
        return asof(probes, self.df, probe, self.key, "forward")

    def floor_key(self, q):
        """For one value: pushed down to the scan."""
        return self.df.where(F.col(self.key) <= F.lit(q)).agg(F.max(self.key)).head()[0]

    def ceil_key(self, q):
        return self.df.where(F.col(self.key) >= F.lit(q)).agg(F.min(self.key)).head()[0]

    def split_off(self, key, inclusive: bool):
        """(left, right): inclusive leaves the key itself on the left."""
        c, k = F.col(self.key), F.lit(key)
        return (self._new(self.df.where(c <= k)), self._new(self.df.where(c > k))) if inclusive else (self._new(self.df.where(c < k)), self._new(self.df.where(c >= k)))

    # removal

    def remove(self, keys: DataFrame):
        """(what is left, the removed entries)."""
        k = self._keys(keys)
        return self._new(self.df.join(k, self.key, "left_anti").select(self.df.columns)), self.df.join(k, self.key, "left_semi").select(self.df.columns)

    # set algebra by key; of a key that both have, the left entry stays

    def union(self, other):
        right = other._only(self, "left_anti")
        right = right.select(*[F.col(other.key).alias(self.key) if c == self.key else F.col(c) for c in self.df.columns])
        return self._new(self.df.unionByName(right))

    def intersection(self, other):
        return self._new(self._only(other, "left_semi"))

    def difference(self, other):
        return self._new(self._only(other, "left_anti"))

    def symmetric_difference(self, other):
        right = other._only(self, "left_anti")
        right = right.select(*[F.col(other.key).alias(self.key) if c == self.key else F.col(c) for c in self.df.columns])
        return self._new(self._only(other, "left_anti").unionByName(right))

    def concat_disjoint(self, other):
        """Union where every key of the other comes after all of this one's: no join. The ranges are checked."""
        mine, theirs = self.max(), other.min()
        if mine is not None and theirs is not None and mine >= theirs:
            raise ValueError("the ranges of keys overlap")
        return self._new(self.df.unionByName(other.df))

    __add__ = union
    __sub__ = difference
    __and__ = intersection
    __xor__ = symmetric_difference


class OrderedSet(_Keyed):
    """A table of one key column."""

    def insert(self, keys: DataFrame) -> tuple[OrderedSet, DataFrame]:
        """(the new set, the inserted keys that it had before)."""
        k = self._keys(keys)
        had = k.join(self.df, self.key, "left_semi")
        return self._new(self.df.unionByName(k.join(self.df, self.key, "left_anti"))), had


class OrderedMap(_Keyed):
    """A table of a key column and value columns."""

    def insert(self, rows: DataFrame, order: list[str] | None = None) -> tuple[OrderedMap, DataFrame]:
        """Upsert: (the new map, the entries that were replaced). Of rows with one key the last in `order` counts, without it the one
        with the greatest values; null keys go."""
        rest = [c for c in self.df.columns if c != self.key]
        delta = latest(rows.where(F.col(self.key).isNotNull()), self.key, order or rest).select(self.df.columns)
        kept, old = self.remove(rows.select(self.key))
        return self._new(kept.df.unionByName(delta)), old

    def get(self, probes: DataFrame) -> DataFrame:
        """probes (a column of keys) with the value columns and found, which tells a null value from a missing key; they take the place
        of columns of theirs of those names."""
        name = self.key if self.key in probes.columns else probes.columns[0]
        rest = [c for c in self.df.columns if c != self.key]
        mine = self.df.select(F.col(self.key).alias("key"), F.struct(*rest).alias("value"))
        return with_found(probes, F.col(name), mine, lambda hit: [*[hit[c].alias(c) for c in rest], hit.isNotNull().alias("found")])

    def get_key(self, key) -> DataFrame:
        """The value of one key, no row if missing: an equality that reaches the scan."""
        return self.df.where(F.col(self.key) == F.lit(key)).drop(self.key)

    def index(self, probes: DataFrame) -> DataFrame:
        """get, with an error for a missing key."""
        got = self.get(probes)
        first = next(c for c in self.df.columns if c != self.key)
        return got.withColumn(first, F.when(~F.col("found"), F.raise_error(F.lit("no such key"))).otherwise(F.col(first))).drop("found")

    def keys(self) -> DataFrame:
        return self.df.select(self.key)

    def values(self) -> DataFrame:
        return self.df.drop(self.key)

    def update(self, expr: Column, value: str = "value") -> OrderedMap:
        """Every value replaced by an expression of its row; keys stay."""
        if value == self.key:
            raise ValueError("keys are immutable")
        return self._new(self.df.withColumn(value, expr))

    def update_at(self, changes: DataFrame, value: str = "value") -> OrderedMap:
        """Point updates (key, value) of keys that exist; others change nothing. Of several changes of a key the one with the greatest
        value counts (null is the least)."""
        new = changes.groupBy(F.col(self.key).alias("key")).agg(F.max(F.struct(F.col(value).alias("v"))).alias("value"))
        old = F.col("row")[value]
        rows = self.df.select(F.struct(*[F.col(c) for c in self.df.columns]).alias("row"), F.col(self.key).alias("key")).join(new, "key", "left")
        return self._new(rows.select(*[F.when(F.col("value").isNotNull(), F.col("value")["v"]).otherwise(old).alias(c) if c == value else F.col("row")[c].alias(c) for c in self.df.columns]))

    def key_set(self) -> OrderedSet:
        return OrderedSet(self.keys(), self.key)
