"""Lists as rows (list_id, pos, value): positions count from 0 without gaps, values may repeat.

An edit table has one edit for each list (set: one for each position); more are an error. Array columns have the same edits in tidemark.functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _once(edits: DataFrame, by: tuple[str, ...] = ("list_id",)) -> DataFrame:
    """The edits; an error where one list (or place) has several."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return edits.withColumn("index", F.when(n > 1, F.raise_error(F.lit("more than one edit of a list or place"))).otherwise(F.col("index")))


class ListTable:
    def __init__(self, df: DataFrame, list_id: str = "list_id", pos: str = "pos", value: str = "value"):
        self.df = df.select(F.col(list_id).alias("list_id"), F.col(pos).cast("long").alias("pos"), F.col(value).alias("value"))

    @classmethod
    def from_ordered(cls, df: DataFrame, list_id: str, order: list[str], value: str) -> ListTable:
        """Lists from rows in any order: positions by the order columns."""
        w = Window.partitionBy(list_id).orderBy(*order)
        return cls(df.select(F.col(list_id).alias("list_id"), (F.row_number().over(w) - 1).alias("pos"), F.col(value).alias("value")))

    @classmethod
    def from_distances(cls, df: DataFrame, list_id: str, order: list[str], distance: str, value: str) -> ListTable:
        """Lists from elements that tell how many places on the next one is: positions are prefix sums of the distances."""
        w = Window.partitionBy(list_id).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return cls(df.select(F.col(list_id).alias("list_id"), F.coalesce(F.sum(distance).over(w), F.lit(0)).alias("pos"), F.col(value).alias("value")))

    def _new(self, df: DataFrame) -> ListTable:
        out = ListTable.__new__(ListTable)
        out.df = df.select("list_id", "pos", "value")
        return out

    def len(self) -> DataFrame:
        """(list_id, len)."""
        return self.df.groupBy("list_id").agg(F.count(F.lit(1)).alias("len"))

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def clear(self) -> ListTable:
        return self._new(self.df.limit(0))

    def scan(self) -> DataFrame:
        return self.df.orderBy("list_id", "pos")

    def _edits(self, edits: DataFrame, extra: int, by: tuple[str, ...] = ("list_id",)) -> DataFrame:
        """edits (list_id, index[, value]) with the list's length; an error where the index is over the length + extra - 1."""
        e = edits.join(self.len(), "list_id", "left").withColumn("len", F.coalesce("len", F.lit(0)))
        bad = (F.col("index") < 0) | (F.col("index") >= F.col("len") + extra)
        e = e.withColumn("index", F.when(bad, F.raise_error(F.concat(F.lit("index out of range: "), F.col("index").cast("string")))).otherwise(F.col("index")))
        return _once(e, by)

    def insert(self, edits: DataFrame) -> ListTable:
        """edits (list_id, index, value): the value goes before the index; the length itself appends."""
        e = self._edits(edits, 1)
        moved = self.df.join(e.select("list_id", "index"), "list_id", "left").withColumn("pos", F.col("pos") + F.coalesce((F.col("pos") >= F.col("index")).cast("long"), F.lit(0)))
        return self._new(moved.select("list_id", "pos", "value").union(e.select("list_id", F.col("index").cast("long"), "value")))

    def remove(self, edits: DataFrame) -> tuple[ListTable, DataFrame]:
        """edits (list_id, index): (the lists left, the removed rows)."""
        e = self._edits(edits, 0)
        j = self.df.join(e.select("list_id", "index"), "list_id", "left")
        hit = F.coalesce(F.col("pos") == F.col("index"), F.lit(False))
        left = j.where(~hit).withColumn("pos", F.col("pos") - F.coalesce((F.col("pos") > F.col("index")).cast("long"), F.lit(0)))
        return self._new(left), j.where(hit).select("list_id", "pos", "value")

    def push_front(self, values: DataFrame) -> ListTable:
        return self.insert(values.withColumn("index", F.lit(0)))

    def push_back(self, values: DataFrame) -> ListTable:
        return self.insert(values.join(self.len(), "list_id", "left").select("list_id", "value", F.coalesce("len", F.lit(0)).alias("index")))

    def pop_front(self, lists: DataFrame) -> tuple[ListTable, DataFrame]:
        return self.remove(lists.select("list_id", F.lit(0).alias("index")))

    def pop_back(self, lists: DataFrame) -> tuple[ListTable, DataFrame]:
        return self.remove(lists.select("list_id").join(self.len(), "list_id", "left").select("list_id", (F.coalesce("len", F.lit(0)) - 1).alias("index")))

    def get(self, probes: DataFrame) -> DataFrame:
        """probes (list_id, index) with value and found."""
        p = probes.select("list_id", F.col("index").cast("long").alias("index"))
        d = self.df.select("list_id", F.col("pos").alias("index"), "value", F.lit(True).alias("found"))
        return p.join(d, ["list_id", "index"], "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def index(self, probes: DataFrame) -> DataFrame:
        """get, an error on a miss."""
        return self.get(probes).withColumn("value", F.when(~F.col("found"), F.raise_error(F.lit("index out of range"))).otherwise(F.col("value"))).drop("found")

    def set(self, edits: DataFrame) -> ListTable:
        """edits (list_id, index, value): positional write; an error out of range."""
        e = self._edits(edits, 0, ("list_id", "index")).select("list_id", F.col("index").cast("long").alias("pos"), F.struct("value").alias("new"))
        j = self.df.join(e, ["list_id", "pos"], "left")
        return self._new(j.withColumn("value", F.when(F.col("new").isNotNull(), F.col("new.value")).otherwise(F.col("value"))))

    def update(self, expr) -> ListTable:
        """Every value replaced by an expression of its row."""
        return self._new(self.df.withColumn("value", expr))

    def concat(self, other: ListTable) -> ListTable:
        """The other lists' elements after this one's, list by list."""
        shifted = other.df.join(self.len(), "list_id", "left").select("list_id", (F.col("pos") + F.coalesce("len", F.lit(0))).alias("pos"), "value")
        return self._new(self.df.union(shifted))

    __add__ = concat

    def split(self, edits: DataFrame, left_inclusive: bool = False) -> tuple[ListTable, ListTable]:
        """edits (list_id, index): (elements before the index, the others moved to 0); lists without an edit stay left."""
        e = _once(edits.select("list_id", "index")).select("list_id", (F.col("index") + int(left_inclusive)).alias("index"))
        j = self.df.join(e, "list_id", "left")
        right = F.coalesce(F.col("pos") >= F.col("index"), F.lit(False))
        return self._new(j.where(~right)), self._new(j.where(right).withColumn("pos", F.col("pos") - F.col("index")))

    def arrays(self) -> DataFrame:
        """(list_id, value array): for lists that fit a row."""
        return self.df.groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("value"))
