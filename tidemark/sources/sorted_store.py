"""A sorted store on disk: Parquet files of disjoint, sorted ranges of keys, with declared sizes of keys and values.

A batch of changes rewrites the ranges that it touches and commits a manifest that lists the new files; readers of the old ones
are undisturbed.
"""

from __future__ import annotations

import bisect
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import check_key_type, check_size
from ..operators.asof import asof, range_of
from ..operators.keyed import OrderedMap
from ..plans.manifest import Files, Manifest, Run

PAGE = 4096  # bytes of a page
HEADER = 32
LITERAL_RANGES = 1000  # that a plan holds as literals


def leaf_degree(key_size: int, value_size: int) -> int:
    """Entries that fit a page, each with 8 bytes of its own."""
    return (PAGE - HEADER) // (key_size + value_size + 8)


def internal_degree(key_size: int) -> int:
    """Keys that fit a page of keys and 8-byte references."""
    return (PAGE - HEADER) // (key_size + 16)


class SortedStore:
    def __init__(self, spark: SparkSession, files: Files, manifest: Manifest):
        self.spark, self.files, self.manifest = spark, files, manifest
        self.schema, p = T.StructType.fromJson(json.loads(manifest.schema)), manifest.strategy
        self.key_size, self.value_size, self.leaf, self.internal, self.rows = p["key_size"], p["value_size"], p["leaf"], p["internal"], p["rows"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, key_type: str, value_type: str, key_size: int, value_size: int, rows: int = 1 << 20) -> SortedStore:
        """A new store with the degrees that the sizes allow. rows: of a range, about."""
        return cls.with_degrees(spark, path, key_type, value_type, key_size, value_size, leaf_degree(key_size, value_size), internal_degree(key_size), rows)

    @classmethod
    def with_degrees(cls, spark: SparkSession, path: str, key_type: str, value_type: str, key_size: int, value_size: int, leaf: int, internal: int, rows: int = 1 << 20) -> SortedStore:
        if not 0 < leaf <= leaf_degree(key_size, value_size) or not 0 < internal <= internal_degree(key_size):
            raise ValueError(f"nodes of these degrees don't fit a page of {PAGE} bytes")
        files = Files(spark, path)
        if files.exists(files.root):
            raise FileExistsError(path)
        files.mkdirs(files.root)
        empty = spark.createDataFrame([], f"key {key_type}, value {value_type}")
        check_key_type(empty, "key")
        params = {"key_size": key_size, "value_size": value_size, "leaf": leaf, "internal": internal, "rows": rows}
        return cls(spark, files, Manifest(empty.schema.json(), params).commit(files))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SortedStore:
        files = Files(spark, path)
        return cls(spark, files, Manifest.load(files))

    def _read(self, runs) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[r.path for r in runs]) if runs else self.spark.createDataFrame([], self.schema)

    def map(self) -> OrderedMap:
        return OrderedMap(self._read(self.manifest.runs), "key")

    def _touched(self, keys: DataFrame) -> list[Run]:
        """The ranges that hold or would take any of the keys: ranges are cut at their least keys."""
        runs = list(self.manifest.runs)
        if not runs:
            return []
        kind = self.schema["key"].dataType
        if len(runs) <= LITERAL_RANGES:
            at = range_of([r.key_min for r in runs][1:], F.col("key"), kind)
            return [runs[r[0]] for r in keys.select(at).distinct().orderBy(F.lit(1)).collect()]
        # many ranges are a table: the greatest lower bound of each key, the first range for keys below all
        bounds = self.spark.createDataFrame([(r.key_min,) for r in runs], T.StructType([T.StructField("key", kind)]))
        found = {bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in asof(keys.select(F.col("key").alias("q")), bounds).select("found").distinct().collect()}
        return [r for i, r in enumerate(runs) if r.key_min in found or (i == 0 and None in found)]

    def _rewrite(self, old: list[Run], rows: DataFrame) -> None:
        """Replaces ranges by rows, in as many ranges as their number asks for."""
        path = self.files.at(f"runs/{uuid.uuid4().hex}")
        n = rows.count()
        pieces = max(1, -(-n // self.rows))
        placed = rows.repartitionByRange(pieces, "key").sortWithinPartitions("key")
        placed.write.option("parquet.page.size", PAGE * 16).parquet(path)
        made = []
        if n:
            back = self.spark.read.schema(self.schema).parquet(path).select("key", F.col("_metadata.file_name").alias("file"))
            for r in back.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect():
                made.append(Run(f"{path}/{r.file}", r.n, 0, r.n * (self.key_size + self.value_size), r.a, r.b, 0, 0, 0))
        gone = {r.path for r in old}
        runs = sorted([*(r for r in self.manifest.runs if r.path not in gone), *made], key=lambda r: r.key_min)
        self.manifest = self.manifest.with_runs(runs).commit(self.files)

    def insert(self, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
        """Upsert of rows (key, value): the entries that were replaced. A key or value of more than the declared bytes is an error."""
        delta = OrderedMap.from_rows(rows, "key", order).df
        checked = delta.select(check_size(self.schema["key"].dataType, F.col("key").cast(self.schema["key"].dataType), self.key_size, "key").alias("key"), check_size(self.schema["value"].dataType, F.col("value").cast(self.schema["value"].dataType), self.value_size, "value").alias("value"))
        runs = self._touched(checked)
        new, old = OrderedMap(self._read(runs), "key").insert(checked)
        self._rewrite(runs, new.df)
        return old

    def remove(self, keys: DataFrame) -> DataFrame:
        """The removed entries."""
        runs = self._touched(keys.select(F.col("key").cast(self.schema["key"].dataType).alias("key")))
        left, gone = OrderedMap(self._read(runs), "key").remove(keys)
        if runs:
            self._rewrite(runs, left.df)
        return gone

    def get_key(self, key) -> DataFrame:
        """(value): only the one range that can hold the key is read."""
        runs = [r for r in self.manifest.runs if r.key_min <= key <= r.key_max]
        return OrderedMap(self._read(runs), "key").get_key(key)

    def get(self, probes: DataFrame) -> DataFrame:
        return self.map().get(probes)

    def contains(self, probes: DataFrame) -> DataFrame:
        return self.map().contains(probes)

    def contains_key(self, key) -> bool:
        return not self.get_key(key).isEmpty()

    def scan(self) -> DataFrame:
        return self.map().scan()

    def len(self) -> int:
        return sum(r.entry_count for r in self.manifest.runs)

    def is_empty(self) -> bool:
        return self.len() == 0

    def min(self):
        return self.manifest.runs[0].key_min if self.manifest.runs else None

    def max(self):
        return self.manifest.runs[-1].key_max if self.manifest.runs else None

    def clear(self) -> None:
        self.manifest = self.manifest.with_runs([]).commit(self.files)

    def range_for(self, key) -> int:
        """Index of the range that would take a key."""
        return max(0, bisect.bisect_right([r.key_min for r in self.manifest.runs], key) - 1)
