"""A log-structured map: immutable sorted Parquet runs, a manifest, and the latest version of each key as its view.

Writes never read. A batch takes one tick of the store's logical clock (its keys are made unique first), is held until the
held batches exceed max_in_memory_size bytes, and is then written as a run. The view is an aggregation over all runs, so runs may
come in any order; a tombstone hides what is older and is filtered only after that.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import check_key_type, fixed_size
from ..operators.keyed import OrderedMap
from ..plans.manifest import Files, Manifest, Run
from ..plans.strategies import CompactionStrategy, MergeJob, strategy_from

LOG = ["key", "value", "is_tombstone", "logical_time"]
BLOOM_FPP = 0.05  # false positives of a run's Bloom filter
#: Its size follows a file's keys: of this many sizes, each half of the one before from 1 MB down, the least that serves. Parquet takes
#: 1 MB for each file otherwise.
BLOOM_SIZES = 15
FEW_PATHS = 32  # files that are named one by one; of more, their folder is read and what isn't meant is left out


def latest_versions(log: DataFrame) -> DataFrame:
    """One row for each key of a log (key, value, is_tombstone, logical_time): the newest. Partial before the shuffle; column by
    column, so that values of fixed width are hash-aggregated without a sort. Versions of a key differ in time."""
    newest = [F.max_by(c, "logical_time").alias(c) for c in ("value", "is_tombstone")]
    return log.groupBy("key").agg(*newest, F.max("logical_time").alias("logical_time"))


def live_view(log: DataFrame) -> DataFrame:
    """(key, value) of the keys whose newest version is no tombstone."""
    return latest_versions(log).where(~F.col("is_tombstone")).select("key", "value")


def entry_size(df: DataFrame):
    """Bytes of an entry: key, value, a flag and its time."""
    return fixed_size(df.schema["key"].dataType, F.col("key")) + F.when(F.col("is_tombstone"), 0).otherwise(fixed_size(df.schema["value"].dataType, F.col("value"))) + 9


def run_summary(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, bytes and the ranges of keys and times of a run, or of each group of rows."""
    return log.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("entry_count"), F.count_if("is_tombstone").alias("tombstone_count"), F.sum(entry_size(log)).cast("long").alias("size"),
        F.min("key").alias("key_min"), F.max("key").alias("key_max"), F.min("logical_time").alias("lt_min"), F.max("logical_time").alias("lt_max"),
    )


class LogStore:
    def __init__(self, spark: SparkSession, files: Files, manifest: Manifest):
        self.spark, self.files, self.manifest = spark, files, manifest
        self.strategy: CompactionStrategy = strategy_from(manifest.strategy)
        self.schema = T.StructType.fromJson(__import__("json").loads(manifest.schema))
        self._held: list[DataFrame] = []
        self._held_bytes = self._held_rows = 0
        self._clock = manifest.logical_time

    @classmethod
    def create(cls, spark: SparkSession, path: str, key_type: str, value_type: str, strategy: CompactionStrategy) -> LogStore:
        """A new store; an error if anything is there."""
        files = Files(spark, path)
        if files.exists(files.root):
            raise FileExistsError(path)
        files.mkdirs(files.root)
        empty = spark.createDataFrame([], f"key {key_type}, value {value_type}, is_tombstone boolean, logical_time long")
        check_key_type(empty, "key")
        return cls(spark, files, Manifest(empty.schema.json(), strategy.params()).commit(files))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LogStore:
        """An existing store, as of its last commit; it may never have been written to."""
        files = Files(spark, path)
        return cls(spark, files, Manifest.load(files))

    # writes

    def _take(self, df: DataFrame) -> None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(entry_size(df)), F.lit(0))).head()
        self._clock += 1
        if rows:
            self._held.append(df)
            self._held_rows, self._held_bytes = self._held_rows + rows, self._held_bytes + size
        if self._held_bytes > self.strategy.max_in_memory_size:
            self.flush()

    def insert(self, rows: DataFrame, order: list[str] | None = None) -> None:
        """Rows (key, value); null keys go. Of rows with one key the last in `order` counts (without: the greatest value)."""
        m = OrderedMap.from_rows(rows.select("key", "value", *[c for c in order or [] if c not in ("key", "value")]), "key", order)
        self._take(m.df.select("key", "value", F.lit(False).alias("is_tombstone"), F.lit(self._clock).alias("logical_time")))

    def remove(self, keys: DataFrame) -> None:
        """Tombstones for keys (column key), whether or not the store has them."""
        k = keys.select("key").where("key is not null").distinct()
        self._take(k.select("key", F.lit(None).cast(self.schema["value"].dataType).alias("value"), F.lit(True).alias("is_tombstone"), F.lit(self._clock).alias("logical_time")))

    def flush(self) -> None:
        """Writes what is held as a run, then compacts as far as the strategy asks. Where others committed meanwhile, what is held is
        newer than theirs: it is stamped and written again."""
        while self._held:
            made = self._write(latest_versions(reduce(DataFrame.union, self._held)), -1, None)
            if self._append(made):
                self._held, self._held_bytes, self._held_rows = [], 0, 0
        self.compact()

    def _append(self, made: list[Run], **kw) -> bool:
        """Commits runs beside those there are. If someone committed meanwhile: takes up their manifest, moves what is held behind
        its clock, deletes the runs and gives False."""
        try:
            self._commit([*self.manifest.runs, *made], **kw)
            return True
        except FileExistsError:
            before, self.manifest = self.manifest.logical_time, Manifest.load(self.files)
            later = self.manifest.logical_time - before
            self._held = [df.withColumn("logical_time", F.col("logical_time") + F.lit(later).cast("long")) for df in self._held]
            self._clock += later
            for folder in {self._folder(r.path) for r in made}:
                self.files.delete(self.files.at(f"runs/{folder}"))
            return False

    def append_run(self, log: DataFrame, stream: str | None = None, batch_id: int | None = None) -> bool:
        """Writes a log (key, value, is_tombstone) as a run of its own, with the next tick. A batch of a stream that the
        manifest has already counts once: then nothing is written and False comes back."""
        self._clock += 1
        while stream is None or self.manifest.applied.get(stream, -1) < batch_id:
            stamped = log.select("key", "value", "is_tombstone", F.lit(self._clock - 1).cast("long").alias("logical_time")).where("key is not null")
            applied = {**self.manifest.applied, **({stream: batch_id} if stream is not None else {})}
            if self._append(self._write(stamped, -1, None), applied=applied):
                return True
        return False

    def clear(self) -> None:
        """No rows; the logical clock goes on."""
        self._held, self._held_bytes, self._held_rows = [], 0, 0
        self._commit([])

    def _commit(self, runs: list[Run], **kw) -> None:
        self.manifest = self.manifest.with_runs(runs, logical_time=self._clock, **kw).commit(self.files)

    def _write(self, log: DataFrame, level: int, pieces: int | None, entries: int = 0) -> list[Run]:
        """Sorted runs of a log with unique keys: so many ranges of keys of about the same size, each a file; without `pieces` one
        run, a folder of as many files as its bytes ask for. More pieces than shuffle partitions: a task writes several, one after
        another, each of its share of about so many entries."""
        path = self.files.at(f"runs/{uuid.uuid4().hex}")
        bloom = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.fpp#key": str(BLOOM_FPP), "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number#key": str(BLOOM_SIZES)}
        if pieces is None:
            log.orderBy("key").write.options(**bloom).parquet(path)
        else:
            tasks = min(pieces, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            rows = {} if tasks == pieces else {"maxRecordsPerFile": str(max(1, math.ceil(entries / pieces)))}
            log.repartitionByRange(tasks, "key").sortWithinPartitions("key").write.options(**bloom, **rows).parquet(path)
        back = self.spark.read.schema(self.schema).parquet(path)
        if pieces is None:
            found = [("", r) for r in run_summary(back).where("entry_count > 0").collect()]
        else:
            found = [(f"/{r.file}", r) for r in run_summary(back.select("*", F.col("_metadata.file_name").alias("file")), ["file"]).orderBy("key_min").collect()]
        return [Run(path + file, r.entry_count, r.tombstone_count, r["size"], r.key_min, r.key_max, r.lt_min, r.lt_max, level) for file, r in found]

    # reads

    def _read(self, runs) -> DataFrame:
        """The entries of runs. Many files of one folder are read by the folder: Spark would look up each path, and list very many in a job
        of a task for each."""
        paths, folders = [], {}
        for r in runs:
            folder, _, file = r.path.rpartition("/")
            if folder.endswith("/runs"):
                paths.append(r.path)
            else:
                folders.setdefault(folder, []).append(file)
        tables = []
        for folder, files in folders.items():
            if len(files) <= FEW_PATHS:
                paths += [f"{folder}/{f}" for f in files]
                continue
            table, name = self.spark.read.schema(self.schema).parquet(folder), F.col("_metadata.file_name")
            others = sorted({n for n in self.files.names(folder) if n.endswith(".parquet")}.difference(files))
            tables.append(table if not others else table.where(~name.isin(others) if len(others) < len(files) else name.isin(files)).select(*LOG))
        if paths:
            tables.append(self.spark.read.schema(self.schema).parquet(*paths))
        return reduce(DataFrame.union, tables) if tables else self.spark.createDataFrame([], self.schema)

    def scan_run(self, run: Run) -> DataFrame:
        """All entries of one run, tombstones included, in key order."""
        return self._read([run]).orderBy("key")

    def log(self) -> DataFrame:
        """Every version held or written, as of now: the runs are immutable, so later commits don't change it."""
        return reduce(DataFrame.union, self._held, self._read(self.manifest.runs))

    def view(self) -> DataFrame:
        return live_view(self.log())

    def scan(self) -> DataFrame:
        """The live view in key order, after a flush."""
        self.flush()
        return self.view().orderBy("key")

    def get_key(self, key) -> DataFrame:
        """(value) of one key, no row if it has none. Runs whose range of keys excludes it are not opened; the equality
        reaches Parquet's statistics and Bloom filters."""
        runs = [r for r in self.manifest.runs if r.key_min <= key <= r.key_max]
        log = reduce(DataFrame.union, self._held, self._read(runs))
        return live_view(log.where(F.col("key") == F.lit(key))).select("value")

    def get(self, probes: DataFrame) -> DataFrame:
        """probes (column key) with value and found."""
        wanted = probes.select("key").distinct()
        low, high = wanted.agg(F.min("key"), F.max("key")).head()
        runs = [r for r in self.manifest.runs if low is not None and r.key_min <= high and low <= r.key_max]
        log = reduce(DataFrame.union, self._held, self._read(runs)).join(wanted, "key", "left_semi")
        return probes.join(live_view(log).withColumn("found", F.lit(True)), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def contains(self, probes: DataFrame) -> DataFrame:
        return self.get(probes).drop("value")

    def contains_key(self, key) -> bool:
        return not self.get_key(key).isEmpty()

    def len(self) -> int:
        self.flush()
        return self.view().count()

    def len_hint(self) -> int:
        """An upper bound of len, from the manifest alone."""
        return self._held_rows + sum(r.entry_count - r.tombstone_count for r in self.manifest.runs)

    def is_empty(self) -> bool:
        return self.view().isEmpty()

    def min(self):
        return self.view().agg(F.min("key")).head()[0]

    def max(self):
        return self.view().agg(F.max("key")).head()[0]

    # compaction

    def compact(self) -> int:
        """Merges until the strategy is content; the number of merges."""
        done = 0
        while (job := self.strategy.next_job(self.manifest.runs)) is not None:
            self._run(job)
            done += 1
        return done

    def _run(self, job: MergeJob) -> None:
        """Writes a merge's runs and commits them in place of its inputs."""
        gone = {r.path for r in job.inputs}
        if job.move:
            made = [Run(**{**r.__dict__, "level": job.level}) for r in job.inputs]
        else:
            log = latest_versions(self._read(job.inputs))
            pieces = None if job.max_size is None else max(1, math.ceil(sum(r.size for r in job.inputs) / job.max_size))
            made = self._write(log.where(~F.col("is_tombstone")) if job.drop_tombstones else log, job.level, pieces, sum(r.entry_count for r in job.inputs))
        while True:
            try:
                return self._commit([*(r for r in self.manifest.runs if r.path not in gone), *made])
            except FileExistsError:  # someone committed meanwhile: their runs stay, and the merge counts if its inputs do
                self.manifest = Manifest.load(self.files)
                self._clock = max(self._clock, self.manifest.logical_time)
                if not gone <= {r.path for r in self.manifest.runs}:
                    return None

    def _folder(self, path: str) -> str:
        """The folder below runs/ that a run or one of its files lies in."""
        return path.rpartition("/runs/")[2].partition("/")[0]

    def collect_garbage(self, keep: list[DataFrame] | None = None, grace: float = 86_400, versions: int = 10) -> int:
        """Deletes runs that an earlier manifest lists, the present one doesn't and no table in `keep` reads; the number of folders
        deleted. A folder that no manifest lists may be one that a writer is just filling: it goes once it is unchanged for `grace`
        seconds. Of the manifests, the last `versions` stay; those before them go after their runs."""
        names = Manifest.versions(self.files)
        known = {self._folder(r.path) for n in names for r in Manifest.load(self.files, n).runs}
        used = {self._folder(r.path) for r in Manifest.load(self.files).runs} | {self._folder(r.path) for r in self.manifest.runs}
        pinned = {self._folder(f) for df in keep or [] for f in df.inputFiles()}
        there = [n for n in self.files.names(self.files.at("runs")) if n not in used | pinned]
        gone = [n for n in there if n in known or self.files.age(self.files.at(f"runs/{n}")) > grace]
        for n in gone:
            self.files.delete(self.files.at(f"runs/{n}"))
        for n in names[:-versions] if not pinned else []:
            self.files.delete(self.files.at(f"{Manifest.FOLDER}/{n}"))
        return len(gone)
