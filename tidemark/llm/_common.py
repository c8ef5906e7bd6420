"""What the training-data operators share: tables, checkpoints and batch shapes.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, scratch, shared_root

#: Rows that go to Python at once; with long texts this keeps a batch at a few MB.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; checkpoints go there too.

    Only where a session names none (as in tests) a local one is made.
    """
    root = shared_root(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


_passing: list[list[str]] = []  # paths of the tables of each passing() that is open


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What stored() writes inside goes at the end, but for tables that stay: nothing may read it later on."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            remove(spark, path)


def stored(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """df, computed once, as a table in the shared folder: lost executors cost no recomputation, and columns and codecs keep it small."""
    path = scratch(df.sparkSession, name)
    if _passing and not stays:
        _passing[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder as a checkpoint; for tables of a few narrow columns."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Rows in an Arrow batch: few enough that a batch of long texts fits beside the executor's heap. Lazy tables are planned with what
    the session has when they are read, so the setting stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def free_shuffles(spark: SparkSession) -> None:
    """Deletes the shuffle files of tables that nothing reads any more. Else they stay until the driver happens to collect its garbage.
    What Python has let go of reaches the JVM a moment later, so that is asked twice."""
    for wait in (0.5, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


#: Ids that are broadcast to pick rows before they are shuffled.
IDS = 1_000_000


def only_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df with one of the ids (a column id in both); picked before they move where the ids are few."""
    ids = ids.distinct()
    return df.join(F.broadcast(ids), "id", "left_semi") if ids.limit(IDS + 1).count() <= IDS else df.join(ids, "id", "left_semi")


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fraction_for(df: DataFrame, key: str, bound: int):
    """A condition that keeps about `bound` rows of df, chosen by a hash of `key`; all rows where df has no more.

    Costs one count over `key` alone.
    """
    total = df.select(F.count(F.lit(1))).head()[0]
    if total <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * bound / total)
