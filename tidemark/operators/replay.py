"""Replay of operation logs: slot allocators and stacks, each log in order of seq, independent of one another."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def arena_append_slots(df: DataFrame, seq: str = "seq", chunk_size: int = 1024) -> DataFrame:
    """Slots of allocations without frees: seq counts from 0; adds chunk_index and block_index."""
    return df.withColumns({"chunk_index": F.floor(F.col(seq) / chunk_size).cast("long"), "block_index": F.pmod(F.col(seq), F.lit(chunk_size)).cast("long")})


def arena_replay(log: DataFrame, arena: str = "arena_id", chunk_size: int = 1024, value: str = "value") -> DataFrame:
    """The log (arena_id, seq, op, value, chunk_index, block_index) with each operation's slot and result.

    op allocate: stores value in the slot that was freed last, else in a new one; result is null. op free: empties the
    given slot and gives what it held. op get: gives what the given slot holds, null if vacant. A free of a slot that is
    vacant or was never allocated is an error. Columns out: arena_id, seq, op, chunk_index, block_index, result, found.

    An arena's operations are sequential by nature and run in one task, in sorted order; the task holds the live slots of
    one arena at a time and never a log.
    """
    kind = log.schema[value].dataType.simpleString()
    akind = log.schema[arena].dataType.simpleString()
    src = log.select(F.col(arena).alias("a"), F.col("seq").cast("long").alias("s"), "op", F.col(value).alias("v"), F.col("chunk_index").cast("long").alias("c"), F.col("block_index").cast("long").alias("b"))
    placed = src.repartition(F.col("a")).sortWithinPartitions("a", "s")
    schema = placed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        vtype, atype = to_arrow_type(schema["v"].dataType), to_arrow_type(schema["a"].dataType)
        now, live, free, size = object(), {}, [], 0
        for batch in batches:
            out = []
            for a, s, op, v, c, b in zip(*(x.to_pylist() for x in batch.columns)):
                if a != now:
                    now, live, free, size = a, {}, [], 0
                if op == "allocate":
                    if free:
                        slot = free.pop()
                    else:
                        slot, size = divmod(size, chunk_size), size + 1
                    live[slot] = v
                    out.append((a, s, op, *slot, None, True))
                elif op == "free":
                    if (c, b) not in live:
                        raise ValueError(f"free of a vacant slot: {(c, b)}")
                    free.append((c, b))
                    out.append((a, s, op, c, b, live.pop((c, b)), True))
                elif op == "get":
                    out.append((a, s, op, c, b, live.get((c, b)), (c, b) in live))
                else:
                    raise ValueError(f"no such operation: {op}")
            cols = list(zip(*out)) if out else [[]] * 7
            types = [atype, pa.int64(), pa.string(), pa.int64(), pa.int64(), vtype, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, types)], names)

    names = [arena, "seq", "op", "chunk_index", "block_index", "result", "found"]
    return placed.mapInArrow(run, f"`{arena}` {akind}, seq long, op string, chunk_index long, block_index long, result {kind}, found boolean")


def arena_get(slots: DataFrame, probes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """probes (chunk_index, block_index, and what `by` names for each arena) with value and found, from a table of occupied slots."""
    at = [*(by or []), "chunk_index", "block_index"]
    return probes.join(slots.select(*at, "value", F.lit(True).alias("found")), at, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def _depths(log: DataFrame, stack: str) -> DataFrame:
    """The log with push (boolean), depth after each operation and depth before it; a pop of an empty stack leaves 0."""
    w = Window.partitionBy(stack).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = log.withColumn("push", F.col("op") == "push").withColumn("_s", F.sum(F.when(F.col("push"), 1).otherwise(-1)).over(w))
    d = d.withColumn("depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w)))
    return d.withColumn("before", F.coalesce(F.lag("depth").over(Window.partitionBy(stack).orderBy("seq")), F.lit(0))).drop("_s")


def stack_replay(log: DataFrame, stack: str = "stack_id", value: str = "value") -> DataFrame:
    """The pops of a log (stack_id, seq, op, value) with found and what they popped.

    A pop takes the latest push that reached the depth it starts from. Windows within a stack, all over one shuffle.
    """
    d = _depths(log, stack).withColumn("_level", F.when(F.col("push"), F.col("depth")).otherwise(F.col("before")))
    w = Window.partitionBy(stack, "_level").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_top", F.last(F.when(F.col("push"), F.struct(F.col(value).alias("v"))), ignorenulls=True).over(w))
    hit = F.col("_level") > 0
    return d.where(~F.col("push")).select(stack, "seq", F.when(hit, F.col("_top.v")).alias("popped"), hit.alias("found"))


def stack_sizes(log: DataFrame, stack: str = "stack_id") -> DataFrame:
    """(stack_id, len, is_empty) after a whole log."""
    d = _depths(log, stack)
    return d.groupBy(stack).agg(F.max_by("depth", "seq").cast("long").alias("len")).withColumn("is_empty", F.col("len") == 0)
