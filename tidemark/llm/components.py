"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is an aggregation and a join. A node with very many links is pre-aggregated, and its links are not brought together
to be joined; each round is written to the shared folder, so that lineage stays short and lost executors cost little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


#: A node with more links than this, and than 1 in SHARE of them, is heavy. There are at most 2 * SHARE heavy nodes.
HEAVY, SHARE = 256, 50_000


def _with_least(e: DataFrame, low: DataFrame, links: int) -> DataFrame:
    """e (a, b) with the least m of its a, from low (a, m, n: links of a). Heavy nodes' rows stay where they are: their few least
    values are broadcast, by a proven bound; the rest join by a."""
    heavy = F.col("n") > max(HEAVY, links // SHARE)
    few = F.broadcast(low.where(heavy).select("a", "m"))
    return e.join(few, "a").union(e.join(few, "a", "left_anti").join(low.where(~heavy).select("a", "m"), "a"))


def _large_star(e: DataFrame, links: int) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.where("b > a"), low, links).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame, links: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(down.where("a <> b"), low, links).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) of links a to b: of two linked trees the greater root hangs on the smaller one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (differ := root[x] != root[y]).any():
        x, y = x[differ], y[differ]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _in_one_task(e: DataFrame) -> DataFrame:
    """components() of few links (a, b) of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [[b.column(i).to_numpy(zero_copy_only=False) for i in range(2)] for b in batches if b.num_rows]:
            found = least_reachable(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "component"])

    return e.repartition(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame, a: str = "a", b: str = "b", at_once: int = 0) -> DataFrame:
    """(node, component) of every node with a link to another; component is the smallest node reachable.

    links may repeat and run either way; links with a null end and links of a node to itself are no links.
    at_once: so many links, of longs, are solved in one task, which holds them: the driver then has one plan and not dozens.
    """
    e = cut(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (F.col(a).isNull() | F.col(b).isNull()).alias("open")).where("not open and a <> b").select("a", "b").distinct())
    n = e.count()
    if n <= at_once:
        return _in_one_task(e)
    e, before = cut(_small_star(e, n)), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(now) == before or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        before = tuple(now)
        e = cut(_small_star(_large_star(e, now[0]), now[0]))
