"""Longest-prefix search over byte-string keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefixes import common_prefix_length
from .asof import asof, range_bounds


def longest_prefix(probes: DataFrame, keys: DataFrame, probe: str = "q", key: str = "key", mode: str = "documented") -> DataFrame:
    """(q, key, lcp): for each distinct probe all keys that share the longest common prefix any key has with it.

    mode documented: none if that prefix is empty. mode trie: what a compressed trie's search returns, which stops at a node
    without a matching child: if q goes on after the prefix, and a key equals the prefix or two keys part right after it (the
    empty prefix counts as such a place), only a key equal to the prefix is found.

    In byte order the key with the longest common prefix is a neighbour of the probe, so two as-of searches give its length m;
    the keys then join by their first m bytes. Keys go to that join once for each length m that occurs.
    """
    if mode not in ("documented", "trie"):
        raise ValueError(mode)
    q = probes.select(F.col(probe).cast("binary").alias("q")).where("q is not null").distinct()
    k = keys.select(F.col(key).cast("binary").alias("key")).where("key is not null").distinct()
    bounds = range_bounds(k, "key", int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = asof(q, k, direction="backward", bounds=bounds).withColumnRenamed("found", "below")
    near = asof(near, k, direction="forward", bounds=bounds).withColumnRenamed("found", "above")
    sized = near.where("below is not null or above is not null").withColumn("lcp", F.greatest(common_prefix_length(F.col("q"), F.col("below")), common_prefix_length(F.col("q"), F.col("above"))))
    if mode == "documented":
        sized = sized.where("lcp > 0")
    sized = sized.select("q", "lcp", F.expr("substring(q, 1, lcp)").alias("head"))
    lengths = [r[0] for r in sized.select("lcp").distinct().collect()]  # no more than a key has bytes
    at = F.explode(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"))
    heads = k.select("key", at.alias("lcp")).where(F.octet_length("key") >= F.col("lcp")).withColumn("head", F.expr("substring(key, 1, lcp)"))
    found = sized.join(heads, ["lcp", "head"])
    if mode == "documented":
        return found.select("q", "key", "lcp")
    nxt = F.expr("substring(key, lcp + 1, 1)")
    whole = F.octet_length("key") == F.col("lcp")
    node = found.groupBy("q").agg((F.max(whole) | (F.min(F.when(~whole, nxt)) < F.max(F.when(~whole, nxt))) | (F.max("lcp") == 0)).alias("node"))
    stopped = F.coalesce(F.col("node"), F.lit(False)) & (F.col("lcp") < F.octet_length("q"))
    return found.join(node, "q").where(~stopped | whole).select("q", "key", "lcp")
