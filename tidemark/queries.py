"""Queries of the collection operators over the driver's tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.checks import fixed_size
from .operators import ListTable, OrderedMap, OrderedSet, arena_append_slots, arena_get, arena_replay, ceil, floor, longest_prefix, merge_ranges, overlap_join, stack_replay, stack_sizes
from .plans import Leveled, Run, SizeTiered
from .sources import LogStore, SortedStore, live_view, run_summary
from .sources.scratch import scratch
from .streaming import write_stream

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> OrderedMap:
    """o_orderkey -> o_totalprice."""
    return OrderedMap(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value")))


def parts(spark: SparkSession, sf_dir: str) -> OrderedMap:
    return OrderedMap(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("value")))


def customers(spark: SparkSession, sf_dir: str) -> OrderedMap:
    return OrderedMap(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")))


# maps and sets: changes


def _doubled(m: OrderedMap) -> DataFrame:
    return m.df.where("key % 10 = 0").withColumn("value", F.col("value") * 2)


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS value FROM orders")
def map_upsert(spark, sf_dir):
    """Orders with every tenth price doubled by an upsert."""
    m = orders(spark, sf_dir)
    return m.insert(_doubled(m))[0].df


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey % 10 = 0")
def map_upsert_replaced(spark, sf_dir):
    m = orders(spark, sf_dir)
    return m.insert(_doubled(m))[1]


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id")
def map_insert_batch_last_wins(spark, sf_dir):
    """One batch with many rows for a key: the last counts."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return OrderedMap.empty(spark, e.schema).insert(e, order=["seq"])[0].df


def _bought(spark, sf_dir) -> OrderedSet:
    return OrderedSet.from_rows(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")))


@query("SELECT l_partkey AS key FROM lineitem UNION SELECT s_suppkey FROM supplier")
def set_insert(spark, sf_dir):
    return _bought(spark, sf_dir).insert(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")))[0].df


@query("SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_partkey IN (SELECT s_suppkey FROM supplier)")
def set_insert_existing(spark, sf_dir):
    return _bought(spark, sf_dir).insert(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")))[1]


def _big(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("key"))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 49)")
def map_remove(spark, sf_dir):
    return orders(spark, sf_dir).remove(_big(spark, sf_dir))[0].df


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 49)")
def map_removed(spark, sf_dir):
    return orders(spark, sf_dir).remove(_big(spark, sf_dir))[1]


@query("SELECT o_orderkey AS key, o_totalprice + 1 AS value FROM orders")
def map_bulk_update(spark, sf_dir):
    return orders(spark, sf_dir).update(F.col("value") + 1).df


@query("SELECT c_custkey AS key, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS value FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def map_point_update(spark, sf_dir):
    changes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    return customers(spark, sf_dir).update_at(changes).df


@query("SELECT o_orderkey AS key, CASE WHEN l_orderkey IS NULL THEN o_totalprice ELSE price END AS value FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey")
def map_upsert_repeated_keys(spark, sf_dir):
    """A batch that repeats keys, without an order: the greatest value of each counts."""
    batch = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("value"))
    return orders(spark, sf_dir).insert(batch)[0].df


@query("SELECT p_partkey AS key, CASE WHEN l_partkey IS NULL THEN p_retailprice ELSE price END AS value FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS price FROM lineitem GROUP BY l_partkey) l ON l_partkey = p_partkey")
def map_point_update_repeated_keys(spark, sf_dir):
    changes = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_extendedprice").alias("value"))
    return parts(spark, sf_dir).update_at(changes).df


@query("SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE 1 = 0")
def map_clear(spark, sf_dir):
    return customers(spark, sf_dir).clear().df


# maps and sets: lookups


def _probes(spark, sf_dir) -> DataFrame:
    q = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")).distinct()
    return q.union(q.select(F.col("key") + 1_000_000))


_PROBES = "(SELECT DISTINCT l_partkey AS key FROM lineitem UNION ALL SELECT DISTINCT l_partkey + 1000000 FROM lineitem) q"


@query(f"SELECT q.key, p_retailprice AS value, p_partkey IS NOT NULL AS found FROM {_PROBES} LEFT JOIN part ON p_partkey = q.key")
def map_get(spark, sf_dir):
    return parts(spark, sf_dir).get(_probes(spark, sf_dir))


@query(f"SELECT q.key, p_partkey IS NOT NULL AS found FROM {_PROBES} LEFT JOIN part ON p_partkey = q.key")
def map_contains(spark, sf_dir):
    return parts(spark, sf_dir).contains(_probes(spark, sf_dir))


@query("SELECT l_partkey AS key, p_retailprice AS value FROM (SELECT DISTINCT l_partkey FROM lineitem) q JOIN part ON p_partkey = l_partkey")
def map_index(spark, sf_dir):
    """Strict lookup: an error if a key were missing."""
    return parts(spark, sf_dir).index(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")).distinct())


@query("SELECT p_retailprice AS value FROM part WHERE p_partkey = 42")
def map_get_key(spark, sf_dir):
    return parts(spark, sf_dir).get_key(42)


@query("SELECT c_custkey AS key, c_acctbal AS value, row_number() OVER (ORDER BY c_custkey) - 1 AS rank FROM customer")
def map_scan_ranked(spark, sf_dir):
    return customers(spark, sf_dir).ranked()


@query("SELECT count(*) AS len FROM orders")
def map_len(spark, sf_dir):
    return orders(spark, sf_dir).count()


@query("SELECT 'all' AS what, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, count(*) = 0 AS is_empty FROM orders UNION ALL SELECT 'none', min(o_orderkey), max(o_orderkey), count(*) = 0 FROM orders WHERE o_orderkey < 0")
def map_minmax_is_empty(spark, sf_dir):
    m = orders(spark, sf_dir)
    ends = lambda x, name: x.summary().select(F.lit(name).alias("what"), "min_key", "max_key", "is_empty")
    return ends(m, "all").union(ends(m.split_off(-1, True)[0], "none"))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders ORDER BY o_orderkey LIMIT 1")
def map_first(spark, sf_dir):
    return orders(spark, sf_dir).first()


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def map_last(spark, sf_dir):
    return orders(spark, sf_dir).last()


def _split(side: int, inclusive: bool, op: str):
    def f(spark, sf_dir):
        return orders(spark, sf_dir).split_off(500, inclusive)[side].df

    f.__name__ = f"map_split_{('left', 'right')[side]}{'_incl' * inclusive}"
    query(f"SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey {op} 500")(f)


for _side, _inclusive, _op in ((0, False, "<"), (1, False, ">="), (0, True, "<="), (1, True, ">")):
    _split(_side, _inclusive, _op)


def _asof_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    probes = read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 3 - 7).alias("q"))
    return probes, read(spark, sf_dir, "events").where("event_id % 7 = 0").select(F.col("event_id").alias("key"))


@query("SELECT q, k AS found FROM (SELECT o_orderkey * 3 - 7 AS q FROM orders) p ASOF LEFT JOIN (SELECT event_id AS k FROM events WHERE event_id % 7 = 0) e ON p.q >= e.k")
def asof_floor(spark, sf_dir):
    return floor(*_asof_tables(spark, sf_dir))


@query("SELECT q, k AS found FROM (SELECT o_orderkey * 3 - 7 AS q FROM orders) p ASOF LEFT JOIN (SELECT event_id AS k FROM events WHERE event_id % 7 = 0) e ON p.q <= e.k")
def asof_ceil(spark, sf_dir):
    return ceil(*_asof_tables(spark, sf_dir))


# set algebra: left = even orders, right = multiples of 3 in the first three fifths with negated prices, so a left tail follows the right's end


def _sides(spark, sf_dir) -> tuple[OrderedMap, OrderedMap]:
    m = orders(spark, sf_dir)
    edge = (m.max() or 0) * 3 // 5
    return OrderedMap(m.df.where("key % 2 = 0")), OrderedMap(m.df.where(f"key % 3 = 0 and key < {edge}").withColumn("value", -F.col("value")))


_L = "(SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey % 2 = 0) l"
_R = "(SELECT o_orderkey AS key, -o_totalprice AS value FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey < (SELECT max(o_orderkey) * 3 // 5 FROM orders)) r"


@query(f"SELECT coalesce(l.key, r.key) AS key, CASE WHEN l.key IS NOT NULL THEN l.value ELSE r.value END AS value FROM {_L} FULL JOIN {_R} ON l.key = r.key")
def set_union_left_bias(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return (a + b).df


@query(f"SELECT l.key, l.value FROM {_L} JOIN {_R} ON l.key = r.key")
def set_intersection(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return a.intersection(b).df


@query(f"SELECT l.key, l.value FROM {_L} LEFT JOIN {_R} ON l.key = r.key WHERE r.key IS NULL")
def set_difference(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return (a - b).df


@query(f"SELECT coalesce(l.key, r.key) AS key, CASE WHEN l.key IS NOT NULL THEN l.value ELSE r.value END AS value FROM {_L} FULL JOIN {_R} ON l.key = r.key WHERE l.key IS NULL OR r.key IS NULL")
def set_symmetric_difference(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return a.symmetric_difference(b).df


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders")
def set_concat_disjoint(spark, sf_dir):
    """Both halves of a split, put together again."""
    a, b = orders(spark, sf_dir).split_off(500, True)
    return a.concat_disjoint(b).df


# ranges

_RANGES = "(SELECT o_orderkey, o_custkey AS lo, o_custkey + o_orderkey % 40 AS hi FROM orders) a, (SELECT s_suppkey, s_suppkey * 5 AS lo, s_suppkey * 5 + s_nationkey AS hi FROM supplier) b"


@query(f"SELECT o_orderkey, s_suppkey FROM {_RANGES} WHERE greatest(a.lo, b.lo) <= least(a.hi, b.hi)")
def range_overlap(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("lo"), (F.col("o_custkey") + F.col("o_orderkey") % 40).alias("hi"))
    b = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 5).alias("lo"), (F.col("s_suppkey") * 5 + F.col("s_nationkey")).alias("hi"))
    return overlap_join(a, b).select("a.o_orderkey", "b.s_suppkey")


@query("SELECT o_custkey, min(o_orderkey) AS lo, max(o_orderkey + 10) AS hi FROM orders GROUP BY o_custkey")
def range_merge(spark, sf_dir):
    r = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + 10).alias("hi"))
    return merge_ranges(r, by=["o_custkey"])


# log-structured store: events as a log, key = user, time = event id, errors and clicks as tombstones


def _log(spark, sf_dir) -> DataFrame:
    dead = F.col("event_type").isin("error", "click")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(~dead, F.col("value")).alias("value"), dead.alias("is_tombstone"), F.col("event_id").alias("logical_time"), F.floor(F.col("event_id") / 100).alias("run"))


_VIEW = "SELECT user_id AS key, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) e WHERE k = 1 AND event_type NOT IN ('error', 'click')"


@query(_VIEW)
def lsm_view(spark, sf_dir):
    return live_view(_log(spark, sf_dir))


@query(f"SELECT count(*) AS len FROM ({_VIEW}) v")
def lsm_len(spark, sf_dir):
    return live_view(_log(spark, sf_dir)).agg(F.count(F.lit(1)).alias("len"))


_DEAD = "event_type IN ('error', 'click')"
_IN_RUN = f"(SELECT event_id // 100 AS run, user_id, arg_max({_DEAD}, event_id) AS dead, max(event_id) AS lt FROM events GROUP BY 1, 2)"


def _runs(spark, sf_dir) -> DataFrame:
    """The log with the newest version of each key in each run."""
    best = F.max_by(F.struct("value", "is_tombstone", "logical_time"), "logical_time").alias("v")
    return _log(spark, sf_dir).groupBy("run", "key").agg(best).select("run", "key", "v.*")


@query(f"SELECT run, count(*) AS entry_count, count(*) FILTER (WHERE dead) AS tombstone_count, CAST(sum(CASE WHEN dead THEN 17 ELSE 25 END) AS BIGINT) AS size, min(user_id) AS key_min, max(user_id) AS key_max, min(lt) AS lt_min, max(lt) AS lt_max FROM {_IN_RUN} r GROUP BY run")
def lsm_run_summary(spark, sf_dir):
    return run_summary(_runs(spark, sf_dir), ["run"])


@query(f"SELECT CAST(sum(CASE WHEN dead THEN 0 ELSE 1 END) AS BIGINT) AS len_hint FROM {_IN_RUN} r")
def lsm_len_hint(spark, sf_dir):
    s = run_summary(_runs(spark, sf_dir), ["run"])
    return s.agg(F.sum(F.col("entry_count") - F.col("tombstone_count")).alias("len_hint"))


def _batches(spark, sf_dir) -> list[DataFrame]:
    """The log in eight parts by time, each with the newest version of its keys."""
    edges = read(spark, sf_dir, "events").agg(F.max("event_id")).head()[0] // 8 + 1
    part = lambda i: _log(spark, sf_dir).where((F.col("logical_time") >= i * edges) & (F.col("logical_time") < (i + 1) * edges))
    return [OrderedMap.from_rows(part(i), "key", ["logical_time"]).df.select("key", "value", "is_tombstone") for i in range(8)]


_PART = "(SELECT *, event_id // ((SELECT max(event_id) FROM events) // 8 + 1) AS part FROM events)"
_IN_PART = f"(SELECT part, user_id, arg_max({_DEAD}, event_id) AS dead, arg_max(value, event_id) AS value FROM {_PART} p GROUP BY 1, 2)"


def _store(spark, strategy) -> LogStore:
    return LogStore.create(spark, scratch(spark, "lsm"), "long", "double", strategy)


def _filled(spark, sf_dir, strategy) -> LogStore:
    """A store that took the log in eight batches, with compactions between them."""
    store = _store(spark, strategy)
    for part in _batches(spark, sf_dir):
        store.append_run(part)
        store.compact()
    return store


_LOOSE = SizeTiered(1 << 40, 100, 1 << 40, 0.5, 1.5)  # never compacts eight runs


@query(_VIEW)
def lsm_compact_size_tiered(spark, sf_dir):
    return _filled(spark, sf_dir, SizeTiered(1000, 4, 4000, 0.5, 1.5)).view()


@query(_VIEW)
def lsm_compact_leveled(spark, sf_dir):
    return _filled(spark, sf_dir, Leveled(1000, 2, 2000, 3, 2)).view()


@query(f"SELECT q.key, v.value, v.key IS NOT NULL AS found FROM (SELECT c_custkey AS key FROM customer) q LEFT JOIN ({_VIEW}) v ON q.key = v.key")
def lsm_get(spark, sf_dir):
    return _filled(spark, sf_dir, Leveled(1000, 2, 2000, 3, 2)).get(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))


@query(f"SELECT min(key) AS min_key, max(key) AS max_key FROM ({_VIEW}) v")
def lsm_minmax(spark, sf_dir):
    return live_view(_log(spark, sf_dir)).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 49)")
def lsm_insert_remove(spark, sf_dir):
    """Blind inserts, then tombstones for large orders, through a store that is opened again between."""
    path = scratch(spark, "lsm")
    store = LogStore.create(spark, path, "long", "double", SizeTiered(1 << 20, 4, 4000, 0.5, 1.5))
    store.insert(orders(spark, sf_dir).df)
    store.flush()
    store = LogStore.open(spark, path)
    store.remove(_big(spark, sf_dir))
    store.flush()
    return LogStore.open(spark, path).view()


@query(_VIEW)
def lsm_stream(spark, sf_dir):
    """The log as a stream of files into a store, batch by batch."""
    store = LogStore.create(spark, scratch(spark, "lsm"), "long", "double", SizeTiered(1 << 20, 4, 4000, 0.5, 1.5))
    src = scratch(spark, "changes")
    log = _log(spark, sf_dir).drop("run")
    log.repartitionByRange(4, "logical_time").write.parquet(src)
    changes = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(src)
    write_stream(changes, store, scratch(spark, "checkpoint"), "events", ["logical_time"]).awaitTermination()
    return store.view()


@query(f"SELECT user_id AS key, CASE WHEN dead THEN NULL ELSE value END AS value, dead AS is_tombstone, CAST(2 AS BIGINT) AS logical_time FROM {_IN_PART} p WHERE part = 2")
def lsm_scan_run(spark, sf_dir):
    """All entries of the third run, tombstones included."""
    store = _filled(spark, sf_dir, _LOOSE)
    return store.scan_run(store.manifest.runs[2])


@query(f"SELECT value FROM ({_VIEW}) v WHERE key = 42")
def lsm_get_key(spark, sf_dir):
    """One key, by runs whose ranges of keys, statistics and Bloom filters let it be there."""
    return _filled(spark, sf_dir, Leveled(1000, 2, 2000, 3, 2)).get_key(42)


@query(f"SELECT (SELECT count(*) FROM ({_VIEW}) v) AS len, (SELECT count(*) FROM {_IN_PART} p WHERE NOT dead) AS len_hint, CAST(0 AS BIGINT) AS after_clear")
def lsm_store_counts(spark, sf_dir):
    """The store's own counts: exact, the bound from its manifest, and after a clear."""
    store = _filled(spark, sf_dir, _LOOSE)
    n, hint = store.len(), store.len_hint()
    store.clear()
    return spark.createDataFrame([(n, hint, store.len())], "len long, len_hint long, after_clear long")


@query(_VIEW)
def lsm_store_scan(spark, sf_dir):
    """The live view in key order of a store with batches that it still holds."""
    store = _store(spark, _LOOSE)
    for part in _batches(spark, sf_dir):
        store.insert(part.where("not is_tombstone"))
        store.remove(part.where("is_tombstone"))
    return store.scan()


@query("SELECT 'all' AS held, CAST(0 AS BIGINT) AS runs, CAST(count(*) AS BIGINT) AS hint FROM orders UNION ALL SELECT 'none', 8, count(*) FROM orders")
def lsm_memtable(spark, sf_dir):
    """Eight batches below and above the bytes that a store holds: no run, or one for each."""
    rows = []
    for held, most in (("all", 1 << 50), ("none", 0)):
        store = _store(spark, SizeTiered(most, 100, 1 << 40, 0.5, 1.5))
        for i in range(8):
            store.insert(orders(spark, sf_dir).df.where(F.col("key") % 8 == i))
        rows.append((held, len(store.manifest.runs), store.len_hint()))
    return spark.createDataFrame(rows, "held string, runs long, hint long")


@query(_VIEW)
def lsm_concurrent_compaction(spark, sf_dir):
    """A merge that commits after others have added runs: theirs stay."""
    a = _store(spark, _LOOSE)
    first, rest = _batches(spark, sf_dir)[:5], _batches(spark, sf_dir)[5:]
    for part in first:
        a.append_run(part)
    job = SizeTiered(0, 4, 1 << 40, 0.5, 1.5).next_job(a.manifest.runs)
    b = LogStore.open(spark, a.files.root)
    for part in rest:
        b.append_run(part)
    a._run(job)
    return LogStore.open(spark, a.files.root).view()


@query(f"SELECT CAST(8 AS BIGINT) AS deleted, CAST(1 AS BIGINT) AS runs, count(*) AS len FROM ({_VIEW}) v")
def lsm_garbage(spark, sf_dir):
    """Eight runs merged into one; then the folders of the eight are garbage."""
    store = _filled(spark, sf_dir, SizeTiered(0, 7, 1 << 40, 0.5, 1.5))
    return spark.createDataFrame([(store.collect_garbage(), len(store.manifest.runs), store.len())], "deleted long, runs long, len long")


@query(f"SELECT user_id AS key, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM {_PART} p WHERE part < 4) e WHERE k = 1 AND NOT {_DEAD}")
def lsm_reader_pin(spark, sf_dir):
    """A view taken after four batches, read after the rest came, was merged and garbage was collected."""
    store, parts_ = _store(spark, SizeTiered(0, 7, 1 << 40, 0.5, 1.5)), _batches(spark, sf_dir)
    for part in parts_[:4]:
        store.append_run(part)
    seen = store.view()
    for part in parts_[4:]:
        store.append_run(part)
    store.compact()
    store.collect_garbage(keep=[seen])
    return seen


def _summaries(df: DataFrame) -> list[Run]:
    return [Run(str(i), *r[1:], level=0) for i, r in enumerate(df.orderBy("lt_min").collect())]


_KEY_RUN = f"(SELECT user_id // 8 AS run, count(*) AS entry_count, count(*) FILTER (WHERE dead) AS tombstone_count, max(user_id) AS key_max FROM (SELECT user_id, arg_max({_DEAD}, event_id) AS dead FROM events GROUP BY 1) k GROUP BY 1)"


@query(f"SELECT key_max, entry_count, tombstone_count FROM (SELECT *, row_number() OVER (ORDER BY tombstone_count / entry_count DESC, key_max DESC) AS k, count(*) OVER () AS n FROM {_KEY_RUN} r) x WHERE k <= n - 3")
def leveled_evicted(spark, sf_dir):
    """Of a level with room for three runs, those with the greatest share of tombstones."""
    best = F.max_by(F.struct("value", "is_tombstone", "logical_time"), "logical_time").alias("v")
    newest = _log(spark, sf_dir).groupBy("key").agg(best).select("key", "v.*", F.floor(F.col("key") / 8).alias("run"))
    out = Leveled(0, 1, 1, 3, 2).evicted(_summaries(run_summary(newest, ["run"])), 0)
    return spark.createDataFrame([(r.key_max, r.entry_count, r.tombstone_count) for r in out], "key_max long, entry_count long, tombstone_count long")


_SIZED = f"(SELECT row_number() OVER (ORDER BY size, lt_min) AS place, size, lt_min FROM (SELECT CAST(sum(CASE WHEN dead THEN 17 ELSE 25 END) AS BIGINT) AS size, min(lt) AS lt_min FROM {_IN_RUN} r GROUP BY run) s)"


@query(f"SELECT place, size, lt_min FROM {_SIZED} o")
def size_tiered_order(spark, sf_dir):
    """Runs by size."""
    order = SizeTiered(0, 4, 0, 0.5, 1.5).order(tuple(_summaries(run_summary(_runs(spark, sf_dir), ["run"]))))
    return spark.createDataFrame([(i, r.size, r.lt_min) for i, r in enumerate(order, 1)], "place long, size long, lt_min long")


@query(
    f"WITH RECURSIVE o AS {_SIZED}, w(place, n, total, first, broke) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS BIGINT), false"
    " UNION ALL SELECT place, CASE WHEN fits OR n > 4 THEN n ELSE 0 END, CASE WHEN fits OR n > 4 THEN total ELSE 0 END, first, NOT fits AND n > 4 FROM ("
    "SELECT *, 2 * total <= 4 * first * n AND 2 * size * n <= 3 * total AS fits FROM (SELECT o.place, o.size, w.n + 1 AS n, w.total + o.size AS total, CASE WHEN w.n = 0 THEN o.size ELSE w.first END AS first FROM w JOIN o ON o.place = w.place + 1 WHERE NOT w.broke) a) b),"
    " found AS (SELECT place, n FROM w WHERE place = (SELECT max(place) FROM w) AND n > 4) SELECT o.place, o.size, o.lt_min FROM o JOIN found f ON o.place > f.place - f.n AND o.place <= f.place"
)
def size_tiered_bucket(spark, sf_dir):
    """The runs that the next merge takes, with running averages in play."""
    s = SizeTiered(0, 4, 0, 0.5, 1.5)
    runs = tuple(_summaries(run_summary(_runs(spark, sf_dir), ["run"])))
    place = {r.path: i for i, r in enumerate(s.order(runs), 1)}
    return spark.createDataFrame([(place[r.path], r.size, r.lt_min) for r in s.bucket(runs)], "place long, size long, lt_min long")


# sorted store


@query("SELECT p_partkey AS key, p_name AS value FROM part WHERE strlen(p_name) + 8 <= 24")
def sorted_store_sizes(spark, sf_dir):
    """Values of up to 24 bytes, 8 of them for the length; the store would refuse longer ones."""
    store = SortedStore.create(spark, scratch(spark, "sorted"), "long", "string", 8, 24, rows=4096)
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))
    store.insert(rows.where(fixed_size(rows.schema["value"].dataType, F.col("value")) <= 24))
    return store.scan()


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS value FROM orders")
def sorted_store_upsert(spark, sf_dir):
    path = scratch(spark, "sorted")
    store = SortedStore.create(spark, path, "long", "double", 8, 8, rows=4096)
    m = orders(spark, sf_dir)
    store.insert(m.df)
    store = SortedStore.open(spark, path)
    store.insert(_doubled(m))
    return store.scan()


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 49)")
def sorted_store_remove(spark, sf_dir):
    store = SortedStore.with_degrees(spark, scratch(spark, "sorted"), "long", "double", 8, 8, 3, 3, rows=4096)
    store.insert(orders(spark, sf_dir).df)
    store.remove(_big(spark, sf_dir))
    return store.scan()


# byte-string keys


def _names(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Probes: customer names and, cut and changed, part names; keys: part names and customer names that end in a digit under 5."""
    part, cust = read(spark, sf_dir, "part"), read(spark, sf_dir, "customer")
    keys = part.select(F.encode("p_name", "UTF-8").alias("key")).union(cust.where(F.substring("c_name", -1, 1) < "5").select(F.encode("c_name", "UTF-8")))
    probes = cust.select(F.encode("c_name", "UTF-8").alias("q")).union(part.select(F.encode(F.concat(F.expr("left(p_name, length(p_name) - 2)"), F.lit("zz")), "UTF-8")))
    return probes, keys


_KEYS = "k AS (SELECT DISTINCT p_name AS key FROM part UNION SELECT c_name FROM customer WHERE right(c_name, 1) < '5')"
_QS = "q AS (SELECT DISTINCT c_name AS q FROM customer UNION SELECT left(p_name, length(p_name) - 2) || 'zz' FROM part)"
_LCP = "h AS (SELECT DISTINCT left(key, n) AS head, n FROM k, unnest(range(1, 64)) AS t(n) WHERE n <= length(key)), m AS (SELECT q, max(n) AS lcp FROM q JOIN h ON starts_with(q, head) GROUP BY q), f AS (SELECT m.q, k.key, m.lcp FROM m JOIN k ON left(k.key, m.lcp) = left(m.q, m.lcp))"


@query(f"WITH {_KEYS}, {_QS}, {_LCP} SELECT q, key, CAST(lcp AS INTEGER) AS lcp FROM f")
def radix_longest_prefix(spark, sf_dir):
    return longest_prefix(*_names(spark, sf_dir)).select(F.decode("q", "UTF-8").alias("q"), F.decode("key", "UTF-8").alias("key"), "lcp")


@query(
    f"WITH {_KEYS}, {_QS}, {_LCP}, n AS (SELECT q, bool_or(length(key) = lcp) OR count(DISTINCT CASE WHEN length(key) > lcp THEN substr(key, CAST(lcp AS INT) + 1, 1) END) > 1 AS node FROM f GROUP BY q)"
    " SELECT f.q, f.key, CAST(lcp AS INTEGER) AS lcp FROM f JOIN n ON f.q = n.q WHERE NOT (node AND lcp < length(f.q)) OR length(f.key) = lcp"
)
def radix_longest_prefix_trie(spark, sf_dir):
    p, k = _names(spark, sf_dir)
    return longest_prefix(p, k, mode="trie").where("lcp > 0").select(F.decode("q", "UTF-8").alias("q"), F.decode("key", "UTF-8").alias("key"), "lcp")


def _radix(spark, sf_dir) -> OrderedMap:
    return OrderedMap(read(spark, sf_dir, "customer").select(F.encode("c_name", "UTF-8").alias("key"), F.col("c_custkey").alias("value")))


@query("SELECT min(c_name) AS min_key, max(c_name) AS max_key FROM customer")
def radix_minmax(spark, sf_dir):
    return _radix(spark, sf_dir).ends().select(F.decode("min_key", "UTF-8").alias("min_key"), F.decode("max_key", "UTF-8").alias("max_key"))


@query("SELECT c_name AS key, c_custkey AS value, row_number() OVER (ORDER BY encode(c_name)) - 1 AS rank FROM customer")
def radix_scan(spark, sf_dir):
    return _radix(spark, sf_dir).ranked().withColumn("key", F.decode("key", "UTF-8"))


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.decode("key", "UTF-8"))


_EVEN = "c_custkey % 2 = 0"


@query(f"SELECT c_name AS key, CASE WHEN {_EVEN} THEN -c_custkey ELSE c_custkey END AS value FROM customer")
def radix_insert(spark, sf_dir):
    m = _radix(spark, sf_dir)
    return _text(m.insert(m.df.where("value % 2 = 0").withColumn("value", -F.col("value")))[0].df)


@query(f"SELECT c_name AS key, c_custkey AS value FROM customer WHERE NOT {_EVEN}")
def radix_remove(spark, sf_dir):
    m = _radix(spark, sf_dir)
    return _text(m.remove(m.df.where("value % 2 = 0").select("key"))[0].df)


@query("SELECT q.key, c_custkey AS value, c_custkey IS NOT NULL AS found FROM (SELECT c_name AS key FROM customer UNION ALL SELECT c_name || '!' FROM customer) q LEFT JOIN customer ON c_name = q.key")
def radix_get(spark, sf_dir):
    m = _radix(spark, sf_dir)
    return _text(m.get(m.keys().union(m.df.select(F.encode(F.concat(F.decode("key", "UTF-8"), F.lit("!")), "UTF-8")))))


# lists: conversations by turn


def _lists(spark, sf_dir) -> ListTable:
    return ListTable.from_ordered(read(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text")


def _each(spark, sf_dir, **cols) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("list_id")).distinct()
    return c.withColumns({k: F.lit(v) for k, v in cols.items()})


_T = "(SELECT conv_id AS list_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text AS value, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
_IDS = "(SELECT conv_id AS list_id, count(*) AS n FROM conversations GROUP BY conv_id)"


@query(f"SELECT list_id, CASE WHEN pos >= 1 THEN pos + 1 ELSE pos END AS pos, value FROM {_T} t UNION ALL SELECT list_id, 1, 'new' FROM {_IDS} i")
def list_insert(spark, sf_dir):
    return _lists(spark, sf_dir).insert(_each(spark, sf_dir, index=1, value="new")).df


@query(f"SELECT list_id, CASE WHEN pos > 1 THEN pos - 1 ELSE pos END AS pos, value FROM {_T} t WHERE pos <> 1")
def list_remove(spark, sf_dir):
    return _lists(spark, sf_dir).remove(_second(spark, sf_dir))[0].df


@query(f"SELECT list_id, pos, value FROM {_T} t WHERE pos = 1")
def list_removed(spark, sf_dir):
    return _lists(spark, sf_dir).remove(_second(spark, sf_dir))[1]


def _second(spark, sf_dir) -> DataFrame:
    """Index 1 of every list that has one."""
    return _lists(spark, sf_dir).len().where("len > 1").select("list_id", F.lit(1).alias("index"))


@query(f"SELECT list_id, pos + 1 AS pos, value FROM {_T} t UNION ALL SELECT list_id, 0, 'first' FROM {_IDS} i")
def list_push_front(spark, sf_dir):
    return _lists(spark, sf_dir).push_front(_each(spark, sf_dir, value="first")).df


@query(f"SELECT list_id, pos, value FROM {_T} t UNION ALL SELECT list_id, n, 'last' FROM {_IDS} i")
def list_push_back(spark, sf_dir):
    return _lists(spark, sf_dir).push_back(_each(spark, sf_dir, value="last")).df


@query(f"SELECT list_id, pos - 1 AS pos, value FROM {_T} t WHERE pos > 0")
def list_pop_front(spark, sf_dir):
    return _lists(spark, sf_dir).pop_front(_each(spark, sf_dir))[0].df


@query(f"SELECT list_id, pos, value FROM {_T} t WHERE pos = n - 1")
def list_pop_back_value(spark, sf_dir):
    return _lists(spark, sf_dir).pop_back(_each(spark, sf_dir))[1]


@query(f"SELECT i.list_id, CAST(3 AS BIGINT) AS index, value, t.list_id IS NOT NULL AS found FROM {_IDS} i LEFT JOIN {_T} t ON i.list_id = t.list_id AND pos = 3")
def list_get(spark, sf_dir):
    return _lists(spark, sf_dir).get(_each(spark, sf_dir, index=3))


@query(f"SELECT list_id, pos, CASE WHEN pos = 0 THEN 'set' ELSE value END AS value FROM {_T} t")
def list_set(spark, sf_dir):
    return _lists(spark, sf_dir).set(_each(spark, sf_dir, index=0, value="set")).df


@query(f"SELECT list_id, pos, value FROM {_T} t UNION ALL SELECT list_id, pos + n, value || '!' FROM {_T} t")
def list_concat(spark, sf_dir):
    a = _lists(spark, sf_dir)
    return (a + a.update(F.concat("value", F.lit("!")))).df


@query(f"SELECT list_id, pos - 2 AS pos, value FROM {_T} t WHERE pos >= 2")
def list_split_right(spark, sf_dir):
    return _lists(spark, sf_dir).split(_each(spark, sf_dir, index=2))[1].df


@query("SELECT user_id AS list_id, CAST(coalesce(sum(event_id % 5 + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, event_type AS value FROM events")
def list_from_distances(spark, sf_dir):
    """Positions as prefix sums of the distances to the next element."""
    e = read(spark, sf_dir, "events").withColumn("distance", F.col("event_id") % 5 + 1)
    return ListTable.from_distances(e, "user_id", ["event_id"], "distance", "event_type").df


@query("SELECT conv_id AS list_id, count(*) AS len FROM conversations GROUP BY conv_id")
def list_len(spark, sf_dir):
    return _lists(spark, sf_dir).len()


# arena and stack


@query("SELECT event_id, event_id // 1024 AS chunk_index, event_id % 1024 AS block_index FROM events")
def arena_allocate(spark, sf_dir):
    return arena_append_slots(read(spark, sf_dir, "events").select("event_id"), "event_id", 1024)


@query("SELECT user_id AS arena_id, event_id AS seq, 'allocate' AS op, (row_number() OVER w - 1) // 4 AS chunk_index, (row_number() OVER w - 1) % 4 AS block_index, CAST(NULL AS BIGINT) AS result, true AS found FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def arena_replay_allocations(spark, sf_dir):
    """Each user's events allocated in an arena of chunks of 4."""
    no = F.lit(None).cast("long")
    log = read(spark, sf_dir, "events").select(F.col("user_id").alias("arena_id"), F.col("event_id").alias("seq"), F.lit("allocate").alias("op"), F.col("event_id").alias("value"), no.alias("chunk_index"), no.alias("block_index"))
    return arena_replay(log, chunk_size=4)


# of seven events in a row: two allocations, both freed, two more that take the freed slots (the last freed first), a read of one
_SEVEN = "(SELECT user_id AS arena_id, event_id AS seq, event_id AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)"
_SLOTS = (
    f"(SELECT *, i % 7 AS step, 2 * (i // 7) + CASE WHEN i % 7 IN (0, 2, 5, 6) THEN 0 ELSE 1 END AS slot, lag(v, 1) OVER w AS v1, lag(v, 2) OVER w AS v2 FROM {_SEVEN} s WINDOW w AS (PARTITION BY arena_id ORDER BY seq))"
)


@query(
    f"SELECT arena_id, seq, CASE WHEN step IN (2, 3) THEN 'free' WHEN step = 6 THEN 'get' ELSE 'allocate' END AS op, slot // 4 AS chunk_index, slot % 4 AS block_index,"
    f" CASE WHEN step IN (2, 3) THEN v2 WHEN step = 6 THEN v1 END AS result, true AS found FROM {_SLOTS} x"
)
def arena_replay_reuse(spark, sf_dir):
    """Allocations, frees and reads by turns: freed slots are taken again, the last one first."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = read(spark, sf_dir, "events").select("user_id", "event_id", n.alias("i")).withColumn("step", F.col("i") % 7)
    at = 2 * F.floor(F.col("i") / 7) + F.col("step").isin(1, 3, 4).cast("long")
    given = F.col("step").isin(2, 3, 6)
    op = F.when(F.col("step").isin(2, 3), "free").when(F.col("step") == 6, "get").otherwise("allocate")
    log = e.select(F.col("user_id").alias("arena_id"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").alias("value"), F.when(given, F.floor(at / 4)).cast("long").alias("chunk_index"), F.when(given, at % 4).cast("long").alias("block_index"))
    return arena_replay(log, chunk_size=4)


@query(f"SELECT p.arena_id, c AS chunk_index, CAST(1 AS BIGINT) AS block_index, v AS value, v IS NOT NULL AS found FROM (SELECT DISTINCT user_id AS arena_id, unnest([0, 1000000]) AS c FROM events) p LEFT JOIN {_SEVEN} s ON s.arena_id = p.arena_id AND s.i = 4 * c + 1")
def arena_get_slots(spark, sf_dir):
    """Reads of an occupied and of a vacant slot of each user's arena."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    held = read(spark, sf_dir, "events").select(F.col("user_id").alias("arena_id"), F.col("event_id").alias("value"), n.alias("i"))
    chunks = F.explode(F.array(F.lit(0).cast("long"), F.lit(1_000_000).cast("long"))).alias("chunk_index")
    probes = held.select("arena_id").distinct().select("arena_id", chunks, F.lit(1).cast("long").alias("block_index"))
    return arena_get(arena_append_slots(held, "i", 4), probes, ["arena_id"])


def _stacks(spark, sf_dir) -> DataFrame:
    op = F.when(F.col("event_type").isin("click", "error"), "pop").otherwise("push")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("stack_id"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").alias("value"))


_DEPTH = "s AS (SELECT user_id AS stack_id, event_id AS seq, event_type NOT IN ('click', 'error') AS push, sum(CASE WHEN event_type IN ('click', 'error') THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events), d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY stack_id ORDER BY seq)) AS depth FROM s), b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY stack_id ORDER BY seq), 0) AS before FROM d)"


@query(f"WITH {_DEPTH}, x AS (SELECT p.stack_id, p.seq, p.before > 0 AS found, max(q.seq) AS popped FROM b p LEFT JOIN b q ON q.stack_id = p.stack_id AND q.push AND q.seq < p.seq AND q.depth = p.before AND p.before > 0 WHERE NOT p.push GROUP BY ALL) SELECT stack_id, seq, popped, found FROM x")
def stack_pops(spark, sf_dir):
    return stack_replay(_stacks(spark, sf_dir))


@query(f"WITH {_DEPTH} SELECT stack_id, CAST(arg_max(depth, seq) AS BIGINT) AS len, arg_max(depth, seq) = 0 AS is_empty FROM b GROUP BY stack_id")
def stack_lengths(spark, sf_dir):
    return stack_sizes(_stacks(spark, sf_dir))

