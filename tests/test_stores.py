import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.plans import Files, Leveled, Manifest, Run, SizeTiered, ranges_overlap, register_strategy
from tidemark.plans.strategies import overlapping
from tidemark.sources import LogStore, SortedStore, live_view, run_summary
from tidemark.sources.log_store import latest_versions
from tidemark.streaming import latest_stream, write_stream

KV = "key long, value long"
STRATEGIES = [SizeTiered(10**9, 2, 200, 0.5, 1.5), Leveled(10**9, 1, 300, 2, 2)]


def kv(spark, d):
    return spark.createDataFrame(list(d.items()), KV)


def keys(spark, ks):
    return spark.createDataFrame([(k,) for k in ks], "key long")


def view(store):
    return {r.key: r.value for r in store.view().collect()}


@pytest.mark.parametrize("strategy", STRATEGIES, ids=["tiered", "leveled"])
def test_against_a_dict(spark, tmp_path, strategy):
    rnd, model = random.Random(1), {}
    path = f"file://{tmp_path}/s"
    store = LogStore.create(spark, path, "long", "long", strategy)
    assert view(LogStore.open(spark, path)) == {} and store.is_empty() and store.min() is None
    for step in range(7):
        rows = {rnd.randint(0, 60): rnd.choice([None, step]) for _ in range(25)}
        store.insert(kv(spark, rows))
        model |= rows
        gone = [rnd.randint(0, 60) for _ in range(10)]
        store.remove(keys(spark, gone))
        model = {k: v for k, v in model.items() if k not in gone}
        if step == 3:
            assert view(store) == model  # held batches are seen before a flush
        store.flush()
        assert view(store) == model and store.len_hint() >= store.len() == len(model)
    store = LogStore.open(spark, path)
    assert view(store) == model and (store.min(), store.max()) == (min(model), max(model))
    assert [r.key for r in store.scan().collect()] == sorted(model)
    probes = keys(spark, [*range(-2, 64)])
    assert {r.key: (r.value, r.found) for r in store.get(probes).collect()} == {k: (model.get(k), k in model) for k in range(-2, 64)}
    k = next(iter(model))
    assert [r.value for r in store.get_key(k).collect()] == [model[k]] and store.contains_key(k) and not store.contains_key(999)
    assert {r.key for r in store.contains(probes).where("found").collect()} == set(model)
    if isinstance(strategy, Leveled):
        for level in {r.level for r in store.manifest.runs if r.level >= 0}:
            here = sorted((r for r in store.manifest.runs if r.level == level), key=lambda r: r.key_min)
            assert all(a.key_max < b.key_min for a, b in zip(here, here[1:])) and len(here) <= 2 * 2**level
    snapshot, before = store.view(), dict(model)
    store.remove(keys(spark, model))
    store.flush()
    assert view(store) == {} and store.len() == 0
    assert {r.key: r.value for r in snapshot.collect()} == before
    assert store.collect_garbage(keep=[snapshot]) >= 0 and {r.key: r.value for r in snapshot.collect()} == before
    clock = store.manifest.logical_time
    store.insert(kv(spark, {1: 1}))
    store.clear()
    assert view(LogStore.open(spark, path)) == {} and store.manifest.logical_time > clock and store.collect_garbage() > 0
    with pytest.raises(FileExistsError):
        LogStore.create(spark, path, "long", "long", strategy)


def test_batch_order_and_spill(spark, tmp_path):
    store = LogStore.create(spark, f"file://{tmp_path}/s", "string", "array<long>", SizeTiered(200, 50, 10**9, 0.5, 1.5))
    store.insert(spark.createDataFrame([("a", [1], 1), ("a", [3], 3), ("a", [2], 2), (None, [9], 9)], "key string, value array<long>, seq long"), order=["seq"])
    assert not store.manifest.runs
    store.insert(spark.createDataFrame([(f"k{i}", [i] * 3) for i in range(20)], "key string, value array<long>"))
    assert len(store.manifest.runs) == 1 and store.manifest.runs[0].key_min == "a"
    assert store.get_key("a").head().value == [3] and store.len() == 21


def test_binary_keys_and_conflicts(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    a = LogStore.create(spark, path, "binary", "long", STRATEGIES[0])
    b = LogStore.open(spark, path)
    row = spark.createDataFrame([(b"\xff", 1), (b"", 2)], "key binary, value long")
    a.insert(row)
    a.flush()
    b.insert(spark.createDataFrame([(b"", 3)], "key binary, value long"))
    b.flush()  # behind what a committed meanwhile: neither is lost, and b's write is the newer one
    now = LogStore.open(spark, path)
    assert len(now.manifest.runs) == 2 and now.manifest.runs[0].key_max == b"\xff" and now.get_key(b"").head().value == 3 and now.get_key(b"\xff").head().value == 1
    assert now.manifest.runs[1].lt_min > now.manifest.runs[0].lt_max
    a.append_run(spark.createDataFrame([(b"", 4, False)], "key binary, value long, is_tombstone boolean"))
    assert len(a.manifest.runs) == 3 and a.get_key(b"").head().value == 4


def test_one_of_two_commits_wins(spark, tmp_path):
    """Many writers of one version: the file system lets one through."""
    files = Files(spark, f"file://{tmp_path}/m")
    files.mkdirs(files.root)
    from concurrent.futures import ThreadPoolExecutor

    def write(i):
        try:
            files.write_once(files.at("v"), str(i))
            return i
        except FileExistsError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [x for x in pool.map(write, range(24)) if x is not None]
    assert len(won) == 1 and files.read(files.at("v")) == str(won[0]) and files.names(files.root) == ["v"]


def test_garbage_leaves_what_is_being_written(spark, tmp_path):
    store = LogStore.create(spark, f"file://{tmp_path}/s", "long", "long", STRATEGIES[0])
    store.insert(kv(spark, {1: 1}))
    store.flush()
    filling = store.files.at("runs/filling")
    store.files.mkdirs(filling)
    assert store.collect_garbage() == 0 and store.files.exists(filling)
    assert store.collect_garbage(grace=-1) == 1 and view(store) == {1: 1}
    for i in range(6):
        store.insert(kv(spark, {i: i}))
        store.flush()
    store.collect_garbage(versions=3)
    assert len(Manifest.versions(store.files)) == 3 and view(LogStore.open(spark, store.files.root)) == {i: i for i in range(6)}


class Never:
    max_in_memory_size = 10

    def next_job(self, runs):
        return None

    def params(self):
        return {"kind": "never"}


def test_strategies_of_ones_own(spark, tmp_path):
    register_strategy("never", Never)
    path = f"file://{tmp_path}/s"
    store = LogStore.create(spark, path, "long", "long", Never())
    for i in range(3):
        store.insert(kv(spark, {i: i}))
    store = LogStore.open(spark, path)
    assert isinstance(store.strategy, Never) and len(store.manifest.runs) == 3 and store.compact() == 0


def test_compaction_keeps_runs_flushed_meanwhile(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    a = LogStore.create(spark, path, "long", "long", SizeTiered(10**9, 50, 10**6, 0.5, 1.5))
    for i in range(3):
        a.insert(kv(spark, {i: i, 9: i}))
        a.flush()
    job = SizeTiered(0, 2, 10**6, 0.5, 1.5).next_job(a.manifest.runs)
    b = LogStore.open(spark, path)
    b.insert(kv(spark, {9: 99, 50: 50}))
    b.flush()
    a._run(job)
    assert len(a.manifest.runs) == 2 and view(LogStore.open(spark, path)) == {0: 0, 1: 1, 2: 2, 9: 99, 50: 50}
    a._run(job)  # its inputs are gone by now
    assert view(LogStore.open(spark, path)) == {0: 0, 1: 1, 2: 2, 9: 99, 50: 50}


def run(size, lo, hi, t, tomb=0, level=-1, n=10):
    return Run(f"r{lo}-{hi}-{t}", n, tomb, size, lo, hi, t, t, level)


def test_size_tiered_rules():
    s = SizeTiered(0, 2, 50, 0.5, 1.5)
    small = [run(10, i * 10, i * 10 + 5, i) for i in range(3)]
    assert set(s.bucket(tuple(small))) == set(small) and s.bucket(tuple(small[:2])) == ()
    far = run(10_000, 500, 600, 9)
    assert set(s.bucket((*small[:2], far))) == {*small[:2], far}  # the run that breaks the bucket counts
    # averages include the run at hand, and a bucket too small to merge goes with the run that breaks it
    sizes = SizeTiered(0, 4, 4000, 0.5, 1.5)
    one = [run(x, i, i, i) for i, x in enumerate((11_461, 12_019, 17_725, 18_885, 35_562))]
    assert [r.size for r in sizes.bucket(tuple(one))] == [11_461, 12_019, 17_725, 18_885, 35_562]
    broken = [run(x, i, i, i) for i, x in enumerate((10_000, 100_000, 1_000_000, 1_000_001, 1_000_002, 1_000_003))]
    assert sizes.bucket(tuple(broken)) == () and [r.size for r in SizeTiered(0, 3, 4000, 0.5, 1.5).bucket(tuple(broken))] == [1_000_000, 1_000_001, 1_000_002, 1_000_003]
    some = (*small, run(10_000, 20, 30, 3))
    job = s.next_job((*some, run(10**6, 100, 200, 50)))
    assert set(job.inputs) == set(some) and job.drop_tombstones  # the rest is newer and has other keys
    assert not s.next_job((*some, run(10**6, 0, 200, 50))).drop_tombstones and not s.next_job((*some, run(10**6, 100, 200, 0))).drop_tombstones
    assert s.next_job(()) is None


def test_leveled_rules():
    s = Leveled(0, 1, 100, 1, 2)
    job = s.next_job((run(1, 0, 9, 5), run(1, 0, 9, 6), run(1, 0, 9, 1, level=0), run(1, 0, 5, 0, level=1)))
    assert len(job.inputs) == 3 and job.level == 0 and not job.drop_tombstones
    assert s.next_job((run(1, 0, 9, 5), run(1, 0, 9, 6))).drop_tombstones
    three = (run(1, 0, 4, 5, tomb=1, level=0), run(1, 5, 9, 5, tomb=3, level=0), run(1, 10, 14, 5, tomb=3, level=0))
    assert s.next_job(three).inputs == (three[2], three[1]) and s.next_job(three).move  # all that are too many, at once
    zero = (run(1, 0, 4, 5, tomb=1, level=0), run(1, 5, 9, 5, tomb=3, level=0))
    job = s.next_job(zero)
    assert job.move and job.level == 1 and job.inputs == (zero[1],)
    job = s.next_job((*zero, run(1, 8, 20, 1, level=1), run(1, 30, 40, 1, level=1)))
    assert not job.move and [r.key_min for r in job.inputs] == [5, 8] and job.drop_tombstones
    assert s.next_job(zero[:1]) is None
    assert ranges_overlap(run(1, 0, 5, 0), run(1, 5, 6, 0)) and not ranges_overlap(run(1, 0, 4, 0), run(1, 5, 6, 0))


def test_log_functions(spark):
    log = spark.createDataFrame([(1, 5, False, 1), (1, None, True, 3), (1, 6, False, 2), (2, None, False, 9), (3, 1, False, 4), (3, None, True, 1)], "key long, value long, is_tombstone boolean, logical_time long")
    assert {tuple(r) for r in live_view(log).collect()} == {(2, None), (3, 1)}
    assert latest_versions(log).count() == 3
    s = run_summary(log).head()
    assert (s.entry_count, s.tombstone_count, s.key_min, s.key_max, s.lt_min, s.lt_max) == (6, 2, 1, 3, 1, 9)


def test_strategies_take_a_step_for_each_run():
    """Sums of a bucket and overlaps of very many runs; with a sum over the bucket for each run this took half a minute."""
    rnd = random.Random(3)
    runs = tuple(run(rnd.randint(2000, 2400), i, i + 5, i) for i in range(20_000))
    began = time.perf_counter()
    s = SizeTiered(0, 4, 0, 0.5, 1.5)
    assert s.bucket(runs) == tuple(s.order(runs)) and set(s.next_job(runs).inputs) == set(runs)
    halves = [Run(f"{i}", 1, 0, 1, 2 * i, 2 * i + 1, 0, 0, level) for level, n in ((0, 10_000), (1, 10_000)) for i in range(n)]
    assert len(Leveled(0, 1, 1, 1, 2).next_job(tuple(halves)).inputs) == 2 * 9_999
    assert time.perf_counter() - began < 5


def test_leveled_passes_levels_at_once():
    """Runs too many for their level go to the first one with room, with all that overlaps them on the way, in one merge."""
    s = Leveled(0, 1, 100, 3, 2)
    here = [run(100, 10 * i, 10 * i + 5, 9, level=0) for i in range(200)]
    below = [run(100, 300 * n + 7, 300 * n + 8 * 2**n, n, level=n) for n in range(1, 7)]  # each overlaps some of them
    last = run(100, 5000, 5009, 0, level=8)
    job = s.next_job((*here, *below, last))
    assert job.level == 7 and not job.move and not job.drop_tombstones and set(below) < set(job.inputs) and len(job.inputs) == 197 + 6
    assert s.next_job((*here, *below)).drop_tombstones
    flat = Leveled(0, 1, 100, 1, 1)  # no level ever has room: a new one is next
    assert flat.next_job(tuple(here)).level == 1


def test_runs_are_as_small_as_their_keys(spark, tmp_path, monkeypatch):
    """Many runs of a merge: their Bloom filters are no larger than their keys ask for, and they are read by their folder."""
    monkeypatch.setattr("tidemark.sources.log_store.FEW_PATHS", 2)
    store = LogStore.create(spark, f"file://{tmp_path}/s", "long", "long", Leveled(10**9, 1, 2000, 3, 2))
    for i in range(4):
        store.append_run(spark.range(1500).select(F.col("id").alias("key"), F.lit(i).cast("long").alias("value"), (F.col("id") % 7 == i).alias("is_tombstone")))
        store.compact()
    made = [r for r in store.manifest.runs if r.level >= 0]
    sizes = [f.stat().st_size for f in (tmp_path / "s" / "runs").rglob("*.parquet")]
    assert len(made) > 8 and max(sizes) < 40_000
    assert view(store) == {k: 3 for k in range(1500) if k % 7 != 3} and view(LogStore.open(spark, store.files.root)) == view(store)
    assert store.get(keys(spark, range(3, 700, 100))).where("found").count() == len([k for k in range(3, 700, 100) if k % 7 != 3])
    some = made[::2]
    assert store._read(some).count() == sum(r.entry_count for r in some)


def test_overlapping_is_ranges_overlap():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ([run(1, *(sorted(rnd.choices(range(12), k=2)) if rnd.random() < 0.9 else (None, None)), 0) for _ in range(rnd.randint(0, 6))] for _ in range(2))
        assert overlapping(a, b) == [any(ranges_overlap(x, y) for y in b) for x in a]


@pytest.mark.parametrize("rows,literal", [(7, 1000), (7, 0), (1000, 1000)])
def test_sorted_store(spark, tmp_path, monkeypatch, rows, literal):
    monkeypatch.setattr("tidemark.sources.sorted_store.LITERAL_RANGES", literal)
    rnd, model, path = random.Random(2), {}, f"file://{tmp_path}/b"
    store = SortedStore.with_degrees(spark, path, "long", "long", 8, 8, 3, 3, rows=rows)
    assert store.is_empty() and store.min() is None and store.remove(keys(spark, [1])).count() == 0
    for _ in range(4):
        batch = {rnd.randint(0, 99): rnd.randint(0, 9) for _ in range(25)}
        old = store.insert(kv(spark, batch))
        model_old = {k: model[k] for k in batch if k in model}
        model |= batch
        assert {r.key: r.value for r in old.collect()} == model_old
        gone = [rnd.randint(0, 99) for _ in range(12)]
        removed = store.remove(keys(spark, gone))
        assert {r.key for r in removed.collect()} == {k for k in gone if k in model}
        model = {k: v for k, v in model.items() if k not in gone}
        store = SortedStore.open(spark, path)
        assert [(r.key, r.value) for r in store.scan().collect()] == sorted(model.items()) and store.len() == len(model)
        assert (store.min(), store.max()) == (min(model), max(model))
    k = next(iter(model))
    assert store.get_key(k).head().value == model[k] and store.contains_key(k) and not store.contains_key(1000)
    assert {r.key for r in store.contains(keys(spark, [k, -5])).where("found").collect()} == {k} and store.get(keys(spark, [k])).head().value == model[k]
    assert store.range_for(-1) == 0
    store.clear()
    assert SortedStore.open(spark, path).is_empty()


def test_sorted_store_sizes(spark, tmp_path):
    store = SortedStore.create(spark, f"file://{tmp_path}/b", "long", "array<int>", 8, 16)
    store.insert(spark.createDataFrame([(1, [1, 2]), (2, [])], "key long, value array<int>"))
    with pytest.raises(Exception, match="more than 16 bytes"):
        store.insert(spark.createDataFrame([(3, [1, 2, 3])], "key long, value array<int>"))
    assert store.len() == 2
    with pytest.raises(ValueError):
        SortedStore.with_degrees(spark, f"file://{tmp_path}/c", "long", "long", 2000, 2000, 2, 2)
    big = SortedStore.create(spark, f"file://{tmp_path}/d", "long", "decimal(20,0)", 8, 8)
    big.insert(spark.createDataFrame([(1, __import__("decimal").Decimal(2**64 - 1))], "key long, value decimal(20,0)"))
    assert int(big.get_key(1).head().value) == 2**64 - 1


def test_manifest_round_trip(spark, tmp_path):
    import datetime
    import decimal

    files = Files(spark, f"file://{tmp_path}/m")
    with pytest.raises(FileNotFoundError):
        Manifest.load(files)
    for k in (b"\x00\xff", "x", 5, datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 2, 3), decimal.Decimal("1.5"), None):
        m = Manifest("{}", {"kind": "x"}).with_runs([Run("p", 1, 0, 9, k, k, 0, 1)])
        files = Files(spark, f"file://{tmp_path}/{abs(hash(str(k)))}")
        assert Manifest.load(files) == m if m.commit(files) else False


def test_streams(spark, tmp_path):
    schema = "key long, value long, is_tombstone boolean, logical_time long"
    src = f"{tmp_path}/src"
    batches = [[(1, 1, False, 1), (2, 2, False, 2), (1, 9, False, 3)], [(2, None, True, 5)], [(3, 3, False, 4), (2, 7, False, 2)]]
    for i, b in enumerate(batches[:2]):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
    store = LogStore.create(spark, f"file://{tmp_path}/s", "long", "long", STRATEGIES[0])
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    write_stream(read(), store, f"{tmp_path}/c", "q", ["logical_time"]).awaitTermination()
    assert view(store) == {1: 9} and view(LogStore.open(spark, f"file://{tmp_path}/s")) == {1: 9}
    assert not store.append_run(spark.createDataFrame(batches[0], schema), "q", 0)  # counted already
    spark.createDataFrame(batches[2], schema).coalesce(1).write.mode("append").parquet(src)
    q = latest_stream(read()).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.key: (r.value, r.is_tombstone) for r in spark.table("newest").collect()}
    assert got == {1: (9, False), 2: (None, True), 3: (3, False)}
