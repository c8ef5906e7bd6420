import importlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import OrderedMap, OrderedSet, asof, ceil, floor, longest_prefix, merge_ranges, overlap_join

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SCHEMA = "key long, value long"


def omap(spark, d):
    return OrderedMap(spark.createDataFrame(list(d.items()), SCHEMA))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def as_dict(m):
    return {r.key: r.value for r in m.df.collect()}


L, R = {1: 1, 2: 2, 3: 3}, {3: 5, 4: 4, 5: 5}


@pytest.mark.parametrize("op,want", [("union", {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}), ("intersection", {3: 3}), ("difference", {1: 1, 2: 2}), ("symmetric_difference", {1: 1, 2: 2, 4: 4, 5: 5})])
def test_set_algebra(spark, op, want):
    assert as_dict(getattr(omap(spark, L), op)(omap(spark, R))) == want


def test_left_tail_after_right_ends(spark):
    a, b = omap(spark, {1: 1, 9: 9}), omap(spark, {2: 2})
    assert as_dict(a - b) == {1: 1, 9: 9} and as_dict(a + b) == {1: 1, 2: 2, 9: 9} and as_dict(a ^ b) == {1: 1, 2: 2, 9: 9} and as_dict(a & b) == {}


def test_different_key_names(spark):
    a = omap(spark, L)
    b = OrderedMap(spark.createDataFrame(list(R.items()), "k2 long, value long"), "k2")
    assert as_dict(a.union(b)) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5} and as_dict(a.symmetric_difference(b)) == {1: 1, 2: 2, 4: 4, 5: 5}


def test_split(spark):
    m = omap(spark, L)
    assert [as_dict(x) for x in m.split_off(2, True)] == [{1: 1, 2: 2}, {3: 3}]
    assert [as_dict(x) for x in m.split_off(2, False)] == [{1: 1}, {2: 2, 3: 3}]
    a, b = m.split_off(2, True)
    assert as_dict(a.concat_disjoint(b)) == L
    with pytest.raises(ValueError):
        b.concat_disjoint(a)


def test_floor_ceil_min_max(spark):
    m = omap(spark, {1: 1, 3: 3, 5: 5})
    q = spark.createDataFrame([(0,), (2,), (4,), (6,), (None,), (3,), (3,)], "q long")
    assert rows(m.floor(q)) == sorted([(0, None), (2, 1), (4, 3), (6, 5), (None, None), (3, 3), (3, 3)], key=str)
    assert rows(m.ceil(q)) == sorted([(0, 1), (2, 3), (4, 5), (6, None), (None, None), (3, 3), (3, 3)], key=str)
    assert (m.min(), m.max(), m.floor_key(4), m.ceil_key(4), m.floor_key(0)) == (1, 5, 3, 5, None)
    e = m.clear()
    assert (e.min(), e.max(), e.len(), e.is_empty()) == (None, None, 0, True)
    assert rows(e.floor(q)) == sorted([(x, None) for x in (0, 2, 4, 6, None, 3, 3)], key=str)
    assert m.floor(q.limit(0)).count() == 0
    assert as_dict(e.insert(m.df)[0]) == {1: 1, 3: 3, 5: 5}


def test_insert_and_remove(spark):
    m = omap(spark, {1: 1})
    new, old = m.insert(spark.createDataFrame([(1, 3)], SCHEMA))
    assert as_dict(new) == {1: 3} and rows(old) == [(1, 1)]
    new, old = m.remove(spark.createDataFrame([(1,), (1,), (7,), (None,)], "key long"))
    assert as_dict(new) == {} and rows(old) == [(1, 1)]
    batch = spark.createDataFrame([(1, 10, 1), (1, 30, 3), (1, 20, 2), (2, None, 1), (None, 9, 1)], SCHEMA + ", seq long")
    assert as_dict(m.insert(batch, order=["seq"])[0]) == {1: 30, 2: None}
    s, had = OrderedSet.from_rows(spark.createDataFrame([(1,), (1,), (2,)], "key long")).insert(spark.createDataFrame([(2,), (3,), (3,)], "key long"))
    assert rows(s.df) == [(1,), (2,), (3,)] and rows(had) == [(2,)]


def test_null_value_is_not_missing(spark):
    m = omap(spark, {1: None, 2: 5})
    q = spark.createDataFrame([(1,), (2,), (3,)], "key long")
    assert rows(m.get(q)) == [(1, None, True), (2, 5, True), (3, None, False)]
    assert rows(m.contains(q)) == [(1, True), (2, True), (3, False)]
    assert m.contains_key(1) and not m.contains_key(3) and rows(m.get_key(1)) == [(None,)] and rows(m.get_key(3)) == []
    with pytest.raises(Exception, match="no such key"):
        m.index(q).collect()
    assert rows(m.index(q.where("key < 3"))) == [(1, None), (2, 5)]
    assert as_dict(m.update_at(spark.createDataFrame([(2, None), (9, 9)], SCHEMA))) == {1: None, 2: None}


def test_update_scan_rank(spark):
    m = omap(spark, {1: 2, 3: 4, 5: 6})
    assert as_dict(m.update(F.col("value") + 1)) == {1: 3, 3: 5, 5: 7}
    assert [tuple(r) for r in omap(spark, {1: 2, 5: 6, 3: 4}).scan().collect()] == [(1, 2), (3, 4), (5, 6)]
    assert rows(m.ranked(ranges=2)) == [(1, 2, 0), (3, 4, 1), (5, 6, 2)]
    assert m.ranked().where("1 = 0").count() == 0 and m.clear().ranked().count() == 0
    with pytest.raises(ValueError):
        m.update(F.lit(1), "key")
    with pytest.raises(TypeError):
        OrderedMap(spark.createDataFrame([(1.0, 2)], "key double, value long"))
    assert as_dict(OrderedMap.empty(spark, SCHEMA)) == {}


def test_random_maps(spark):
    rnd = random.Random(1)
    model, m = {}, OrderedMap.empty(spark, SCHEMA)
    for step in range(4):
        batch = [(rnd.randint(0, 300), rnd.randint(0, 9), i) for i in range(300)]
        m, old = m.insert(spark.createDataFrame(batch, SCHEMA + ", seq long"), order=["seq"])
        assert dict(rows(old)) == {k: model[k] for k, _, _ in batch if k in model}
        model |= {k: v for k, v, _ in batch}
        gone = [rnd.randint(0, 300) for _ in range(60)]
        m, old = m.remove(spark.createDataFrame([(g,) for g in gone], "key long"))
        assert dict(rows(old)) == {k: model[k] for k in gone if k in model}
        model = {k: v for k, v in model.items() if k not in gone}
        m.df = spark.createDataFrame(m.df.collect(), SCHEMA)
        assert as_dict(m) == model and m.len() == len(model)
        assert [r.rank for r in m.ranked(ranges=5).orderBy("key").collect()] == list(range(len(model)))


@few
@given(st.lists(st.integers(-50, 50), max_size=30), st.lists(st.one_of(st.none(), st.integers(-60, 60)), max_size=30), st.integers(1, 6), st.booleans())
def test_asof_model(spark, keys, probes, ranges, forward):
    got = asof(spark.createDataFrame([(p,) for p in probes], "q long"), spark.createDataFrame([(k,) for k in keys], "key long"), direction="forward" if forward else "backward", ranges=ranges)
    want = [(p, None if p is None else (min((k for k in keys if k >= p), default=None) if forward else max((k for k in keys if k <= p), default=None))) for p in probes]
    assert rows(got) == sorted(want, key=str)


def test_asof_strings(spark):
    got = asof(spark.createDataFrame([("b",), ("",)], "q string"), spark.createDataFrame([("a",), ("c",)], "key string"), ranges=3)
    assert rows(got) == [("", None), ("b", "a")]


def lcp(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def documented(keys, q):
    m = max((lcp(k, q) for k in keys), default=0)
    return {k for k in keys if m and lcp(k, q) == m}


def trie(keys, q):
    """A compressed trie, walked: a node for each key and for each place where keys part; the root always is one."""
    if not keys:
        return set()
    m = max(lcp(k, q) for k in keys)
    near = {k for k in keys if lcp(k, q) == m}
    after = {k[m : m + 1] for k in near if len(k) > m}
    node = m == 0 or q[:m] in keys or len(after) > 1
    return ({q[:m]} & keys) if m < len(q) and node else near


@pytest.mark.parametrize("keys,q,want", [
    ("aaaa", "aaa", "aaaa"), ("aaaa aaab", "aaa", "aaaa aaab"), ("aaa aaaa aaab", "aaa", "aaa aaaa aaab"), ("aa", "aaa", "aa"), ("aaba aabb", "aaa", "aaba aabb"), ("b", "aaa", ""), ("foo foobar", "foob", "foobar"), ("foo foobar", "fooz", "foo foobar"), ("foa fob", "foz", "foa fob"),
])
def test_prefix_golden(spark, keys, q, want):
    got = longest_prefix(spark.createDataFrame([(q.encode(),)], "q binary"), spark.createDataFrame([(k.encode(),) for k in keys.split()], "key binary"))
    assert {bytes(r.key).decode() for r in got.collect()} == set(want.split())


@few
@given(st.sets(st.binary(max_size=4).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=14), st.sets(st.binary(max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=8), st.sampled_from(["documented", "trie"]))
def test_prefix_model(spark, keys, probes, mode):
    got = longest_prefix(spark.createDataFrame([(q,) for q in probes], "q binary"), spark.createDataFrame([(k,) for k in keys], "key binary"), mode=mode)
    want = {(q, k) for q in probes for k in (documented if mode == "documented" else trie)(keys, q)}
    assert {(bytes(r.q), bytes(r.key)) for r in got.collect()} == want


def test_trie_mode_golden(spark):
    f = lambda keys, q: {bytes(r.key).decode() for r in longest_prefix(spark.createDataFrame([(q.encode(),)], "q binary"), spark.createDataFrame([(k.encode(),) for k in keys.split()], "key binary"), mode="trie").collect()}
    assert f("foo foobar", "fooz") == {"foo"} and f("foa fob", "foz") == set() and f("foo foobar", "foob") == {"foobar"}


@few
@given(st.lists(st.tuples(st.integers(-40, 40), st.integers(-3, 60)), max_size=15), st.lists(st.tuples(st.integers(-40, 40), st.integers(-3, 300)), max_size=15))
def test_overlap_model(spark, a, b):
    make = lambda rs: spark.createDataFrame([(i, lo, lo + n) for i, (lo, n) in enumerate(rs)] + [(99, None, 5)], "id long, lo long, hi long")
    got = [(r.a.id, r.b.id) for r in overlap_join(make(a), make(b)).collect()]
    want = [(i, j) for i, (x, n) in enumerate(a) for j, (y, m) in enumerate(b) if n >= 0 and m >= 0 and max(x, y) <= min(x + n, y + m)]
    assert sorted(got) == sorted(want)


def test_merge_ranges(spark):
    df = spark.createDataFrame([(1, 5), (3, 9), (-2, 0)], "lo long, hi long")
    assert rows(merge_ranges(df)) == [(-2, 9)]


def test_repeated_keys_in_a_batch(spark):
    m = OrderedMap(spark.createDataFrame([(1, 1), (3, 3)], "key long, value long"))
    new, old = m.insert(spark.createDataFrame([(2, 1), (2, 5), (1, None), (None, 7)], "key long, value long"))
    assert sorted((r.key, r.value) for r in new.df.collect()) == [(1, None), (2, 5), (3, 3)] and [tuple(r) for r in old.collect()] == [(1, 1)]
    changed = m.update_at(spark.createDataFrame([(1, 4), (1, 9), (1, None), (8, 8)], "key long, value long"))
    assert sorted(tuple(r) for r in changed.df.collect()) == [(1, 9), (3, 3)]


def test_probes_with_clashing_columns(spark):
    m = OrderedMap(spark.createDataFrame([(1, 10), (5, None)], "key long, value long"))
    probes = spark.createDataFrame([(1, "a", "b", "c", "d", 0), (5, "a", "b", "c", "d", 0), (9, "a", "b", "c", "d", 0), (None, "a", "b", "c", "d", 0)], "key long, found string, value string, _p string, hit string, at int")
    got = sorted(m.get(probes).collect(), key=str)
    assert sorted((r.key or 0, r.value or 0, r.found) for r in got) == [(0, 0, False), (1, 10, True), (5, 0, True), (9, 0, False)] and all((r._p, r.hit, r.at) == ("c", "d", 0) for r in got)
    assert sorted((r.key or 0, r.found) for r in m.contains(probes).collect()) == [(0, False), (1, True), (5, True), (9, False)]
    assert sorted((r.key or 0, r.found or 0, r.value) for r in m.floor(probes, "key").collect()) == [(0, 0, "b"), (1, 1, "b"), (5, 5, "b"), (9, 5, "b")]


def test_bounds_of_one_hot_key(spark):
    """Half of all rows have one key: the driver sees a key once, and no more of them than stated."""
    module = importlib.import_module("tidemark.operators.asof")

    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    seen = []
    collect = type(df).collect
    try:
        type(df).collect = lambda self: seen.append(collect(self)) or seen[-1]
        bounds = module.range_bounds(df, "k", 8)
    finally:
        type(df).collect = collect
    assert max(map(len, seen)) <= 8 * module.SAMPLE and len(bounds) == 7 and bounds == sorted(bounds)
    assert 2000 < bounds[0] < 9000 and 31_000 < bounds[-1] < 38_000
    q = spark.createDataFrame([(6,), (7,), (8,), (39_999,)], "q long")
    assert sorted((r.q, r.found) for r in module.asof(q, df, key="k").collect()) == [(6, 5), (7, 7), (8, 7), (39_999, 39_999)]


def test_asof_deals_probes_beyond_the_keys(spark, monkeypatch):
    """Probes that lie after the last key, or that are very many, are no range of their own."""
    module, seen = importlib.import_module("tidemark.operators.asof"), []
    monkeypatch.setattr(module, "range_of", lambda bounds, *a, of=module.range_of: seen.append(bounds) or of(bounds, *a))
    monkeypatch.setattr(module, "ROWS", 1000)
    probes, keys = spark.range(10_000).select(F.col("id").alias("q")), spark.range(100).select(F.col("id").alias("key"))
    for f, want in ((floor, lambda q: min(q, 99)), (ceil, lambda q: q if q < 100 else None)):
        assert {r.q: r.found for r in f(probes, keys).collect()} == {q: want(q) for q in range(10_000)}
        cuts = [0, *seen.pop(), 10_000]
        assert len(cuts) > 9 and max(b - a for a, b in zip(cuts, cuts[1:])) < 2500
