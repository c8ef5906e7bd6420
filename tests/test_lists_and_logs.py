import random

import pytest
from pyspark.sql import functions as F

from tidemark import functions as T
from tidemark.operators import ListTable, arena_append_slots, arena_get, arena_replay, stack_replay, stack_sizes

ROWS = "list_id long, pos long, value long"


def table(spark, lists):
    return ListTable(spark.createDataFrame([(k, i, v) for k, vs in lists.items() for i, v in enumerate(vs)], ROWS))


def lists(t):
    out = {}
    for r in t.df.orderBy("list_id", "pos").collect():
        assert r.pos == len(out.setdefault(r.list_id, []))
        out[r.list_id].append(r.value)
    return out


def edits(spark, rows, cols="list_id long, index long, value long"):
    return spark.createDataFrame(rows, cols)


def test_golden_concat(spark):
    n, m = ListTable(spark.createDataFrame([], ROWS)), ListTable(spark.createDataFrame([], ROWS))
    for i, v in ((0, 1), (0, 2), (1, 3)):
        n = n.insert(edits(spark, [(0, i, v)]))
    for i, v in ((0, 4), (0, 5), (1, 6)):
        m = m.insert(edits(spark, [(0, i, v)]))
    both = n + m
    assert lists(both) == {0: [2, 3, 1, 5, 6, 4]} and both.len().head().len == 6
    assert [tuple(r) for r in both.arrays().collect()] == [(0, [2, 3, 1, 5, 6, 4])]


def test_ends(spark):
    t = table(spark, {7: [1]})
    one = spark.createDataFrame([(7, 2)], "list_id long, value long")
    assert lists(t.push_front(one)) == {7: [2, 1]} and lists(t.push_back(one)) == {7: [1, 2]}
    pair = table(spark, {7: [1, 2]})
    left, got = pair.pop_front(one)
    assert lists(left) == {7: [2]} and got.head().value == 1
    left, got = pair.pop_back(one)
    assert lists(left) == {7: [1]} and got.head().value == 2
    assert lists(table(spark, {}).push_back(one)) == {7: [2]} and table(spark, {}).is_empty() and pair.clear().is_empty()


def test_positions_from_distances(spark):
    df = spark.createDataFrame([(1, 0, 1, 10), (1, 1, 2, 11), (1, 2, 1, 12)], "l long, o long, d long, v long")
    assert sorted(tuple(r) for r in ListTable.from_distances(df, "l", ["o"], "d", "v").df.collect()) == [(1, 0, 10), (1, 1, 11), (1, 3, 12)]


def test_out_of_range(spark):
    t = table(spark, {7: [1, 2]})
    none = spark.createDataFrame([(8,)], "list_id long")
    for bad in (t.insert(edits(spark, [(7, 3, 0)])), t.remove(edits(spark, [(7, 2, 0)]))[0], t.set(edits(spark, [(7, -1, 0)])), t.push_back(none.selectExpr("list_id", "1 as value")).pop_front(none.selectExpr("9L as list_id"))[0]):
        with pytest.raises(Exception, match="out of range"):
            bad.df.collect()
            raise AssertionError(bad.df.collect())


def test_random_edits(spark):
    rnd = random.Random(3)
    model = {k: [rnd.randint(0, 9) for _ in range(rnd.randint(1, 6))] for k in range(5)}
    t = table(spark, model)
    for _ in range(4):
        ins = [(k, rnd.randint(0, len(v)), 100 + rnd.randint(0, 9)) for k, v in model.items()]
        t = t.insert(edits(spark, ins))
        for k, i, v in ins:
            model[k].insert(i, v)
        rem = [(k, rnd.randrange(len(v)), 0) for k, v in model.items() if k % 2]
        t, got = t.remove(edits(spark, rem))
        assert sorted((r.list_id, r.value) for r in got.collect()) == sorted((k, model[k].pop(i)) for k, i, _ in rem)
        put = [(0, rnd.randrange(len(model[0])), None)]
        t = t.set(edits(spark, put))
        model[0][put[0][1]] = None
        t = ListTable(spark.createDataFrame(t.df.collect(), ROWS))
        assert lists(t) == {k: v for k, v in model.items() if v}
    left, right = t.split(edits(spark, [(k, 2, 0) for k in model]))
    assert lists(left) == {k: v[:2] for k, v in model.items() if v[:2]} and lists(right) == {k: v[2:] for k, v in model.items() if v[2:]}
    got = {(r.list_id, r["index"]): (r.value, r.found) for r in t.get(edits(spark, [(0, put[0][1], 0), (0, 99, 0)])).collect()}
    assert got == {(0, put[0][1]): (None, True), (0, 99): (None, False)}
    with pytest.raises(Exception, match="out of range"):
        t.index(edits(spark, [(0, 99, 0)])).collect()


def test_array_functions(spark):
    a = F.array(F.lit(1), F.lit(2), F.lit(3))
    v, i = F.lit(9), F.lit
    got = spark.range(1).select(
        T.array_insert_at(a, i(0), v), T.array_insert_at(a, i(3), v), T.array_remove_at(a, i(1)), T.array_push_front(a, v), T.array_push_back(a, v), T.array_pop_front(a), T.array_pop_back(a),
        T.array_get(a, i(3)), T.array_index(a, i(2)), T.array_set(a, i(1), v), T.array_concat(a, a), T.array_split(a, i(1)), T.array_split(a, i(1), True), T.array_remove_at(a, i(0)), T.array_remove_at(a, i(2)),
    ).head()
    assert [list(x) if isinstance(x, list) else x for x in got[:5]] == [[9, 1, 2, 3], [1, 2, 3, 9], [1, 3], [9, 1, 2, 3], [1, 2, 3, 9]]
    assert tuple(got[5]) == (1, [2, 3]) and tuple(got[6]) == (3, [1, 2]) and got[7] is None and got[8] == 3
    assert got[9] == [1, 9, 3] and got[10] == [1, 2, 3, 1, 2, 3] and tuple(got[11]) == ([1], [2, 3]) and tuple(got[12]) == ([1, 2], [3])
    assert got[13] == [2, 3] and got[14] == [1, 2]
    none = F.array().cast("array<int>")
    for bad in (T.array_insert_at(a, i(4), v), T.array_remove_at(a, i(3)), T.array_index(a, i(-1)), T.array_set(a, i(3), v), T.array_pop_front(none), T.array_pop_back(none)):
        with pytest.raises(Exception, match="index|empty"):
            spark.range(1).select(bad).collect()


ARENA = "arena_id long, seq long, op string, value long, chunk_index long, block_index long"


def test_arena_golden(spark):
    alloc = lambda n: [(0, i, "allocate", i, None, None) for i in range(n)]
    slots = lambda rows, size: [(r.chunk_index, r.block_index) for r in arena_replay(spark.createDataFrame(rows, ARENA), chunk_size=size).orderBy("seq").collect()]
    assert slots(alloc(3), 1024) == [(0, 0), (0, 1), (0, 2)] and slots(alloc(3), 2) == [(0, 0), (0, 1), (1, 0)]
    assert slots([(0, 0, "allocate", 1, None, None), (0, 1, "free", None, 0, 0), (0, 2, "allocate", 2, None, None)], 2) == [(0, 0)] * 3
    got = [(r.chunk_index, r.block_index) for r in arena_append_slots(spark.range(3).toDF("seq"), "seq", 2).orderBy("seq").collect()]
    assert got == [(0, 0), (0, 1), (1, 0)]
    with pytest.raises(Exception, match="vacant"):
        slots([(0, 0, "free", None, 0, 0)], 2)


def test_arena_model(spark):
    rnd, log, want = random.Random(5), [], []
    for arena in range(4):
        live, free, size = {}, [], 0
        for seq in range(150):
            op = rnd.choice(["allocate", "allocate", "free", "get"])
            if op == "allocate":
                slot = free.pop() if free else divmod(size, 3)
                size += slot == divmod(size, 3) and slot not in live
                live[slot] = rnd.choice([None, seq])
                log.append((arena, seq, op, live[slot], None, None))
                want.append((arena, seq, *slot, None, True))
            elif op == "free" and live:
                slot = rnd.choice(list(live))
                free.append(slot)
                log.append((arena, seq, op, None, *slot))
                want.append((arena, seq, *slot, live.pop(slot), True))
            elif op == "get":
                slot = divmod(rnd.randint(0, 20), 3)
                log.append((arena, seq, op, None, *slot))
                want.append((arena, seq, *slot, live.get(slot), slot in live))
    rnd.shuffle(log)
    got = [(r.arena_id, r.seq, r.chunk_index, r.block_index, r.result, r.found) for r in arena_replay(spark.createDataFrame(log, ARENA), chunk_size=3).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    slots = spark.createDataFrame([(0, 1, 5)], "chunk_index long, block_index long, value long")
    assert {tuple(r) for r in arena_get(slots, spark.createDataFrame([(0, 1), (2, 2)], "chunk_index long, block_index long")).collect()} == {(0, 1, 5, True), (2, 2, None, False)}


def test_stack_model(spark):
    rnd, log, pops, sizes = random.Random(6), [(9, 0, "push", 0), (9, 1, "push", 1), (9, 2, "pop", None), (9, 3, "pop", None), (9, 4, "pop", None)], [(9, 2, 1, True), (9, 3, 0, True), (9, 4, None, False)], {9: 0}
    for s in range(6):
        stack = []
        for seq in range(80):
            if rnd.random() < 0.5:
                v = rnd.choice([None, seq])
                stack.append(v)
                log.append((s, seq, "push", v))
            else:
                pops.append((s, seq, stack[-1] if stack else None, bool(stack)))
                stack and stack.pop()
                log.append((s, seq, "pop", None))
        sizes[s] = len(stack)
    df = spark.createDataFrame(log, "stack_id long, seq long, op string, value long")
    assert sorted((tuple(r) for r in stack_replay(df).collect()), key=str) == sorted(pops, key=str)
    assert {r.stack_id: (r.len, r.is_empty) for r in stack_sizes(df).collect()} == {k: (n, n == 0) for k, n in sizes.items()}
