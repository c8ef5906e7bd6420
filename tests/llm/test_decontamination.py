import random

import numpy as np

from tidemark.llm import decontamination as D


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] >= 0 else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    rnd = random.Random(1)
    for _ in range(200):
        a = [rnd.randint(0, 4) for _ in range(rnd.randint(1, 15))]
        b = [rnd.randint(-1, 4) for _ in range(rnd.randint(1, 25))]
        assert D.align(np.array(a), np.array(b))[0] == brute_align(a, b)


def words(rnd, n, size=400):
    return [f"w{int(rnd.paretovariate(0.6)) % size}" for _ in range(n)]


def test_against_brute_force(spark, monkeypatch):
    """Every item against every text, in full."""
    rnd = random.Random(2)
    items = [(i, words(rnd, rnd.randint(12, 40))) for i in range(25)] + [(90, ["only"]), (91, ["two", "words"]), (92, [])]
    docs = []
    for i in range(180):
        w = words(rnd, rnd.randint(0, 120))
        if i % 3 == 1 and i > 60:  # copies that are edited to near the threshold
            part = list(rnd.choice(items[:25])[1])
            for _ in range(len(part) // 3):
                part[rnd.randrange(len(part))] = "edit"
            w[len(w) // 2 : len(w) // 2] = part
        if i % 3 == 0:
            part = list(rnd.choice(items[:25])[1])
            for _ in range(rnd.randint(0, len(part) // 5)):
                k = rnd.randrange(len(part))
                part[k : k + 1] = rnd.choice([[], ["edit"], [part[k], "more"]])
            w[len(w) // 2 : len(w) // 2] = part
        docs.append((i, " ".join(w) if i % 2 else ". ".join(w).upper()))
    docs += [(200, None), (201, ""), (202, "ONLY!"), (203, "xx two,words yy"), (None, docs[0][1])]
    df = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in items), (None, "x y z"), (7, None)], "item_id long, text string")
    got = {}
    for r in D.contamination(df, bench).collect():
        got[r.doc_id, r.item_id] = max(r.score, got.get((r.doc_id, r.item_id), 0))
        text = dict(docs)[r.doc_id]
        assert 0 <= r.start < r.end <= len(text)
    in_blocks = sorted(map(str, D.contamination(df, bench).collect()))
    monkeypatch.setattr(D, "JOIN_WORDS", 0)
    assert sorted(map(str, D.contamination(df, bench).collect())) == in_blocks and D.contamination(df.limit(0), bench).count() == 0
    monkeypatch.undo()
    b = D.Block([(i, " ".join(w)) for i, w in items], 3)
    want = {}
    for i, t in docs:
        w = b.read(t)
        for k, item in zip(b.ids, b.words):
            s = brute_align(item.tolist(), w.tolist()) / (2 * len(item)) if len(w) else 0
            if s >= 0.5:
                want[i, k] = s
    assert len(want) > 40 and got.keys() <= want.keys()
    weak = {k for k, s in want.items() if s < 0.6}
    assert len(weak) > 20 and len(weak & got.keys()) >= 0.75 * len(weak)  # a third of the words edited: not every item has a whole seed left
    strong = {k for k, s in want.items() if s >= 0.6}
    assert strong <= got.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in strong)
    kept = D.clean(df, bench).collect()
    assert {r.doc_id for r in kept} == {i for i, _ in docs} - {k[0] for k in got} and kept[0].asDict().keys() == {"doc_id", "text", "item_id"}
    assert D.contamination(df, bench.limit(0)).count() == 0 and D.contamination(df.limit(0), bench).count() == 0


def test_blocks_and_repeats(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(20))
    other = " ".join(f"z{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"{item} pad {'x ' * 5000} {item}"), (1, f"{item}"), (2, other)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    one = sorted(tuple(r) for r in D.contamination(df, bench).collect())
    monkeypatch.setattr(D, "BLOCK_WORDS", 5)
    assert one == sorted(tuple(r) for r in D.contamination(df, bench).collect())
    assert [(r[0], r[1], r[2]) for r in one] == [(1, 1, 1.0)] * 3 + [(2, 2, 1.0)]
