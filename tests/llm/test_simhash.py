import os
import random
from collections import Counter

import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm._common import scratch
from tidemark.llm.components import components


def brute_fp(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).translate(bytes(range(256))).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def union_find(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_matches_spark_hash(spark):
    texts = ["The Quick brown FOX\tjumps", "one", "", None, "a b", "é É x y z w", "w " * 5000]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fp(t) for t in texts]
    assert spark.sql("select xxhash64('the quick brown') h").head().h == np.array([xxhash.xxh64_intdigest("the quick brown", 42)], np.uint64).view(np.int64)[0]


def linked(spark, fps, **kw):
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), **kw)).collect()
    at = {x: i for i, x in enumerate(signed)}
    tau = kw.get("tau", 2)
    want = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= tau])
    root = {r.node: r.component for r in got}
    groups = {}
    for x in signed:
        groups.setdefault(root.get(x, x), []).append(at[x])
    return sorted(map(sorted, groups.values())), sorted([i for i in range(len(fps)) if want[i] == r] for r in set(want))


def test_links_against_brute_force(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = base + [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.choice([1, 2, 3, 4]))) for b in base for _ in range(3)]
    for tau, parts in ((2, None), (2, 2), (2, 4), (3, 3)):
        got, want = linked(spark, fps, tau=tau, parts=parts)
        assert got == want, (tau, parts)


def test_links_in_crowded_buckets(spark):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    fps = [centre ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(250)] + [rnd.getrandbits(64) for _ in range(50)]
    for tau in (2, 3):
        got, want = linked(spark, fps, tau=tau)
        assert got == want


def test_frame(spark):
    rows = [(5, "a b c d e f"), (3, "A B  c d e f"), (9, None), (7, ""), (None, "a b c d e f"), (5, "a b c d e f"), (11, "x y z " * 3000)]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame([(a, b, "fp") for a, b in rows], "doc_id long, text string, fp string")).collect())
    same, big = f"{brute_fp('a b c d e f'):016x}", f"{brute_fp('x y z ' * 3000):016x}"
    assert got == sorted([("5", same, 3), ("5", same, 3), ("3", same, 3), ("None", same, 3), ("9", "0" * 16, 7), ("7", "0" * 16, 7), ("11", big, 11)])
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rnd = random.Random(6)
    pairs = [(i, i + 1) for i in range(40)] + [(rnd.randint(50, 200), rnd.randint(50, 200)) for _ in range(90)] + [(300, 300 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*pairs, (None, 1), (7, None)], "a long, b long")).collect()}
    want = union_find(400, pairs)
    assert got == {i: want[i] for p in pairs for i in p if p[0] != p[1]}


def test_bit_counts():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 11, 12, 13, 100, 5000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        both = simhash.bit_counts(np.stack([h, ~h]))
        assert both[0].tolist() == [int((h >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)] and (both.sum(axis=0) == n).all()


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_similar_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(2000)]
    docs = {}
    for i in range(70):
        base = rnd.choices(vocab, k=rnd.randint(60, 400))
        docs[5 * i] = base
        for j in range(1, 4):
            w = list(base)
            for _ in range(rnd.choice([0, 1, len(w) // 200, len(w) // 100, len(w) // 50, len(w) // 20])):
                w[rnd.randrange(len(w))] = "edit"
            docs[5 * i + j] = w
    text = {k: " ".join(w) for k, w in docs.items()}
    df = spark.createDataFrame([(k, t, 1) for k, t in text.items()] + [(None, text[0], 1), (9000, None, 1), (9001, "", 1)], "doc_id long, text string, fps int")
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    ids = sorted(text)
    close = {(a, b): jaccard(text[a], text[b]) for a in ids for b in ids if a < b and a // 5 == b // 5}
    roots = {}
    for least in (0.77, 0.83):
        at = {k: i for i, k in enumerate(ids)}
        root = union_find(len(ids), [(at[a], at[b]) for (a, b), j in close.items() if j >= least])
        roots[least] = {k: ids[root[at[k]]] for k in ids}
    assert all(roots[0.77][got[k]] == roots[0.77][k] for k in ids)  # nothing that is surely unlike is together
    missed = [k for k in ids if roots[0.83][k] != got[k] and roots[0.77][k] == roots[0.83][k]]
    assert len(missed) <= 0.05 * len(ids) and sum(roots[0.83][k] != k for k in ids) > 60
    assert got[None] == 0 and got[9000] == got[9001] == 9000
    assert simhash.similar(df.limit(0)).count() == 0


def test_similar_in_one_large_group(spark):
    rnd = random.Random(8)
    base = rnd.choices([f"w{i}" for i in range(500)], k=300)
    rows = []
    for i in range(150):
        w = list(base)
        w[rnd.randrange(300)] = f"x{i}"
        rows.append((i + 1, " ".join(w)))
    got = {r.component_id for r in simhash.similar(spark.createDataFrame([(0, " ".join(base)), *rows], "doc_id long, text string")).collect()}
    assert got == {0}


def grown(rnd, base, share, tag):
    """base with one new word after another at its end, until its similarity to base has come down to share."""
    n, k = len(base) - 4, 0
    while n / (n + k + 1) >= share:
        k += 1
    return [*base, *[f"{tag}_{j}" for j in range(k)]]


def test_similar_is_exact_at_the_threshold(spark):
    """All pairs of 0.8 and little more are found, none of little less: what falls with the number of documents can't be exact here."""
    rnd, vocab, rows = random.Random(9), [f"w{i}" for i in range(3000)], []
    for i in range(150):
        base = rnd.choices(vocab, k=rnd.randint(60, 300))
        other = grown(rnd, base, (0.8, 0.82)[i % 2], f"n{i}")
        rows += [(4 * i, " ".join(base)), (4 * i + 1, " ".join(other)), (4 * i + 2, " ".join([*base, *[f"u{i}_{j}" for j in range(len(base) // 3)]]))]
    text = dict(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(150):
        assert jaccard(text[4 * i], text[4 * i + 1]) >= 0.8 > jaccard(text[4 * i], text[4 * i + 2])
        assert [got[4 * i + j] for j in range(3)] == [4 * i, 4 * i, 4 * i + 2]
    few = spark.createDataFrame(rows[:3], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(few).collect()} == {0: 0, 1: 0, 2: 2}  # the same among few documents


def test_similar_in_a_source_of_shared_boilerplate(spark):
    """Documents that share most of their text without being alike, the smallest id unlike all: near-duplicates among them are found."""
    rnd, vocab = random.Random(10), [f"w{i}" for i in range(3000)]
    common, rows = rnd.choices(vocab, k=170), [(0, " ".join(rnd.choices(vocab, k=200)))]
    for i in range(150):
        own = rnd.choices(vocab, k=30)
        near = list(own)
        near[rnd.randrange(5, 25)] = f"x{i}"
        rows += [(2 * i + 1, " ".join([*common, *own])), (2 * i + 2, " ".join([*common, *near]))]
    text = dict(rows)
    assert 0.7 < jaccard(text[1], text[3]) < 0.8 < jaccard(text[1], text[2])
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, **{2 * i + j: 2 * i + 1 for i in range(150) for j in (1, 2)}}


def test_prefixes_against_brute_force():
    """Sets as alike as that meet in a key whose places leave enough of both."""
    rng, alike, apart = np.random.default_rng(12), 0, 0
    for similarity in (0.8, 0.5, 1.0):
        for _ in range(1500):
            a = rng.choice(1 << 20, rng.integers(1, 120), replace=False).astype(np.uint32)
            b = np.concatenate([rng.permutation(a)[rng.integers(0, len(a) // 3 + 1) :], rng.choice(1 << 20, rng.integers(0, len(a) // 4 + 1)).astype(np.uint32)])
            x, y = sorted((np.unique(a), np.unique(b)), key=len)
            same = len(np.intersect1d(x, y))
            need = (len(x) + len(y)) * similarity / (1 + similarity) - 1e-6
            (kx, px, lx), (ky, py, ly) = (simhash.prefix_keys(s, similarity) for s in (x, y))
            short, long = dict(zip(kx[~lx], px[~lx])), dict(zip(ky[ly], py[ly]))
            met = any(k in long and len(x) - p >= need and len(y) - long[k] >= need for k, p in short.items())
            if same >= similarity * (len(x) + len(y) - same) - 1e-9:
                alike += 1
                assert met
            else:
                apart += not met
    assert alike > 500 and apart > 500


def test_pairs_of_a_crowd(spark):
    """Copies of one text with so many edits that most are unlike: all pairs that are alike, and few of the others."""
    rnd = random.Random(13)
    base = rnd.choices([f"w{i}" for i in range(3000)], k=150)
    texts = []
    for i in range(400):
        w = list(base)
        for _ in range(rnd.choice([2, 8, 9, 10, 11])):
            w[rnd.randrange(150)] = f"x{rnd.randrange(10**9)}"
        if i % 6 == 5:  # hardly edited once more
            w = texts[-1].split()
            w[rnd.randrange(150)] = f"y{i}"
        texts.append(" ".join(w))
    signed = lambda t: int(np.array([xxhash.xxh64_intdigest(simhash.shingle_set(t, 5).tobytes(), 7)], np.uint64).view(np.int64)[0])
    classes = spark.createDataFrame([(i, signed(t), i) for i, t in enumerate(texts)], "node long, sig long, cid long")
    crowd = spark.createDataFrame([(k, i, 400, i) for i in range(400) for k in (1, 2)], "key long, node long, size long, root long")
    got = {(r.a, r.b) for r in simhash._prefix_pairs(crowd, classes, spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 5, 0.8).collect()}
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    alike = {(i, j) for j in range(400) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(alike) > 60 and alike <= got and len(got) < 8 * len(alike) < 400 * 399 // 8


def left_behind(spark):
    """The tables in the shared folder by the name they were stored under."""
    base = scratch(spark, "none").removeprefix("file://").rpartition("/")[0]
    return Counter(x.rpartition("-")[0] for x in os.listdir(base))


def test_tables_of_similar_go(spark):
    """What other stages of a pipeline would have to find room beside is one narrow table."""
    df = spark.createDataFrame([(i, " ".join(f"w{i // 2 + j}" for j in range(50))) for i in range(40)], "doc_id long, text string")
    before = left_behind(spark)
    got = simhash.similar(df)
    assert left_behind(spark) - before == {"components": 1}
    assert got.count() == 40


def test_few_links_in_one_task(spark):
    """The same components as by the steps over tables: rows and rings, stars, copies, links of a node to itself."""
    rnd = random.Random(31)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000 + (i + 1) % 90) for i in range(90)] + [(2000, 2001 + i) for i in range(300)]
    pairs += [(rnd.randint(3000, 4000), rnd.randint(3000, 4000)) for _ in range(700)] + [(5000, 5000), (5001, 5001)]
    rnd.shuffle(pairs)
    df = spark.createDataFrame([*pairs, *pairs[:50]], "a long, b long")
    got, want = (sorted(map(tuple, components(df, at_once=n).collect())) for n in (10_000, 0))
    assert got == want and len(got) > 1000
    assert components(df.limit(0), at_once=10).count() == 0
