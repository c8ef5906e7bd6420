import random
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from tidemark.llm import language_id, toxicity

DATA = "/root/testdata/sf0.01"


def brute(profiles, text, size=300):
    import re

    c = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        w = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                if w[i : i + n] != " ":
                    c[w[i : i + n]] += 1
    if not c:
        return "und", 0.0
    mine = sorted(c, key=lambda g: (-c[g], g))[:size]
    best = min(
        (sum(abs(i - p.index(g)) if g in p else size for i, g in enumerate(mine)), lang) for lang, p in profiles.items()
    )
    return best[1], 1 - best[0] / (size * len(mine))


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    profiles = language_id.fit_not_held_out(docs)
    assert set(profiles) == {"en", "fr", "de", "es"} and all(len(p) == 300 for p in profiles.values())
    rows = language_id.predict(docs, profiles, keep=["doc_id", "lang", "text"]).withColumn("h", language_id.held_out()).collect()
    held = [r for r in rows if r.h]
    assert len(rows) == 1000 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    for r in rows[:40]:
        lang, score = brute(profiles, r.text)
        assert lang == r.lang_pred and abs(score - r.score) < 1e-12


def test_language_edges(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (None, "123 456!", None), (4, "the the", "en"), (4, "the the", "en"), (5, "中文" * 2000, None)], "doc_id long, text string, lang_pred string")
    profiles = language_id.fit(df, lang_col="lang_pred")
    got = sorted((str(r.doc_id), r.lang_pred) for r in language_id.predict(df, profiles).collect())
    assert got == [("1", "und"), ("2", "und"), ("4", "en"), ("4", "en"), ("5", "en"), ("None", "und")]
    assert language_id.fit(df.limit(0), lang_col="lang_pred") == {}
    assert {r.lang_pred for r in language_id.predict(df, {}).collect()} == {"und"}


def test_letters_alone_make_words(spark):
    """Numerals that are no decimal digits, marks and digits are no letters; letters of any script are."""
    texts = {1: "½ ² ① Ⅷ ৴", 2: "123 ٣", 3: "\u0301\u0300", 4: "_ - !", 5: "é", 6: "ª", 7: "中", 8: "x²"}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, {"en": ["e", "x"]}).collect()}
    assert [i for i in texts if got[i] == ("und", 0.0)] == [1, 2, 3, 4] and all(got[i][0] == "en" for i in (5, 6, 7, 8))
    import unicodedata

    for c in map(chr, range(0x30000)):
        assert bool(language_id.LETTERS.match(c)) == unicodedata.category(c).startswith("L"), hex(ord(c))


def test_ordinal_recovers_grades():
    rnd = random.Random(3)
    rows, grades = [], []
    for _ in range(1500):
        bad = rnd.choice([0, 0, 0, 1, 2, 4])
        words = rnd.choices([f"w{i}" for i in range(300)], k=40) + rnd.choices(["bad", "vile"], k=bad)
        rows.append(toxicity.features(" ".join(words)))
        grades.append({0: 0, 1: 1, 2: 2, 4: 3}[bad])
    indptr = np.cumsum([0] + [len(r) for r in rows])
    m = toxicity.fit_ordinal(indptr, np.array([k for r in rows for k in r]), np.array([v for r in rows for v in r.values()]), np.array(grades), 4)
    assert m.thresholds == sorted(m.thresholds) and len(m.thresholds) == 3
    severity = lambda t: m.at_least(np.array([m.latent(t)])).sum()
    text = "w1 bad bad w7 vile"
    assert abs(m.latent(text) - sum(v * m.weights.get(k, 0) for k, v in toxicity.features(text).items())) < 1e-9
    assert severity("w1 w2") < severity("w1 bad") < severity("bad bad vile w3") < severity("bad vile bad vile bad")


def test_fit_is_the_optimum():
    """By an objective written down on its own: no change of a weight or threshold makes it less."""
    rng = np.random.default_rng(0)
    n, k, strength = 600, 8, 0.05 * 0.2 / np.sqrt(600)
    x = rng.integers(0, 3, (n, k)) * (rng.random((n, k)) < 0.4)
    latent = x @ np.array([2.0, -1.5, 1.0, 0.5, 0, 0, 0.8, -0.7]) + rng.logistic(size=n)
    grade = (latent > 0.5).astype(int) + (latent > 2.5)
    index = np.concatenate([np.flatnonzero(r) for r in x]).astype(np.int32)
    value = np.concatenate([r[r > 0] for r in x]).astype(np.float32)
    m = toxicity.fit_ordinal(np.concatenate([[0], np.cumsum((x > 0).sum(axis=1))]), index, value, grade, 3, penalty=0.2, min_df=1, rounds=3000)
    idf = np.log(n / (x > 0).sum(axis=0))

    def objective(w, theta):
        s = (x * idf) @ w
        cdf = lambda t: 1 / (1 + np.exp(s - t))
        p = np.stack([cdf(theta[0]), cdf(theta[1]) - cdf(theta[0]), 1 - cdf(theta[1])])[grade, np.arange(n)]
        return -np.log(p).mean() + strength * np.abs(w).sum()

    w, theta = np.array([m.weights.get(j, 0) / idf[j] for j in range(k)]), np.array(m.thresholds)
    best = objective(w, theta)
    assert (w != 0).sum() >= 6 and best < objective(np.zeros(k), theta) - 0.1
    for step in (0.3, 0.03, 0.003):
        for change in (step, -step):
            for j in np.flatnonzero(w):
                assert objective(w + change * (np.arange(k) == j), theta) > best - 1e-7
            for j in range(2):
                assert objective(w, theta + change * (np.arange(2) == j)) > best - 1e-7


def test_toxicity_frame(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet").selectExpr("doc_id", "toxic as grade")
    m = toxicity.fit(docs, labels, 2)
    rows = {r.doc_id: r for r in toxicity.predict(docs, m).collect()}
    held = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    big = toxicity.fit(held.where("doc_id % 2 = 0").select("doc_id", "text"), held.where("doc_id % 2 = 0").selectExpr("doc_id", "toxic as grade"), 2, penalty=0.2)
    test = toxicity.predict(held.where("doc_id % 2 = 1").select("doc_id", "text"), big).join(held.select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    caught = sum(r.toxic and r.label == 1 for r in test)
    assert caught >= 0.9 * sum(r.label for r in test) and sum(r.toxic and r.label == 0 for r in test) <= 0.02 * len(test)
    assert len(rows) == 1000 and all(0 <= r.expected_severity <= 1 for r in rows.values())
    odd = spark.createDataFrame([(None, None, 1), (7, "", 1), (7, "idiot " * 9, 1)], "doc_id long, text string, toxic int")
    got = toxicity.predict(odd, m).collect()
    assert len(got) == 3 and [r.toxic for r in got] == [False, False, True]
    none = toxicity.fit(docs.limit(0), labels.limit(0), 3)
    assert none.weights == {} and len(none.thresholds) == 2 and toxicity.predict(odd, none).count() == 3
