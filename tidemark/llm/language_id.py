"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (1 to `n_max`, words padded with one blank), most frequent
first. A document's own ranking is compared to each profile by out-of-place distance: the sum of the rank
differences, where an n-gram the profile lacks counts as the whole profile's length.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fraction_for, small_batches

UNDETERMINED = "und"


def _no_letters() -> str:
    """What counts as a word character without being a letter or a decimal digit, as the inside of a character class."""
    marks = [chr(c) for c in range(sys.maxunicode + 1) if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal()]
    return "".join(map(re.escape, marks))


#: Runs of letters (Unicode L*); slow, as the class is long.
LETTERS = re.compile(rf"[^\W\d_{_no_letters()}]+")
#: N-grams and words a worker remembers; emptied when full.
GRAMS, WORDS, HELD_BYTES = 300_000, 200_000, 64_000_000


class GramCounter:
    """Counts the n-grams of texts through a memory of words, each n-gram having a number of its own."""

    def __init__(self, n_max: int):
        self.n_max = n_max
        self.split = re.compile(r"[^\W\d_]+").findall
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.known: dict[str, bytes] = {}
        self.held = 0

    def full(self) -> bool:
        return len(self.ids) > GRAMS or len(self.known) > WORDS or self.held > HELD_BYTES

    def grams(self, word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + n] for n in range(1, self.n_max + 1) for i in range(len(w) - n + 1) if n > 1 or w[i] != " "]

    def _learn(self, word: str) -> bytes:
        out = []
        for g in self.grams(word):
            if (i := self.ids.get(g)) is None:
                i = self.ids[g] = len(self.names)
                self.names.append(g)
            out.append(i)
        got = self.known[word] = np.array(out, "<i4").tobytes()
        self.held += 4 * len(word) + len(got)
        return got

    def counts(self, text: str) -> np.ndarray | None:
        """Times that each numbered n-gram occurs; None for a text without letters."""
        words = Counter(self.split(text.lower()))
        for w in [w for w in words if not w.isalpha()]:  # with numerals that are no decimal digits
            n = words.pop(w)
            for part in LETTERS.findall(w):
                words[part] += n
        if not words:
            return None
        known = self.known
        each = [known.get(w) or self._learn(w) for w in words]
        lengths = np.fromiter(map(len, each), np.int64, len(each)) // 4
        times = np.repeat(np.fromiter(words.values(), np.float64, len(each)), lengths)
        return np.bincount(np.frombuffer(b"".join(each), "<i4"), times, len(self.names))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 20_000, profile_size: int = 300, n_max: int = 3) -> dict[str, list[str]]:
    """Profiles by language, from rows whose text and language are not null.

    max_docs bounds the sample of labelled rows that is learned from (chosen by a hash of the id). What comes
    back to the driver is profile_size n-grams for each language.
    """
    small_batches(df.sparkSession)
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    src = rows.where(fraction_for(rows, id_col, max_docs)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, sums = GramCounter(n_max), {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, s in sums.items():
                at = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([counter.names[i] for i in at], pa.string()), pa.array(s[at].astype(np.int64))], ["lang", "gram", "n"])
            sums.clear()
            counter.forget()

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if counter.full():
                    yield from out()
                if (c := counter.counts(text)) is None:
                    continue
                s = sums.get(lang)
                if s is None:
                    sums[lang] = c
                elif len(s) < len(c):
                    c[: len(s)] += s
                    sums[lang] = c
                else:
                    s[: len(c)] += c
        yield from out()

    counts = src.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= profile_size)
    profiles: dict[str, list[str]] = {}
    for r in best.orderBy("lang", "rank").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


class RankClassifier:
    """Nearest profile by out-of-place distance. Equal counts rank by n-gram, equal distances by language name."""

    def __init__(self, profiles: dict[str, list[str]], profile_size: int = 300, n_max: int = 3):
        self.langs, self.size = sorted(profiles), profile_size
        self.ranks: dict[str, list[int]] = {}
        for k, lang in enumerate(self.langs):
            for r, g in enumerate(profiles[lang][:profile_size]):
                self.ranks.setdefault(g, [-1] * len(self.langs))[k] = r
        self.counter = GramCounter(n_max)
        self._reset()

    def _reset(self) -> None:
        self.counter.forget()
        self.table, self.filled = np.full((1024, len(self.langs)), -1, np.int32), 0

    def _fill(self) -> None:
        names = self.counter.names
        if len(names) > len(self.table):
            self.table = np.concatenate([self.table, np.full((2 * len(names) - len(self.table), len(self.langs)), -1, np.int32)])
        for i in range(self.filled, len(names)):
            if (r := self.ranks.get(names[i])) is not None:
                self.table[i] = r
        self.filled = len(names)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); the score is 1 less the distance as a share of the greatest possible one."""
        if not text or not self.langs:
            return UNDETERMINED, 0.0
        if self.counter.full():
            self._reset()
        c = self.counter.counts(text)
        if c is None:
            return UNDETERMINED, 0.0
        self._fill()
        at = np.flatnonzero(c)
        n = c[at]
        if len(at) > self.size:
            keep = n >= np.partition(n, len(n) - self.size)[len(n) - self.size]
            at, n = at[keep], n[keep]
        names = self.counter.names
        at = at[np.lexsort((np.array([names[i] for i in at]), -n))][: self.size]
        ranks = self.table[at]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(at))[:, None])).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(at))


def predict(df: DataFrame, profiles: dict[str, list[str]], text_col: str = "text", keep: list[str] | None = None, profile_size: int = 300, n_max: int = 3, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of each row, then language and score (0 to 1) under `names`, from its whole text alone. No shuffle.

    "und" with score 0 where the text is null or has no letter, or nothing was learned. Repeated rows repeat.
    """
    small_batches(df.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    src = df.select(df[text_col].alias("_text"), *[df[c] for c in keep])
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{names[0]}` string", f"`{names[1]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = RankClassifier(profiles, profile_size, n_max)
        for b in batches:
            got = [classify.predict(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, *names])

    return src.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the third of ids that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_not_held_out(df: DataFrame, **kw) -> dict[str, list[str]]:
    return fit(df.where(~held_out()), **kw)
