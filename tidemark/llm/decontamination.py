"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passages they point to.

A first pass counts in how many texts each n-gram of the items occurs. Of every few n-grams in a row, each item keeps the rarest as
a seed: a passage that is common itself still has seeds, and any shared run of n + window - 1 words holds one. A second
pass joins the seeds to the texts and aligns each item to the text around its hits.

Items of up to JOIN_WORDS words go to the texts in blocks of bounded size, as the small side of a join in memory: no shuffle. More
meet the texts in equi-joins by n-gram, after a bitmap of fixed size has sorted out most n-grams of the texts. Both give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._common import free_name, small_batches, stored
from .hashed_words import shingles

#: Words of test items in a block; each block is one pass over the texts.
BLOCK_WORDS = 200_000
#: Words of all test items beyond which n-grams join by a shuffle.
JOIN_WORDS = 5 * BLOCK_WORDS
#: Bits of the bitmap of the items' n-grams.
BITMAP = 1 << 24
#: Alignments a worker remembers, for texts that are copies.
REMEMBERED = 20_000
_words = re.compile(r"\w+").findall
HITS = "array<struct<item_id:bigint,score:double,start:int,end:int>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def lower(text: str) -> str:
    """Lower case, character by character where the whole changes its length."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def align(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """(score, end in b) of the best local alignment of two sequences of numbers; ids below 0 match nothing.

    Row by row; what comes from the left in a row is a running maximum, as gaps cost the same each.
    """
    n = len(b)
    at = np.arange(n + 1)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for x in a:
        new = np.maximum(row + gap, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where((b == x) & (b >= 0), match, mismatch))
        new = np.maximum.accumulate(new - gap * at) + gap * at
        row = new
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


class Block:
    """Test items with their words numbered and n-grams keyed; plain arrays that travel to executors."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.ids, self.vocabulary = n, [], {}
        self.words: list[np.ndarray] = []
        for i, text in items:
            found = _words(lower(text or ""))
            if found:
                self.ids.append(i)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], np.int64))
        self.base = len(self.vocabulary) + 1
        self.short: dict[int, list[int]] = {}
        grams = [self.grams(w, min(n, len(w))) for w in self.words]
        self.of_item = grams
        self.keys = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        self.sizes = sorted({min(n, len(w)) for w in self.words})

    def grams(self, w: np.ndarray, n: int) -> np.ndarray:
        """Keys of the n-grams at each place; -1 where a word is unknown. Words count from 1 in a key, so lengths differ."""
        if len(w) < n:
            return np.zeros(0, np.int64)
        key, ok = np.zeros(len(w) - n + 1, np.int64), np.ones(len(w) - n + 1, bool)
        for i in range(n):
            part = w[i : len(w) - n + 1 + i]
            key = key * self.base + part + 1
            ok &= part >= 0
        return np.where(ok, key, -1)

    def read(self, text: str | None) -> np.ndarray:
        """A text's words as numbers, -1 for words of no item."""
        found = _words(lower(text or ""))
        return np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))

    def hits(self, w: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in a text, index in keys) of the n-grams that are among sorted keys."""
        where, which = [], []
        for n in self.sizes:
            g = self.grams(w, n)
            known = np.flatnonzero(g >= 0)
            if len(known) and len(keys):
                at = np.searchsorted(keys, g[known])
                at[at == len(keys)] = 0
                ok = keys[at] == g[known]
                where.append(known[ok])
                which.append(at[ok])
        return (np.concatenate(where), np.concatenate(which)) if where else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _blocks(benchmark: DataFrame, text_col: str, id_col: str, n: int) -> Iterator[Block]:
    """Blocks of items, read from the table piece by piece."""
    items, size = [], 0
    for r in benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), text_col).distinct().toLocalIterator():
        items.append((r[0], r[1]))
        size += len(r[1].split())
        if size >= BLOCK_WORDS:
            yield Block(items, n)
            items, size = [], 0
    if items:
        yield Block(items, n)


def _frequencies(texts: DataFrame, block: Block) -> np.ndarray:
    """In how many texts each n-gram of the block occurs: counted for each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.keys), np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                w = block.read(t)
                if (w >= 0).any():
                    total[np.unique(block.hits(w, block.keys)[1])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    out = np.zeros(len(block.keys), np.int64)
    sums = texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out[sums["k"]] = sums["n"]
    return out


def seeds(block: Block, frequency: np.ndarray, window: int) -> dict[int, list[tuple[int, int]]]:
    """Key -> (item, place) of the seeds: the rarest of each `window` n-grams in a row, the first of equals."""
    out: dict[int, list[tuple[int, int]]] = {}
    for i, g in enumerate(block.of_item):
        f = frequency[np.searchsorted(block.keys, g)]
        if len(g) <= window:
            places = {int(f.argmin())}
        else:
            v = np.lib.stride_tricks.sliding_window_view(f, window)
            places = set((v.argmin(axis=1) + np.arange(len(v))).tolist())
        for p in sorted(places):
            out.setdefault(int(g[p]), []).append((i, p))
    return out


def window_of(place: int, at: int, m: int, n: int) -> tuple[int, int]:
    """The words of a text of n that an item of m words may cover if its n-gram at `at` stands at `place`."""
    slack = m // 4 + 2
    return max(0, place - at - slack), min(n, place - at + m + slack)


class Aligner:
    """Finds the items of a block in texts."""

    def __init__(self, block: Block, chosen: dict[int, list[tuple[int, int]]], least: float):
        self.block, self.least = block, least
        self.keys = np.array(sorted(chosen), np.int64)
        self.posts = [chosen[int(k)] for k in self.keys]
        self.sets = {}
        self.known: dict[tuple[int, bytes], tuple[float, int, int]] = {}

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item id, score, start, end in characters) of each passage that aligns; passages of an item don't overlap."""
        w = self.block.read(text)
        if not len(w):
            return []
        places, which = self.block.hits(w, self.keys)
        if not len(places):
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        for p, k in zip(places.tolist(), which.tolist()):
            for item, at in self.posts[k]:
                spans.setdefault(item, []).append(window_of(p, at, len(self.block.words[item]), len(w)))
        return self.around(text, w, spans)

    def around(self, text: str, w: np.ndarray, spans: dict[int, list[tuple[int, int]]]) -> list[tuple[int, float, int, int]]:
        """The passages of items within windows of a text's words."""
        out, edges = [], None
        for item, windows in spans.items():
            merged: list[list[int]] = []
            for s, e in sorted(windows):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            for s, e in merged:
                for score, a, b in self._passages(item, w, s, e):
                    if edges is None:
                        edges = [m.span() for m in re.finditer(r"\w+", lower(text))]
                    out.append((self.block.ids[item], score, edges[a][0], edges[b - 1][1]))
        return sorted(out)

    def _passages(self, item: int, w: np.ndarray, s: int, e: int) -> Iterator[tuple[float, int, int]]:
        """Alignments within words s to e: the best one, then the best of what is left on either side."""
        a, b = self.block.words[item], w[s:e]
        if item not in self.sets:
            self.sets[item] = np.unique(a)
        if np.isin(b, self.sets[item]).sum() < self.least * len(a):
            return
        key = (item, b.tobytes())
        got = self.known.get(key)
        if got is None:
            score, end = align(a, b)
            got = (0.0, 0, 0)
            if score >= self.least * 2 * len(a):
                # the same search backwards from the end gives the start
                _, back = align(a[::-1], b[:end][::-1])
                got = (score / (2 * len(a)), end - back, end)
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[key] = got
        if got[0]:
            yield got[0], s + got[1], s + got[2]
            yield from self._passages(item, w, s, s + got[1])
            yield from self._passages(item, w, s + got[2], e)


def annotate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", item_id: str = "item_id", n: int = 3, window: int = 3, least: float = 0.5, name: str = "hits") -> DataFrame:
    """df with one more column: its passages of test items, as (item_id, score, start, end).

    score is the alignment's share of the item's own (match 2, mismatch and gap -1), at least `least`; start and end are
    characters of the text. Words are runs of letters and digits, lower-cased. An item of fewer words than n is one
    seed; an item without words, or with a null id or text, matches nothing; neither does a null or empty text; rows that repeat
    an item count once.
    Rows of df are never moved; repeated rows repeat; df may have any other columns but `name`.
    """
    small_batches(df.sparkSession)
    items = benchmark.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("text"))
    if (items.agg(F.sum(F.size(F.split("text", r"\s+")))).head()[0] or 0) > JOIN_WORDS:
        return _joined(df, items, text_col, n, window, least, name)
    out = df.withColumn(name, F.array().cast(HITS))
    for block in _blocks(benchmark, item_text, item_id, n):
        chosen = seeds(block, _frequencies(df.select(F.col(text_col).alias("t")), block), window)
        out = _add(out, block, chosen, text_col, least, name)
    return out


def _add(df: DataFrame, block: Block, chosen: dict[int, list[tuple[int, int]]], text_col: str, least: float, name: str) -> DataFrame:
    text_at, hits_at, names = df.columns.index(text_col), df.columns.index(name), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Aligner(block, chosen, least).find
        for b in batches:
            before = b.column(hits_at).to_pylist()
            got = [[*(h or []), *({"item_id": i, "score": s, "start": x, "end": y} for i, s, x, y in find(t))] for h, t in zip(before, b.column(text_at).to_pylist())]
            columns = b.columns
            columns[hits_at] = pa.array(got, _HITS)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)


def gram_keys(found: list[str], n: int) -> np.ndarray:
    """Hashes of the n-grams of words, which tell their length."""
    h = np.fromiter((xxh64_intdigest(w) for w in found), np.uint64, len(found))
    return shingles(h, n).view(np.int64) ^ np.int64(n)


def _joined(df: DataFrame, items: DataFrame, text_col: str, n: int, window: int, least: float, name: str) -> DataFrame:
    """annotate() by equi-joins. A text's hits depend on it alone, so texts are known by their hash and copies are aligned once."""
    items = items.select(F.xxhash64("item", "text").alias("ik"), "item", "text").distinct()
    texts = df.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.zeros((0, 4), np.int64)]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = _words(lower(t))
                if found:
                    k = gram_keys(found, min(n, len(found)))
                    got.append(np.stack([np.full(len(k), i), k, np.arange(len(k)), np.full(len(k), len(found))], axis=1))
            c = np.concatenate(got)
            yield pa.RecordBatch.from_arrays([pa.array(c[:, i]) for i in range(4)], ["ik", "key", "at", "m"])

    grams = stored(items.select("ik", "text").mapInArrow(of_items, "ik long, key long, at long, m long"), "grams")
    lengths = sorted(r[0] for r in grams.select(F.least("m", F.lit(n)).alias("k")).distinct().collect())  # up to n
    bits = np.zeros(BITMAP, bool)
    bits[grams.select(F.pmod("key", F.lit(BITMAP)).cast("int").alias("bit")).distinct().toPandas()["bit"]] = True  # up to BITMAP
    bits = np.packbits(bits)

    def in_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bits).astype(bool)
        for b in batches:
            got = [np.zeros((0, 4), np.int64)]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = _words(lower(t))
                for k in lengths:
                    keys = gram_keys(found, k)
                    at = np.flatnonzero(known[keys % BITMAP])
                    new = np.zeros(len(at), np.int64)
                    new[np.unique(keys[at], return_index=True)[1]] = 1
                    got.append(np.stack([np.full(len(at), i), keys[at], at, new], axis=1))
            c = np.concatenate(got)
            yield pa.RecordBatch.from_arrays([pa.array(c[:, i]) for i in range(4)], ["text_hash", "key", "place", "new"])

    seen = stored(texts.mapInArrow(in_texts, "text_hash long, key long, place long, new long").join(grams.select("key").distinct(), "key", "left_semi"), "seen")
    often = seen.groupBy("key").agg(F.sum("new").alias("n"))
    counted = grams.join(often, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ahead = Window.partitionBy("ik").orderBy("at").rowsBetween(0, window - 1)
    chosen = counted.withColumns({"pick": F.min(F.struct("n", "at", "key", "m")).over(ahead), "last": F.max("at").over(Window.partitionBy("ik"))})
    chosen = chosen.where(F.col("at") <= F.greatest(F.col("last") + 1 - window, F.lit(0)))  # whole windows, or the only one
    seeds_ = chosen.select("ik", "pick.key", F.col("pick.at").alias("at"), "pick.m").distinct()
    met = seen.join(seeds_, "key").select("text_hash", "ik", "place", "at", "m").distinct().groupBy("text_hash", "ik").agg(F.collect_list(F.struct("place", "at", "m")).alias("places"))
    whole = met.join(texts.dropDuplicates(["text_hash"]), "text_hash").join(items.withColumnRenamed("text", "item_text"), "ik")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders: dict[tuple, Aligner] = {}
        for b in batches:
            keys, got = [], []
            for key, item, places, text, item_text in zip(*(c.to_pylist() for c in b.columns)):
                if len(finders) > 1000:
                    finders.clear()
                find = finders.get((item, item_text)) or finders.setdefault((item, item_text), Aligner(Block([(item, item_text)], n), {}, least))
                w = find.block.read(text)
                for i, score, s, e in find.around(text, w, {0: [window_of(x["place"], x["at"], x["m"], len(w)) for x in places]}):
                    keys.append(key)
                    got.append({"item_id": i, "score": score, "start": s, "end": e})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(got, _HITS.value_type)], ["text_hash", "hit"])

    hits = whole.select("text_hash", "item", "places", "text", "item_text").mapInArrow(aligned, f"text_hash long, hit {HITS[6:-1]}")
    hits = hits.groupBy("text_hash").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("text_hash"))
    return rows.join(hits, "text_hash", "left").select(*[F.col("row")[c].alias(c) for c in df.columns], F.coalesce("hits", F.array().cast(HITS)).alias(name))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row for each passage found: the id, item_id, score, start, end. Rows of df without a passage give none."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = annotate(src, benchmark, text_col="t", **kw).where(F.size("hits") > 0).select("id", F.explode("hits").alias("h"))
    return found.select(F.col("id").alias(id_col), "h.item_id", "h.score", "h.start", "h.end")


def clean(df: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of df, as they are, that hold no passage of a test item."""
    hits = free_name(df, "hits")
    return annotate(df, benchmark, name=hits, **kw).where(F.size(hits) == 0).drop(hits)
