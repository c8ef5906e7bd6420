"""SimHash near-duplicates: fingerprints, and all pairs of them within a Hamming distance by generalised pigeonhole.

The 64 bits are grouped into partitions, correlated bits together, so that skew stays within few partitions. For
each distinct fingerprint a dynamic program hands out distance thresholds to the partitions: in all tau + 1 units, a
partition with u units being probed within distance u - 1 (none with 0 units). By the pigeonhole principle any
allocation finds every neighbour; the program takes the one with the fewest estimated candidates and probes.
Candidates meet in an equi-join on (partition, value) and are verified.

A value that very many distinct fingerprints share would make all pairs of its bucket candidates. Those
fingerprints, and whatever probes such a value, meet exactly but otherwise: two fingerprints are within
tau if and only if their balls of half that radius intersect, so each emits the members of its ball as keys, and
those that share a key are linked in a star. A key has no more members than a ball, whatever the group's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._common import cut, free_shuffles, only_ids, passing, small_batches, stored
from .components import components
from .hashed_words import mix, shingles, words

NOT_SPACE = np.array([chr(b) not in " \t\n\r\x0b\x0c" for b in range(256)])
FOLD = 16  # bits of a partition value that the histogram of candidate counts keeps
FEW = 8  # sets that are compared in pairs at once where they share a bucket
BLOCK = 1024  # sets of a larger bucket that meet at once
TURNS = 3  # times that one member of a bucket is compared with the rest before all pairs are
SMALL = 16  # shingles of a set that is too small for its fingerprint alone
SPARE_BITS = 3  # of a partition beyond the logarithm of the number of sets: unlike sets seldom meet
MAX_WIDTH = 40
CHOICE = 1.15  # fingerprint bits for each that thresholds of 0 would need
STEPS = 10_000  # of the chance of a miss, in the dynamic program
FEW_BITS = 10  # of a partition's value, for the estimate of its candidates
SEEN = 20_000
LEVEL = 1.05  # sizes of sets of one level differ by less than this factor
CELLS = 64, 1 << 14  # in which the hashes of crowded sets are counted
ROWS_OUT = 1 << 18  # of prefixes, in a batch
AT_ONCE = 1_000_000  # links of alike sets whose components one task finds
BUCKET = 32  # distinct fingerprints in a bucket beyond which it is linked through balls


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included.

    A-Z is lower-cased, words are runs of other than ASCII white space; fewer words than a shingle are one shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many numbers of each row have each of the 64 bits: (rows, n) to (rows, 64). Full adders turn three numbers into a sum and
    a carry of twice the weight, all bits and rows at once, until few numbers of each weight are left."""
    rows = len(h)
    out, weight = np.zeros((rows, 64), np.int64), 1
    while h.shape[1]:
        carries = []
        while h.shape[1] >= 12:
            k = h.shape[1] // 3
            a, b, c = h[:, :k], h[:, k : 2 * k], h[:, 2 * k : 3 * k]
            x = a ^ b
            carries.append((a & b) | (x & c))
            h = np.concatenate([x ^ c, h[:, 3 * k :]], axis=1)
        out += weight * _bits(np.ascontiguousarray(h).ravel()).reshape(rows, -1, 64).sum(axis=1, dtype=np.int64)
        h, weight = np.concatenate(carries, axis=1) if carries else h[:, :0], 2 * weight
    return out


def _majority(h: np.ndarray) -> np.ndarray:
    """A number for each row, with the bits that over half of the row's numbers have; 0 for empty rows."""
    return np.packbits(bit_counts(h) * 2 > h.shape[1], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash, unsigned: a bit is 1 if over half of the shingles' hashes have it; 0 for a text without words."""
    return int(_majority(shingle_hashes(text, shingle, seed)[None, :])[0])


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(id, fp): one row for each row of df, fp as a signed long. A null text has fingerprint 0, as an empty one."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _fp(b: pa.RecordBatch) -> np.ndarray:
    return b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_groups(corr: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Bits in groups of the given sizes: a group starts with the most correlated pair left and takes, one by one, the bit most correlated to it."""
    left, groups = list(range(len(corr))), []
    c = np.abs(corr.copy())
    np.fill_diagonal(c, 0)
    for size in sizes:
        sub = c[np.ix_(left, left)]
        first = left[int(sub.sum(axis=1).argmax())] if size == 1 or len(left) < 2 else left[int(np.unravel_index(sub.argmax(), sub.shape)[0])]
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(left, key=lambda x: (c[x, group].mean(), -x))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _words_of(b: pa.RecordBatch, words: int) -> np.ndarray:
    """(rows, words) of a batch whose first column is an array of longs."""
    return np.array(b.column(0).flatten().to_numpy(zero_copy_only=False)).view(np.uint64).reshape(b.num_rows, words)


def _bit_groups(distinct: DataFrame, sizes: list[int], words: int = 1) -> list[list[list[int]]]:
    """For each word of fingerprints (an array column, the only one) its bits in groups of these sizes, from the correlation of
    all pairs of bits over all rows. What reaches the driver is 64 x 64 sums for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((words, 64, 64)), 0
        for b in batches:
            fp = _words_of(b, words)
            n += len(fp)
            for w in range(words):
                x = _bits(np.ascontiguousarray(fp[:, w])).astype(np.float32)
                total[w] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["cell", "n"])

    sums = distinct.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros(words * 4096 + 1)
    both[sums["cell"]] = sums["n"]
    n = max(1.0, both[-1])
    out = []
    for pair in both[:-1].reshape(words, 64, 64) / n:
        p = np.diag(pair)
        cov = pair - np.outer(p, p)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        out.append(correlated_groups(cov / np.outer(sd, sd), sizes))
    return out


def _part_values(fp: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    bits = _bits(fp).astype(np.int64)
    return [bits[:, g] @ (np.int64(1) << np.arange(len(g), dtype=np.int64)) for g in groups]


def _histogram(distinct: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """For each partition the distinct fingerprints by the low bits of its value: at most parts x 2^FOLD numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(groups) << FOLD, np.int64)
        for b in batches:
            for i, v in enumerate(_part_values(_fp(b), groups)):
                total += np.bincount((v & ((1 << FOLD) - 1)) + (i << FOLD), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    sums = distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(groups) << FOLD)
    out[sums["cell"]] = sums["n"]
    return list(out.reshape(len(groups), -1))


def allocate(values: list[np.ndarray], widths: list[int], hist: list[np.ndarray], tau: int) -> np.ndarray:
    """Units (threshold + 1) for each fingerprint and partition, summing to tau + 1, of least estimated probes and candidates."""
    n, units = len(values[0]), tau + 1
    best = np.full((units + 1, n), np.inf)
    best[0] = 0.0
    choices = []
    for v, width, h in zip(values, widths, hist):
        fold, high = v & ((1 << FOLD) - 1), max(0, width - FOLD)
        near = sum(h[fold ^ (1 << b)] for b in range(min(FOLD, width))) + high * h[fold]
        cost = [np.zeros(n)]
        for u in range(1, units + 1):
            probes = sum(comb(width, d) for d in range(u))
            found = h[fold] + (near if u > 1 else 0) + (near * sum(comb(width, d) for d in range(2, u)) / max(1, width) if u > 2 else 0)
            cost.append(probes + found / 2.0**high)
        new, pick = np.full((units + 1, n), np.inf), np.zeros((units + 1, n), np.int8)
        for total in range(units + 1):
            for u in range(total + 1):
                c = best[total - u] + cost[u]
                better = c < new[total]
                new[total] = np.where(better, c, new[total])
                pick[total] = np.where(better, u, pick[total])
        choices.append(pick)
        best = new
    out = np.zeros((n, len(values)), np.int8)
    left, rows = np.full(n, units), np.arange(n)
    for i in reversed(range(len(values))):
        out[:, i] = choices[i][left, rows]
        left = left - out[:, i]
    return out


def _flips(width: int, distance: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for d in range(distance + 1) for c in combinations(range(width), d)], np.int64)


def _keyed(distinct: DataFrame, groups: list[list[int]], hist: list[np.ndarray] | None, tau: int) -> DataFrame:
    """(part, value, fp): with hist the probes of each fingerprint, without it each partition's own value."""
    widths = [len(g) for g in groups]
    flips = {(i, u): _flips(w, u - 1) for i, w in enumerate(widths) for u in range(1, tau + 2)} if hist else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _fp(b)
            values = _part_values(fp, groups)
            units = allocate(values, widths, hist, tau) if hist else np.ones((len(fp), len(groups)), np.int8)
            for i, v in enumerate(values):
                for u in range(1, tau + 2):
                    at = np.flatnonzero(units[:, i] == u)
                    if len(at):
                        keys = v[at, None] ^ flips[i, u][None, :] if hist else v[at, None]
                        k = keys.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) * k, i, np.int32)), pa.array(keys.ravel()), pa.array(np.repeat(fp[at], k).view(np.int64))], ["part", "value", "fp"])

    return distinct.select("fp").mapInArrow(run, "part int, value long, fp long")


def _ball_links(fps: DataFrame, tau: int) -> DataFrame:
    """Links that connect all fingerprints within tau of one another, through the keys their balls share.

    Balls of radius tau // 2 and of the rest of tau intersect if and only if the centres are within tau. The
    centre of a key's star is its smallest member of the smaller ball; every member of the larger one links to it.
    """
    small, large = tau // 2, tau - tau // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array([sum(1 << b for b in c) for d in range(large + 1) for c in combinations(range(64), d)], np.uint64)
        inner = np.array([bin(int(m)).count("1") <= small for m in masks])
        for b in batches:
            fp = _fp(b)
            for i in range(0, len(fp), 256):
                part = fp[i : i + 256]
                keys = (part[:, None] ^ masks[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part, len(masks)).view(np.int64)), pa.array(np.tile(inner, len(part)))], ["key", "fp", "inner"])

    keyed = fps.select("fp").mapInArrow(run, "key long, fp long, inner boolean")
    stars = keyed.groupBy("key").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("members")).where("a is not null and size(members) > 1")
    return stars.select("a", F.explode("members").alias("b")).where("a <> b")


def _even_cost(n: int, parts: int, tau: int) -> float:
    """Expected probes and candidates of each of n uniform fingerprints when the units are shared out evenly."""
    width, extra = 64 // parts, (tau + 1) % parts
    each = [(tau + 1) // parts + (i < extra) for i in range(parts)]
    return sum(sum(comb(width, d) for d in range(u)) * (1 + n / 2.0**width) for u in each)


def links(distinct: DataFrame, tau: int = 2, parts: int | None = None) -> DataFrame:
    """(a, b) links among distinct fingerprints (a column fp, computed once beforehand) within tau bits.

    Every fingerprint within tau of another is linked to it, directly or through a star whose links all hold. parts:
    partitions of the bits; by default as many as keep probes and uniform candidates fewest.
    """
    if parts is None:
        n = distinct.count()
        parts = min((2, 3, 4), key=lambda m: _even_cost(n, m, tau))
    groups = _bit_groups(distinct.select(F.array("fp")), [64 // parts + (i < 64 % parts) for i in range(parts)])[0]
    hist = _histogram(distinct, groups)
    index, probes = cut(_keyed(distinct, groups, None, tau)), cut(_keyed(distinct, groups, hist, tau))
    hot = cut(index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("part", "value"))
    on = ["part", "value"]
    cold = (
        probes.join(index.join(hot, on, "left_anti").withColumnRenamed("fp", "other"), on)
        .where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= tau))
        .select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    )
    crowded = index.join(hot, on, "left_semi").select("fp").union(probes.join(hot, on, "left_semi").select("fp")).distinct()
    return cold.union(_ball_links(crowded, tau)).distinct()


# similarity of sets of shingles: wide fingerprints, thresholds by dynamic programming for a stated chance of a miss


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's distinct word shingles, ascending; words as in shingle_hashes."""
    _, _, h = words((text or "").encode("utf-8", "replace"), NOT_SPACE)
    return np.unique(shingles(h, min(shingle, max(1, len(h)))))


def wide_fingerprint(h: np.ndarray, n_words: int) -> np.ndarray:
    """SimHash of n_words x 64 bits of a set of hashes, each word from hashes of its own."""
    total = np.zeros((n_words, 64), np.int64)
    salt = mix(np.arange(1, n_words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for i in range(0, len(h), 2048):
        total += bit_counts(mix(h[None, i : i + 2048] ^ salt))
    return np.packbits(total * 2 > len(h), axis=1, bitorder="little").view("<u8")[:, 0]


def bit_differs(similarity: float) -> float:
    """Chance that a fingerprint bit differs between two sets of that Jaccard similarity (of equal size, where it is greatest)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def caught(width: int, threshold: int, differs: float) -> float:
    """Chance that a partition of that many bits differs in at most threshold of them; -1: never looked at."""
    return sum(comb(width, d) * differs**d * (1 - differs) ** (width - d) for d in range(threshold + 1))


class Shape:
    """How wide partitions of n fingerprints are, and how many 128-bit blocks of fingerprint leave the allocation a choice."""

    def __init__(self, n: int, similarity: float, miss: float):
        self.differs, self.need = bit_differs(similarity), math.log(1 / miss)
        self.width = min(MAX_WIDTH, max(10, math.ceil(math.log2(max(2, n))) + SPARE_BITS))
        self.per_block = 2 * 64 // self.width
        each = -math.log1p(-caught(self.width, 0, self.differs))
        self.blocks = math.ceil(CHOICE * self.need / each / self.per_block)


def thresholds(cost: np.ndarray, gain: np.ndarray, need: float) -> np.ndarray:
    """The threshold of each partition (-1, 0, 1) of least cost in all whose gains add up to need.

    cost, gain: (partitions, 2) of thresholds 0 and 1. Gains are logarithms of the chances of a miss, so they add; they count in
    steps, rounded down. By dynamic programming over partitions and what is still needed."""
    steps = np.floor(gain / need * STEPS).astype(int)
    best = np.full(STEPS + 1, np.inf)
    best[0] = 0.0
    picks = []
    for (c0, c1), (g0, g1) in zip(cost, steps):
        new, pick = best.copy(), np.full(STEPS + 1, -1, np.int8)
        for t, (c, g) in enumerate(((c0, g0), (c1, g1))):
            reached = np.minimum(np.arange(STEPS + 1) + g, STEPS)
            total = np.full(STEPS + 1, np.inf)
            np.minimum.at(total, reached, best + c)
            better = total < new
            new, pick = np.where(better, total, new), np.where(better, t, pick)
        picks.append((best, pick))
        best = new
    if not np.isfinite(best[STEPS]):
        return np.ones(len(cost), np.int8)
    out, at = np.full(len(cost), -1, np.int8), STEPS
    for i in reversed(range(len(cost))):
        before, pick = picks[i]
        out[i] = t = pick[at]
        if t >= 0:  # the cheapest state before from which this one is reached
            g = steps[i][t]
            at = at - g if at < STEPS else max(0, STEPS - g) + int(before[max(0, STEPS - g) :].argmin())
    return out


def _blocks_of(b: pa.RecordBatch, blocks: int) -> np.ndarray:
    """(blocks, rows, 128) bits of a batch whose column `fp` is an array of longs."""
    fp = b.column(b.schema.get_field_index("fp")).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(b.num_rows, -1)
    return np.stack([np.concatenate([_bits(np.ascontiguousarray(fp[:, 2 * i + j])) for j in range(2)], axis=1) for i in range(blocks)])


def _sums(df: DataFrame, rows: int, width: int, add) -> np.ndarray:
    """Sums over all rows of df of what add(batch) gives, an array (rows, width): added up in each task, whose rows then meet packed."""

    def packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], ["row", "sums"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for b in batches:
            if b.num_rows:
                total += add(b)
        yield packed(dict(enumerate(total)))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(x, "<i8")
                sums[i] = sums[i] + x if i in sums else x
        yield packed(sums)

    out = np.zeros((rows, width))
    got = df.mapInArrow(each, "row int, sums binary").repartition("row").mapInArrow(together, "row int, sums binary").toArrow()
    for i, x in zip(got["row"].to_pylist(), got["sums"].to_pylist()):
        out[i] = np.frombuffer(x, "<i8")
    return out


def _partitions(classes: DataFrame, shape: Shape) -> tuple[list[tuple[int, list[int]]], np.ndarray]:
    """(block, bits) of each partition, correlated bits together, and its threshold. What reaches the driver are sums over all
    fingerprints: of each pair of bits of a block, and of 2^FEW_BITS cells of each partition."""
    blocks, width = shape.blocks, shape.width
    n = max(1, classes.count())

    upper = np.triu_indices(128)

    def pairs_of_bits(b: pa.RecordBatch) -> np.ndarray:
        x = _blocks_of(b, blocks).astype(np.float32)
        return (x.transpose(0, 2, 1) @ x)[:, upper[0], upper[1]]

    parts = []
    for i, half in enumerate(_sums(classes.select("fp"), blocks, len(upper[0]), pairs_of_bits) / n):
        pair = np.zeros((128, 128))
        pair[upper] = pair.T[upper] = half
        p = np.diag(pair)
        sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
        parts += [(i, g) for g in correlated_groups((pair - np.outer(p, p)) / np.outer(sd, sd), [width] * shape.per_block)]

    def cells_of(b: pa.RecordBatch) -> np.ndarray:
        bits = _blocks_of(b, blocks).astype(np.float32)
        powers = (1 << np.arange(FEW_BITS)).astype(np.float32)
        return np.stack([np.bincount((bits[i][:, g[:FEW_BITS]] @ powers[: len(g)]).astype(np.int64), minlength=1 << FEW_BITS) for i, g in parts])

    cells = _sums(classes.select("fp"), len(parts), 1 << FEW_BITS, cells_of)
    alike = (cells * cells).sum(axis=1) / n / 2.0 ** (width - FEW_BITS)  # candidates of a fingerprint, were the other bits even
    cost = np.stack([1 + alike, width * (1 + 2 * alike)], axis=1)
    gain = np.tile([-math.log1p(-caught(width, t, shape.differs)) for t in (0, 1)], (len(parts), 1))
    return parts, thresholds(cost, gain, shape.need)


def _entries(classes: DataFrame, parts: list[tuple[int, list[int]]], chosen: np.ndarray, shape: Shape) -> DataFrame:
    """(key, node): each partition's value where its threshold is 0; where it is 1, the value with each one of its bits left out,
    which two values share if and only if they differ in no other bit. Small sets also have the keys of their prefixes."""
    blocks, width = shape.blocks, shape.width
    looked = [(i, *parts[i], int(t)) for i, t in enumerate(chosen) if t >= 0]
    powers = (1 << np.arange(width)).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                b = whole.slice(low, 4096)
                node = b.column(0).to_numpy(zero_copy_only=False)
                bits = _blocks_of(b, blocks)
                keys, nodes = [], []
                for i, block, g, t in looked:
                    v = (bits[block][:, g] @ powers).astype(np.int64)
                    for j in range(width) if t else (0,):
                        keys.append(((64 * i + j) << MAX_WIDTH) | (v & ~(1 << j) if t else v))
                        nodes.append(node)
                small = b.column(2)
                sizes = np.diff(small.offsets.to_numpy())
                keys.append(small.flatten().to_numpy(zero_copy_only=False) | np.int64(-1 << 63))
                nodes.append(np.repeat(node, sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["key", "node"])

    return classes.select("node", "fp", "small").mapInArrow(run, "key long, node long")


def _sets(texts: DataFrame, kind: str, shingle: int, similarity: float, n_words: int) -> DataFrame:
    """(id, text_hash, sig, n, fp, small): a text's set of shingles by its hash, its size, its wide fingerprint (null where the task has given it for a
    copy), and, of a set of few, the hashes that come first, of which two sets as alike as that share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a full memory costs repeats, no more
        for b in batches:
            sigs, sizes, fps, smalls = [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingle_set(t, shingle)
                sig = xxh64_intdigest(h.tobytes(), 7)
                sigs.append(sig)
                sizes.append(len(h))
                if sig in seen:
                    fps.append(None)
                    smalls.append(None)
                    continue
                if len(seen) < SEEN:
                    seen.add(sig)
                fps.append(wide_fingerprint(h, n_words).view(np.int64))
                smalls.append(h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].view(np.int64) if len(h) <= SMALL / similarity else h[:0].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(sigs, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(fps, pa.list_(pa.int64())), pa.array(smalls, pa.list_(pa.int64()))],
                ["id", "text_hash", "sig", "n", "fp", "small"],
            )

    return texts.select("id", "text_hash", "text").mapInArrow(run, f"id {kind}, text_hash long, sig long, n int, fp array<long>, small array<long>")


def _may_be_alike(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and first 256 bits allow it (four standard deviations; sets of few pass)."""
    differs = bit_differs(similarity)
    most = math.ceil(256 * differs + 4 * math.sqrt(256 * differs * (1 - differs)))
    x, y = (classes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), *[F.col("fp")[i].alias(f"{c}_{i}") for i in range(4)]) for c in ("a", "b"))
    apart = sum(F.bit_count(F.col(f"a_{i}").bitwiseXOR(F.col(f"b_{i}"))) for i in range(4))
    least, greatest = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    return pairs.join(x, "a").join(y, "b").where((least >= similarity * greatest - 1e-9) & ((apart <= most) | (greatest <= SMALL / similarity))).select("a", "b")


def _members(nodes: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, members) of the distinct nodes: their sets, hashes cut to 32 bits, ascending."""
    wanted = stored(classes.select("node", "sig", F.col("cid").alias("id")).join(nodes, "node", "left_semi"), "wanted")
    rows = wanted.join(only_ids(texts, wanted.select("id")), "id").select("node", "sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(2).to_pylist()]
            right = [xxh64_intdigest(h.tobytes(), 7) for h in sets] if sets else []  # rows that repeat an id may have other texts
            ok = np.array(right, np.uint64).view(np.int64) == b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array([np.unique(h.astype(np.uint32)).tobytes() for h, k in zip(sets, ok) if k], pa.binary())], ["node", "members"])

    return stored(rows.mapInArrow(run, "node long, members binary"), "sets").dropDuplicates(["node"])


def _alike(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have that Jaccard similarity, by the sets themselves."""
    pairs = stored(_may_be_alike(pairs, classes, similarity), "pairs")
    held = _members(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, texts, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(same >= similarity * (len(both) - same) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (held.select(F.col("node").alias(c), F.col("members").alias(m)) for c, m in (("a", "x"), ("b", "y")))
    return stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def _pairs_within(buckets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different roots that meet in a bucket (key, node, size, root). Buckets of more than BLOCK are met in blocks."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    p = buckets.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).alias("p")
    q = buckets.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).alias("q")
    on = (F.col("p.key") == F.col("q.key")) & (F.col("p.block") == F.col("q.block")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.root") != F.col("q.root"))
    return p.join(q, on).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()


def _level(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / math.log(LEVEL)).astype(np.int64)


def prefix_keys(members: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, longer) under which a set, its hashes in an order that all sets share, meets the sets that may be as alike as that.

    Sets of m <= n hashes that are as alike have share * (m + n) in common, and what comes before the first of these is not in common: neither has it
    behind the place that leaves so many. So the shorter one needs no place of more than n - 2 * share * n, the longer one, for each
    level of the other's size, those that leave enough for it. Keys are the hash and the level of the shorter one's size."""
    n, share = len(members), similarity / (1 + similarity)
    own = np.arange(int(n - 2 * share * n + 1e-6) + 1)
    at = np.arange(int(n - similarity * n + 1e-6) + 1)
    most = _level(np.clip(np.floor((n - at) / share - n + 1e-6), 1, n))
    keys, places = [members[own].astype(np.int64) | _level(np.array([n])) << 32], [own]
    for level in range(int(_level(np.array([max(1, math.ceil(similarity * n - 1e-6))]))[0]), int(most[0]) + 1):
        there = at[most >= level]
        keys.append(members[there].astype(np.int64) | level << 32)
        places.append(there)
    key = np.concatenate(keys)
    return key, np.concatenate(places), np.arange(len(key)) >= len(own)


def _prefix_pairs(crowd: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of different roots among all sets of the buckets (key, node, size, root), whatever bucket they are in: all that are as
    alike as that and few others, without all pairs of a bucket.

    Each set is ordered by how often its hashes are in all these sets, counted in cells, seldom ones first; two meet in prefixes (prefix_keys). What a
    crowd shares comes last: those that differ from it in more than a prefix meet nothing by it. Two that met in the hash before (`last`) don't meet again."""
    nodes = crowd.select("node", "root").distinct()
    held = _members(nodes.select("node"), classes, texts, shingle)

    def cells_of(b: pa.RecordBatch) -> np.ndarray:
        flat = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32)
        return np.bincount(flat % (CELLS[0] * CELLS[1]), minlength=CELLS[0] * CELLS[1]).reshape(CELLS)

    often = _sums(held.select("members"), *CELLS, cells_of).ravel().astype(np.int64)
    names = ["key", "node", "root", "n", "at", "last", "longer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if name in ("n", "at") else c) for name, c in zip(names, cols)], names)

        for b in batches:
            for node, root, h in zip(*(b.column(i).to_pylist() for i in range(3))):
                h = np.frombuffer(h, np.uint32)
                h = h[np.lexsort((h, often[h % len(often)]))]
                key, at, longer = prefix_keys(h, similarity)
                rows.append((key, np.full(len(key), node), np.full(len(key), root), np.full(len(key), len(h)), at, np.where(at > 0, h[at - 1].astype(np.int64), -1 - longer), longer))
                size += len(key)
                if size > ROWS_OUT:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    met = stored(held.join(nodes, "node").select("node", "root", "members").mapInArrow(run, "key long, node long, root long, n int, at int, last long, longer boolean"), "prefixes")
    x, y = met.where("not longer").alias("x"), met.where("longer").alias("y")
    need = (F.col("x.n") + F.col("y.n")) * F.lit(similarity / (1 + similarity)) - 1e-6
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.struct("x.n", "x.node") < F.struct("y.n", "y.node"))
    on &= (F.col("x.last") != F.col("y.last")) & (F.col("x.n") - F.col("x.at") >= need) & (F.col("y.n") - F.col("y.at") >= need)
    return x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _stars(buckets: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs (a, b) of one member of each bucket, another one each turn, with those of other roots."""
    pick = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("by"), "node", "root"))
    p, q = buckets.groupBy("key").agg(pick.alias("s")).select("key", "s.node", "s.root").alias("p"), buckets.alias("q")
    on = (F.col("p.key") == F.col("q.key")) & (F.col("p.root") != F.col("q.root"))
    return p.join(q, on).select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def similar(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8, miss: float = 0.01) -> DataFrame:
    """(id, text_hash, component_id) of each row of df, text_hash the XXH64 of its text: components of documents whose sets of `shingle`-word shingles have a Jaccard
    similarity of `similarity` or more. What links is decided by the sets; of pairs that are just as alike as that, `miss` are not
    looked at, of those more alike fewer, however many documents there are.

    A wide SimHash is cut into partitions of correlated bits. Partitions are as wide as the number of documents asks for, and the
    fingerprint has as many bits as then give the dynamic program a choice: it hands out thresholds (not looked at, 0 or 1 bits) of
    least estimated candidates whose chances of a miss multiply to `miss`. Sets of up to SMALL shingles, too few for a majority to
    tell much, also meet exactly, in the hashes of their prefixes.

    Candidates meet in a bucket. In one of more than FEW, one member after another is compared with the rest, as long as that spares pairs (what is
    in one component needs no comparison). Then all pairs across components are, or, where these are very many, the sets of all such buckets meet in
    prefixes, exactly (_prefix_pairs). No pair is left out.
    Copies are one class. Null and empty texts are alike; a null id is in no component (null) unless its text has others. Rows that
    repeat an id with different texts are rows of their own. No other columns are read.
    """
    with passing(df.sparkSession):
        return stored(_similar(df, text_col, id_col, shingle, similarity, miss), "components", stays=True)


def _similar(df: DataFrame, text_col: str, id_col: str, shingle: int, similarity: float, miss: float) -> DataFrame:
    """similar(), to be computed as long as its tables are there."""
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text")).withColumn("text_hash", F.xxhash64("text"))
    shape = Shape(texts.count(), similarity, miss)
    sets = stored(_sets(texts, kind, shingle, similarity, 2 * shape.blocks), "sketches")
    named = sets.where("id is not null").groupBy("sig").agg(F.min("id").alias("cid"))
    sketches = sets.where("fp is not null and n > 0").select("sig", "n", "fp", "small").dropDuplicates(["sig"])
    classes = stored(sketches.join(named, "sig").withColumn("node", F.monotonically_increasing_id()), "classes")
    free_shuffles(spark)

    parts, chosen = _partitions(classes, shape)
    entries = _entries(classes, parts, chosen, shape)
    shared = stored(entries.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("size > 1"), "buckets")
    free_shuffles(spark)
    crowd = shared.where(F.col("size") > FEW)
    centre = crowd.groupBy("key").agg(F.min("node").alias("a"))
    first = crowd.join(centre, "key").where("node <> a").groupBy("node").agg(F.max_by("a", F.struct("size", "a")).alias("a")).select("a", F.col("node").alias("b"))
    found = _alike(first, classes, texts, shingle, similarity)
    root, turn, crowd = cut(components(found, at_once=AT_ONCE)), 0, shared
    while True:
        known = crowd.select("key", "node", "size").join(root.select("node", F.col("component").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = known.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("own"))
        crowd = stored(known.join(sizes.where("m * m > own"), "key"), "crowd")
        open_ = crowd.where(F.col("size") > FEW)
        rows, left = open_.groupBy("key").agg(F.max("m").alias("m"), F.max((F.col("m") * F.col("m") - F.col("own")) / 2).alias("left")).agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("left"), F.lit(0))).head()
        turn += 1
        crowded = left > 8 * rows
        last = turn > TURNS or not crowded
        pairs = _prefix_pairs(crowd, classes, texts, shingle, similarity) if last and crowded else _pairs_within(crowd if last else crowd.where(F.col("size") <= FEW))
        if not last:
            pairs = pairs.union(_stars(open_, turn)).distinct()
        found = found.union(_alike(pairs, classes, texts, shingle, similarity))
        root = cut(components(found, at_once=AT_ONCE))
        free_shuffles(spark)
        if last:
            break
        crowd = open_

    named = classes.select("sig", "cid", "node").join(root, "node", "left").select("sig", "cid", F.coalesce("component", "node").alias("root"))
    roots = named.groupBy("root").agg(F.min("cid").alias("component_id"))
    of_set = named.join(roots, "root").select("sig", "component_id")
    empty = sets.where("n = 0 and id is not null").groupBy("sig").agg(F.min("id").alias("component_id"))
    return sets.select("id", "text_hash", "sig").join(of_set.union(empty.select("sig", "component_id")), "sig", "left").select(F.col("id").alias(id_col), "text_hash", "component_id")


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, tau: int = 2) -> DataFrame:
    """One row for each row of df: the id, fingerprint (16 hex digits) and component_id, the smallest id reachable
    through fingerprints that differ in at most tau bits.

    Equal fingerprints are one class from the start, so copies cost nothing. Null and empty texts have fingerprint
    zero and link like any other; a null id joins its class but names none (component_id is null if a component has no
    other id); repeated rows repeat; other columns are not read.
    """
    fps = cut(fingerprints(df, text_col, id_col, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    root = cut(components(links(distinct, tau)))
    rooted = distinct.join(root, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(classes, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
