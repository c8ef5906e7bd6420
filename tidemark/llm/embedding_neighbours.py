"""Embedding near-duplicates by cross-polytope hashing.

Unit vectors are rotated by three rounds of random signs and a fast Hadamard transform; a hash is the signed axis
nearest to the rotated vector, a key is `width` of them, and each table has a key of its own. Every vector also enters
the buckets of its `probes` next best keys. Vectors that meet in a bucket are verified by their cosine in double
precision. Equal vectors are one class from the start.

Ids and sketches (64 signs of random projections) meet first. In buckets of up to BLOCK classes only those whose sketch is near
another's go on with their vectors; related vectors are further apart than that in one of 10^4 pairs.

A bucket's members are compared in blocks of bounded size: a bucket of more than BLOCK classes is split into blocks, each
pair of blocks a task's cell of its own. Keys are computed once for each class and travel with the vectors. A link is counted only in the first bucket where its ends meet, which both
ends' keys tell, so no pair ever leaves a cell: a cell gives counts for each class, and its links as stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, small_batches, stored
from .components import components

BLOCK = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, whatever their magnitude."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def keys(u: np.ndarray, tables: int, width: int, probes: int, seed: int = 7) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket keys of unit vectors: the nearest axes', then those that cost least, one axis changed each."""
    n, dim = u.shape
    d = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :dim] = u
    rng = np.random.default_rng([seed, d])
    out = np.zeros((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        axis, second, gap = [], [], []
        for _ in range(width):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            a = np.abs(y)
            first = a.argmax(axis=1)
            top = a[rows, first]
            a[rows, first] = -1
            next_ = a.argmax(axis=1)
            axis.append(2 * first + (y[rows, first] < 0))
            second.append(2 * next_ + (y[rows, next_] < 0))
            gap.append(top - a[rows, next_])
        base = sum(a * (2 * d) ** i for i, a in enumerate(axis))
        out[:, t, 0] = base
        order = np.argsort(np.array(gap), axis=0, kind="stable")
        for p in range(probes):
            for i in range(width):
                at = order[p] == i
                out[at, t, 1 + p] = base[at] + (second[i][at] - axis[i][at]) * (2 * d) ** i
    return out


def _first_meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of key matrices (pairs, tables, keys) the first table with a key in common and the least such key."""
    big = np.iinfo(np.int64).max
    least = np.full(a.shape[:2], big)
    for i in range(a.shape[2]):
        for j in range(b.shape[2]):
            least = np.minimum(least, np.where(a[:, :, i] == b[:, :, j], a[:, :, i], big))
    table = (least < big).argmax(axis=1)
    return table, least[np.arange(len(a)), table]


def _cell(table: int, key: int, ids: np.ndarray, weight: np.ndarray, block: np.ndarray, ks: np.ndarray, u: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked weight, centre) of each class in a cell, from the links whose first meeting this bucket is. Classes of
    different blocks only, where there are two blocks."""
    n = len(ids)
    across = block[0] != block[-1] or len(np.unique(block)) > 1
    counts, label = np.zeros(n, np.int64), np.arange(n)
    src, dst = [], []
    for i in range(0, n, 256):
        cos = u[i : i + 256] @ u.T
        a, b = np.nonzero(cos >= least)
        a = a + i
        ok = a < b
        if across:
            ok &= block[a] != block[b]
        a, b = a[ok], b[ok]
        for j in range(0, len(a), 1 << 15):
            x, y = a[j : j + (1 << 15)], b[j : j + (1 << 15)]
            at, k = _first_meeting(ks[x], ks[y])
            mine = (at == table) & (k == key)
            x, y = x[mine], y[mine]
            counts += np.bincount(x, weight[y], n).astype(np.int64) + np.bincount(y, weight[x], n).astype(np.int64)
            src.append(x)
            dst.append(y)
    if src and (total := sum(map(len, src))):
        x, y = np.concatenate(src), np.concatenate(dst)
        while total:  # ids are ascending, so the least position is the least id
            new = label.copy()
            np.minimum.at(new, x, label[y])
            np.minimum.at(new, y, label[x])
            new = new[new]
            if (new == label).all():
                break
            label = new
    return counts, ids[label]


def sketch(u: np.ndarray, seed: int) -> np.ndarray:
    """64 signs of random projections of unit vectors, as a signed number."""
    planes = np.random.default_rng([seed, 64, u.shape[1]]).standard_normal((u.shape[1], 64))
    return np.packbits(u @ planes > 0, axis=1, bitorder="little").view("<i8")[:, 0]


def sketch_radius(least: float) -> int:
    """Bits in which sketches of vectors with that cosine differ at most, by four standard deviations."""
    p = math.acos(min(1.0, max(-1.0, least))) / math.pi
    return math.ceil(64 * p + 4 * math.sqrt(64 * p * (1 - p)))


def default_shape(n: int, dim: int) -> tuple[int, int]:
    """(tables, width): keys wide enough that unrelated vectors seldom meet, and tables to make up for what wider keys miss."""
    d = 1 << max(1, (max(1, dim) - 1).bit_length())
    width = int(min(4, max(2, round(np.log(max(2, n)) / np.log(2 * d)))))
    return {2: 6, 3: 12, 4: 24}[width], width


def near_duplicates(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", least: float = 0.95, tables: int | None = None, width: int | None = None, probes: int = 2, seed: int = 7) -> DataFrame:
    """One row for each row of df: the id, n_links (other rows linked directly), component_id (the smallest id
    reachable) and kept (the id is its component's).

    Links are verified pairs with cosine >= least. A vector that is null, empty, zero or holds null or non-finite
    components links with nothing, nor does a row with a null id (n_links 0; component_id is its own id). Vectors of
    different length don't compare. Equal vectors always link. Ids are meant to be unique: rows that repeat an id
    together with its vector count as rows of their class, rows that repeat it with another vector share what the id links to.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()
    v = F.col("v")
    flat = df.schema[vector_col].dataType.elementType.simpleString() if isinstance(df.schema[vector_col].dataType, T.ArrayType) else ""
    rows = df.select(df[id_col].alias("id"), df[vector_col].cast(f"array<{flat if flat in ('float', 'double') else 'double'}>").alias("v"))
    usable = F.coalesce(F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (x == x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, v))
    merged = stored(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("w")), "vectors")
    n, dim = merged.agg(F.count(F.lit(1)), F.max(F.size("v"))).head()
    auto = default_shape(n, dim or 1)
    tables, width = tables or auto[0], width or auto[1]
    per = 1 + probes
    vtype = merged.schema["v"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            sizes = col.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                u = unit(flat[(ends[at] - d)[:, None] + np.arange(d)])
                part = b.take(pa.array(at))
                ks = pa.FixedSizeListArray.from_arrays(pa.array(keys(u, tables, width, probes, seed).ravel()), tables * per).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), d, np.int32)), ks, pa.array(sketch(u, seed))], ["v", "cid", "w", "dim", "ks", "sk"])

    classes = stored(merged.select("v", "cid", "w").mapInArrow(keyed, f"v {vtype}, cid {kind}, w long, dim int, ks array<long>, sk long"), "classes")
    bucket = ["t", "k", "dim"]
    exploded = classes.select("cid", "dim", "sk", F.posexplode("ks").alias("i", "k")).select((F.col("i") / per).cast("int").alias("t"), "k", "dim", "cid", "sk")
    entries = stored(exploded.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*bucket))).where("n > 1"), "entries")
    p, q = entries.where(F.col("n") <= BLOCK).alias("p"), entries.where(F.col("n") <= BLOCK).alias("q")
    same = F.expr(" AND ".join(f"p.{c} = q.{c}" for c in bucket)) & F.expr("p.cid <> q.cid") & (F.bit_count(F.col("p.sk").bitwiseXOR(F.col("q.sk"))) <= sketch_radius(least))
    company = p.join(q, same, "left_semi").union(entries.where(F.col("n") > BLOCK))
    # blocks of about BLOCK classes; a class of block b goes to the cells (b, j) and (j, b) of all blocks j
    g = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid", "t"), g).cast("int")
    celled = company.withColumn("g", g).withColumn("block", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    celled = celled.select(*bucket, "cid", "block", F.least("block", "j").alias("c1"), F.greatest("block", "j").alias("c2"))
    full = celled.join(classes.select("cid", "w", "v", "ks"), "cid").select(*bucket, "c1", "c2", "block", "cid", "w", "v", "ks")
    cell = [*bucket, "c1", "c2"]
    placed = full.repartition(*cell).sortWithinPartitions(*cell, "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve(c, ids, w, block, x, ks) -> pa.RecordBatch | None:
            counts, centre = _cell(int(c[0]), int(c[1]), ids, w, block, ks, unit(x), least)
            at = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(counts[at]), pa.array(centre[at])], ["cid", "n", "centre"]) if len(at) else None

        def pieces(b: pa.RecordBatch) -> Iterator[tuple]:
            c = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]).any(axis=1)) + 1, [len(c)]])
            block, ids, w = (b.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 7))
            col = b.column(8)
            flat = col.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))])
            ks = b.column(9).flatten().to_numpy(zero_copy_only=False).reshape(-1, tables, per)
            for s, e in zip(starts[:-1], starts[1:]):
                yield c[s], ids[s:e], w[s:e], block[s:e], flat[ends[s] : ends[e]].reshape(e - s, -1), ks[s:e]

        def done() -> Iterator[pa.RecordBatch]:
            if held and sum(len(h[1]) for h in held) > 1:
                got = solve(held[0][0], *(np.concatenate([h[i] for h in held]) for i in range(1, 6)))
                if got is not None:
                    yield got
            held.clear()

        for b in batches:
            for piece in pieces(b) if b.num_rows else ():
                if held and (held[0][0] != piece[0]).any():
                    yield from done()
                held.append(piece)
        yield from done()

    found = stored(placed.mapInArrow(compare, f"cid {kind}, n long, centre {kind}"), "found")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    root = components(found.where("cid <> centre"), "cid", "centre")
    named = classes.select("v", "cid", "w").join(counts, "cid", "left").join(root.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.select("v", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    out = rows.join(named, "v", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))
