"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

A text is cut where no piece can cross (before a run of spaces, around line breaks). Of the resulting words each
is searched once: words of equal length form one matrix and advance together. Substring hashes, differences of
prefix hashes, probe the sorted keys of the pieces; a row-wise maximum over all starts of the last piece stores
score and backpointer. Pieces, scores, dummy prefix and byte fallback are the model file's own; the segmentation
is the one of greatest total score (the unigram criterion), ties going to the longer last piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import small_batches

SPACE = "▁"
#: Words whose ids a worker remembers; emptied when full.
REMEMBERED = 250_000
REMEMBERED_BYTES = 64_000_000
#: Cells of a matrix of substring hashes at once.
CELLS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str) -> dict:
    """The parts of a SentencePiece model file that encoding needs, as plain values that travel to executors."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    raw = open(path, "rb").read()
    proto = pb.ModelProto()
    proto.ParseFromString(raw)
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    pieces, scores, kinds = [], [], []
    for p in proto.pieces:
        pieces.append(p.piece)
        scores.append(p.score)
        kinds.append(p.type)
    return {
        "pieces": pieces,
        "scores": scores,
        "kinds": kinds,
        "dummy_prefix": bool(proto.normalizer_spec.add_dummy_prefix),
        "byte_fallback": bool(proto.trainer_spec.byte_fallback),
        "unk": model.unk_id(),
    }


class PieceCodec:
    """Encodes words to ids and ids to texts. model: what load_pieces() gives."""

    NORMAL, BYTE, USER = 1, 6, 4

    def __init__(self, model: dict):
        self.model, self.pieces = model, model["pieces"]
        usable = [(p, s, i) for i, (p, s, k) in enumerate(zip(model["pieces"], model["scores"], model["kinds"])) if k in (self.NORMAL, self.USER)]
        self.longest = max(len(p) for p, _, _ in usable)
        self.power = _BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        keys = np.array([self._hash(p) for p, _, _ in usable], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a key")
        self.keys = keys[order]
        self.scores = np.array([s for _, s, _ in usable])[order]
        self.ids = np.array([i for _, _, i in usable], dtype=np.int32)[order]
        self.unk_score = min(s for _, s, _ in usable) - 10.0
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if model["byte_fallback"] else None
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in usable):
            raise ValueError("a piece has a space after other characters; words can't be cut at spaces")
        line = "\n" if all("\n" not in p or len(p) == 1 for p, _, _ in usable) else ""
        self._words = re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (f"|{line}" if line else "")).findall
        self._known: dict[str, bytes] = {}
        self._held = 0  # bytes of known words and their ids
        self._bytes = [self._piece_bytes(i) for i in range(len(self.pieces))]

    def _hash(self, piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * _BASE + np.uint64(ord(c) + 1)
        return h[0]

    def _piece_bytes(self, i: int) -> bytes:
        kind, piece = self.model["kinds"][i], self.pieces[i]
        if kind == self.BYTE:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode() if kind in (self.NORMAL, self.USER) else b" \xe2\x81\x87 " if i == self.model["unk"] else b""

    def words(self, text: str) -> list[str]:
        return self._words((SPACE if self.model["dummy_prefix"] and text else "") + text.replace(" ", SPACE))

    def encode_batch(self, texts: list[str | None]) -> list[bytes | None]:
        """For each text its ids as bytes of little-endian int32; null gives null."""
        if len(self._known) > REMEMBERED or self._held > REMEMBERED_BYTES:
            self._known.clear()
            self._held = 0
        cut = [None if t is None else self.words(t) for t in texts]
        new = {w for ws in cut if ws for w in ws}.difference(self._known)
        self._learn(new)
        known = self._known
        return [None if ws is None else b"".join([known[w] for w in ws]) for ws in cut]

    def _learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            step = max(1, CELLS // n // 4)
            for i in range(0, len(group), step):
                self._search(group[i : i + step], n)

    def _search(self, group: list[str], n: int) -> None:
        """Viterbi over words of n characters each."""
        chars = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, n)
        k = len(chars)
        prefix = np.zeros((k, n + 1), np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * _BASE + (chars[:, i].astype(np.uint64) + np.uint64(1))
        best = np.zeros((k, n + 1))
        start = np.zeros((k, n + 1), np.int64)
        piece = np.zeros((k, n + 1), np.int32)
        rows = np.arange(k)
        for end in range(1, n + 1):
            first = max(0, end - self.longest)
            lengths = end - np.arange(first, end)
            probe = prefix[:, end, None] - prefix[:, first:end] * self.power[lengths]
            at = np.searchsorted(self.keys, probe)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == probe
            score = np.where(hit, self.scores[at], -np.inf)
            score[:, -1] = np.where(hit[:, -1], score[:, -1], self.unk_score)
            total = best[:, first:end] + score
            pick = total.argmax(axis=1)  # the first of equals: the longest piece
            best[:, end] = total[rows, pick]
            start[:, end] = pick + first
            piece[:, end] = np.where(hit[rows, pick], self.ids[at[rows, pick]], -1)
        out = np.full((k, n), -2, np.int32)
        where = np.zeros((k, n), np.int64)
        end = np.full(k, n)
        for step in range(n):
            live = np.flatnonzero(end > 0)
            if not len(live):
                break
            out[live, step] = piece[live, end[live]]
            end[live] = start[live, end[live]]
            where[live, step] = end[live]
        used = (out != -2).sum(axis=1)
        unknown = (out == -1).any(axis=1)
        for r, w in enumerate(group):
            ids = out[r, : used[r]][::-1]
            if unknown[r]:
                full: list[int] = []
                for i, p in zip(ids.tolist(), where[r, : used[r]][::-1].tolist()):
                    if i >= 0:
                        full.append(i)
                    elif self.byte_ids:
                        full += [self.byte_ids[b] for b in w[p].encode("utf-8", "replace")]
                    else:
                        full.append(self.model["unk"])
                ids = np.array(full, np.int32)
            got = self._known[w] = ids.astype("<i4").tobytes()
            self._held += 4 * len(w) + len(got)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        of = self._bytes
        text = b"".join([of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model["dummy_prefix"] and text.startswith(" ") else text


def encode(df: DataFrame, model: dict, text_col: str = "text", id_col: str = "doc_id", check: bool = True) -> DataFrame:
    """One row for each row of df: the id, ids array<int>, n_tokens and, with check, round_trip.

    round_trip tells whether decoding the ids gives the text again (a literal "▁" in a text is read as a space,
    so such a text does not). No shuffle; whole texts. A null text gives null ids, 0 tokens and null round_trip, an
    empty one no ids; repeated rows repeat; other columns are not read.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            got = codec.encode_batch(texts)
            n = np.array([len(g) // 4 if g is not None else 0 for g in got], np.int64)
            flat = pa.array(np.frombuffer(b"".join(g or b"" for g in got), "<i4"), pa.int32())
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.int32(), mask=np.array([g is None for g in got] + [False]))
            cols, names = [b.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array(n)], [id_col, "ids", "n_tokens"]
            if check:
                cols.append(pa.array([None if t is None else codec.decode(np.frombuffer(g, "<i4").tolist()) == t for t, g in zip(texts, got)], pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens long" + (", round_trip boolean" if check else ""))


def decode(df: DataFrame, model: dict, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of df: the id and the text of its ids (null for null)."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else codec.decode(x) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, text string")
