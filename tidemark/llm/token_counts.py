"""Token counts: greedy longest-match word pieces, counted in linear time without building any piece.

A trie holds the vocabulary twice over: word-initial pieces from the root, continuation pieces from a second
root that stands for the "##" prefix. Each node carries a failure link and the number of pieces that are
popped when the link is taken, both computed once, breadth first. Walking a word then costs one step for each
of its characters plus one for each piece, however long the overlap of pieces is.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import small_batches

#: Words whose counts a worker remembers; the memory is emptied when full, never wrong.
REMEMBERED = 400_000
REMEMBERED_BYTES = 64_000_000


def _punctuation() -> str:
    """All punctuation as the inside of a character class: Unicode P*, and the ASCII symbols."""
    marks = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "P" or (33 <= c < 127 and not chr(c).isalnum())]
    return "".join(re.escape(c) for c in marks)


class WordPieceCounter:
    """Counts the pieces of words and texts.

    vocabulary: word-initial pieces as they are, continuation pieces with `prefix` before them.
    A word that the greedy match cannot finish is one unknown piece.
    """

    def __init__(self, vocabulary: Iterable[str], prefix: str = "##"):
        self.children: list[dict[str, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.pops: list[int] = [0, 0]
        ends: set[int] = set()
        for piece in vocabulary:
            node, rest = (1, piece[len(prefix) :]) if piece.startswith(prefix) and len(piece) > len(prefix) else (0, piece)
            if not rest:
                continue
            for c in rest:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][c] = nxt
                    self.children.append({})
                    self.fail.append(-1)
                    self.pops.append(0)
                node = nxt
            ends.add(node)
        self._link(ends)
        self._known: dict[str, int] = {}
        self._held = 0  # bytes of known words
        self._split = re.compile(f"[{(p := _punctuation())}]|[^\\s{p}]+").findall

    def _link(self, ends: set[int]) -> None:
        """Failure links, nearer nodes first: the link of a node rests on those of its parent's chain."""
        waiting = deque([0, 1])
        while waiting:
            parent = waiting.popleft()
            for c, node in self.children[parent].items():
                if node in ends:  # the whole path is a piece: pop it and go on at "##"
                    self.fail[node], self.pops[node] = 1, 1
                else:
                    at, popped = self.fail[parent], self.pops[parent]
                    while at >= 0 and c not in self.children[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.pops[node] = self.children[at][c], popped
                waiting.append(node)

    def word(self, word: str) -> int:
        """Pieces of one word; 0 for the empty word."""
        children, fail, pops = self.children, self.fail, self.pops
        node = count = 0
        for c in word:
            while (nxt := children[node].get(c)) is None:
                if fail[node] < 0:
                    return 1
                count += pops[node]
                node = fail[node]
            node = nxt
        while node > 1:  # what is left on the path has to end at the "##" root
            if fail[node] < 0:
                return 1
            count += pops[node]
            node = fail[node]
        return count

    def words(self, text: str) -> list[str]:
        """Words are runs of other than white space; each punctuation mark is a word of its own."""
        return self._split(text)

    def text(self, text: str | None) -> tuple[int, int]:
        """(words, pieces) of a text; null counts as empty."""
        if not text:
            return 0, 0
        known, pieces = self._known, 0
        found = self._split(text)
        if len(known) > REMEMBERED or self._held > REMEMBERED_BYTES:
            known.clear()
            self._held = 0
        for w, n in Counter(found).items():
            k = known.get(w)
            if k is None:
                k = known[w] = self.word(w)
                self._held += 4 * len(w)
            pieces += k * n
        return len(found), pieces


def vocabulary_from_sentencepiece(path: str) -> list[str]:
    """Word-piece vocabulary from a SentencePiece model: "▁x" begins a word, any other piece continues one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith("▁"):
            if piece.strip("▁"):
                out.append(piece.lstrip("▁"))
        else:
            out += ["##" + piece] + [piece] * (len(piece) == 1)  # a lone character may also begin a word
    return list(dict.fromkeys(out))


def token_counts(df: DataFrame, vocabulary: list[str], text_col: str = "text", id_col: str = "doc_id", prefix: str = "##") -> DataFrame:
    """One row for each row of df: the id, n_words and n_tokens.

    No shuffle, no limit on the length of words or texts. A null or empty text has 0 words and 0 tokens; repeated
    rows give repeated results; null ids pass through; other columns, whatever their names, are not read.
    """
    small_batches(df.sparkSession)
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordPieceCounter(vocabulary, prefix)
        for b in batches:
            got = [counter.text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], [id_col, "n_words", "n_tokens"]
            )

    return src.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long")
