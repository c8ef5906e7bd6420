import random

import pytest
from tokenizers import Tokenizer
from tokenizers.models import WordPiece
from tokenizers.pre_tokenizers import BertPreTokenizer

from tidemark.llm.token_counts import WordPieceCounter, token_counts, vocabulary_from_sentencepiece


def brute(vocab, word):
    at, n = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if ("##" if at else "") + word[at:end] in vocab:
                break
        else:
            return 1
        at, n = end, n + 1
    return n


def test_against_brute_force():
    rnd = random.Random(5)
    for _ in range(200):
        vocab = {("##" if rnd.random() < 0.6 else "") + "".join(rnd.choices("abc", k=rnd.randint(1, 5))) for _ in range(rnd.randint(1, 25))}
        c = WordPieceCounter(vocab)
        for _ in range(100):
            w = "".join(rnd.choices("abcd" if rnd.random() < 0.1 else "abc", k=rnd.randint(1, 12)))
            assert c.word(w) == brute(vocab, w), (vocab, w)


def test_against_library():
    vocab = vocabulary_from_sentencepiece("/opt/tokenizers/piece_bpe_32k.model")
    t = Tokenizer(WordPiece({v: i for i, v in enumerate([*vocab, "[UNK]"])}, unk_token="[UNK]", max_input_chars_per_word=10**6))
    t.pre_tokenizer = BertPreTokenizer()
    c = WordPieceCounter(vocab)
    for s in ["The quick, brown fox!", "Élan vital — çaß", "日本語 text", "", "  a\tb\n", "x" * 5000, "don't.stop|now", "worthless%%% êeux***"]:
        assert c.text(s)[1] == len(t.encode(s, add_special_tokens=False).ids), s


def test_frame(spark):
    df = spark.createDataFrame([(1, "abab b", 9), (1, "abab b", 9), (2, None, 1), (None, "", 2), (3, "q" * 3000, 5)], "doc_id long, text string, n_tokens long")
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in token_counts(df, ["ab", "##ab", "b", "##b"]).collect())
    assert got == [("1", 2, 3), ("1", 2, 3), ("2", 0, 0), ("3", 1, 1), ("None", 0, 0)]
    assert token_counts(df.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize("word,n", [("", 0), ("##", 2), ("#", 1), ("a", 1)])
def test_edges(word, n):
    """"#" is a piece of its own, "###" continues a word with one; an unknown word is one piece."""
    assert WordPieceCounter(["#", "###"]).word(word) == n
