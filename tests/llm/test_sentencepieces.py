import random

import numpy as np
import pytest

from tidemark.llm.sentencepieces import PieceCodec, decode, encode, load_pieces

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(load_pieces(PATH))


def ids(codec, text):
    return np.frombuffer(codec.encode_batch([text])[0], "<i4").tolist()


def test_against_library(codec):
    """The library's own unigram search over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:  # the library sums in 32 bits: keep the scores small enough to be exact there
        if p.score < -1e8:
            p.score = -40000.0
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    raw = load_pieces(PATH)
    raw["scores"] = [max(s, -40000.0) for s in raw["scores"]]
    own = PieceCodec(raw)
    rnd = random.Random(1)
    texts = ["Hello world", "  two  spaces\nand lines\n\n", "éêç über", "日本語のテキスト", "a", " ", "x\ty", "token = 24be64439e3e", "😀 smile"]
    texts += ["".join(rnd.choices(["th", "er", "on", " ", "é", "ing", "\n", "q", "  ", "ß"], k=40)) for _ in range(60)]
    for t in texts:
        assert ids(own, t) == lib.encode(t), t
        assert own.decode(ids(own, t)) == t


def test_brute_force(codec):
    score = {p: (s, i) for i, (p, s, k) in enumerate(zip(codec.pieces, codec.model["scores"], codec.model["kinds"])) if k == 1}
    rnd = random.Random(2)
    for _ in range(40):
        w = "▁" + "".join(rnd.choices("etaoinshr", k=rnd.randint(1, 12)))
        best = [(0.0, [])] + [None] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(e):
                if w[s:e] in score and best[s] and (best[e] is None or best[s][0] + score[w[s:e]][0] > best[e][0]):
                    best[e] = (best[s][0] + score[w[s:e]][0], best[s][1] + [score[w[s:e]][1]])
        assert ids(codec, w[1:]) == best[-1][1]


def test_frame(spark):
    m = load_pieces(PATH)
    df = spark.createDataFrame([(1, "Hi there", 4), (1, "Hi there", 4), (2, None, 1), (None, "", 2), (3, "q" * 4000, 0), (4, "a▁b", 0)], "doc_id long, text string, ids long")
    rows = {r.doc_id: r for r in encode(df, m).collect()}
    assert rows[2].ids is None and rows[2].n_tokens == 0 and rows[2].round_trip is None
    assert rows[None].ids == [] and rows[None].round_trip and rows[1].round_trip and rows[3].round_trip and not rows[4].round_trip
    assert len(rows[3].ids) == rows[3].n_tokens
    back = {r.doc_id: r.text for r in decode(encode(df, m), m).collect()}
    assert back == {1: "Hi there", 2: None, None: "", 3: "q" * 4000, 4: "a b"}
    assert encode(df.limit(0), m).count() == 0
