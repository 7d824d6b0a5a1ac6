import random

import pytest
import sentencepiece

from astrolith.llm import pieces as p


@pytest.fixture(scope="module")
def coder():
    return p.Encoder(p.Transducer(p.read_model(p.default_model())))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=p.default_model())


def samples():
    rnd = random.Random(0)
    odd = [chr(c) for c in range(1, 0x250)] + list("日本語한국어😀𝔘▁  \n\tñé العربية हिन्दी")
    plain = list("abcdefghijklmnopqrstuvwxyz    '-.")
    out = ["", " ", "  ", "Hello  wörld\n\t x ", "aaaa bbbb" * 50, "a" * 700, "hello" * 40, "日本" * 60, "<s></s><0x0A>", "\0a"]
    return out + ["".join(rnd.choice(odd if rnd.random() < 0.3 else plain) for _ in range(rnd.randrange(90))) for _ in range(600)]


def test_ids_equal_the_library_and_decode_back(coder, library):
    texts = samples()
    for t, ids in zip(texts, coder.encode_batch(texts)):
        assert ids.tolist() == library.encode(t), t
        if "▁" not in t:
            assert coder.decode(ids) == t.encode()


def test_unigram_weights():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "▁ab", "abab"]
    scores = [0, -3.0, -2.0, -2.5, -2.2, -2.6, -4.5, -3.9]
    m = p.Model(pieces, scores, [p.UNKNOWN] + [p.NORMAL] * 7, False, True, True)
    t = p.Transducer(m)
    ((_, path, ends),) = t.shortest(["▁abab"])
    assert ends.tolist() == [len(path)]
    got = [t.model.pieces[i] for i in path]
    best = {}

    def walk(text, cost, path):
        if not text:
            best[tuple(path)] = cost
        for q, s in zip(pieces[1:], scores[1:]):
            if text.startswith(q):
                walk(text[len(q) :], cost - s, [*path, q])

    walk("▁abab", 0, [])
    assert tuple(got) == min(best, key=best.get)


def test_frame(spark, library):
    rows = [(1, "Grüße  an alle", 1), (2, None, 1), (3, "", 1), (None, "x", 1), (1, "Grüße  an alle", 1)]
    enc = p.encode(spark.createDataFrame(rows, "doc_id long, text string, ids long"), p.default_model())
    got = enc.collect()
    assert sorted((str(r.doc_id), r.ids) for r in got if r.ids is not None) == sorted((str(i), library.encode(t)) for i, t, _ in rows if t is not None)
    assert [r.exact for r in got if r.doc_id == 2] == [None] and all(r.exact for r in got if r.ids is not None)
    back = {r.doc_id: r.text for r in p.decode(enc, p.default_model()).collect()}
    assert back == {1: "Grüße  an alle", 2: None, 3: "", None: "x"}
    assert p.digest(p.encode(spark.createDataFrame([], "doc_id long, text string"), p.default_model())).count() == 0
