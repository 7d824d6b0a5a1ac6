"""The encoder's units, its bounded memory, and what it saves, against the library."""

import random

import pytest
import sentencepiece

from astrolith.llm import pieces as p


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=p.default_model())


@pytest.fixture(scope="module")
def transducer():
    return p.Transducer(p.read_model(p.default_model()))


def texts():
    rnd = random.Random(9)
    letters, marks = "abcdefghijklmnopqrstuvwxyzéüßñ", "  .,!*#%&--'\"/_=+()[]{}<>\r\n\t0123456789"
    odd = "жшя日本据数取获ال═─😀 \0▁"
    out = ["", "▁", "  a  ", "!" * 70, "=-" * 60, "ab!" * 40, "据数" * 40, "日" * 90, "x" * 90 + "==" * 40, "ábc"]
    for _ in range(500):
        pool = letters * 3 + marks + (odd if rnd.random() < 0.4 else "")
        out.append("".join(rnd.choice(pool) for _ in range(rnd.randrange(150))))
    return out


def test_units_are_cut_between_classes_only(transducer):
    coder = p.Encoder(transducer)
    for t in texts():
        text = coder.normalise(t)
        units = coder.split.findall(text)
        assert "".join(units) == text
        assert not {a[-1] + b[0] for a, b in zip(units, units[1:])} & transducer.neighbours


@pytest.mark.parametrize("remember", [0, 1, 40, 1000])
def test_a_small_memory_gives_the_same_ids(transducer, library, remember):
    coder, rows = p.Encoder(transducer, remember), texts()
    for at in range(0, len(rows), 20):
        part = [*rows[at : at + 20], None, *rows[:5]]
        for t, ids in zip(part, coder.encode_batch(part)):
            assert (ids is None) == (t is None) and (t is None or ids.tolist() == library.encode(t)), t
        before = len(coder.number)
        coder.encode_batch([])
        assert len(coder.number) == (before if before <= remember else remember // 2) == len(coder.size) == len(coder.met)


def test_words_with_other_marks_are_solved_once(transducer, monkeypatch):
    coder, solved = p.Encoder(transducer), []
    shortest = transducer.shortest
    monkeypatch.setattr(transducer, "shortest", lambda words: (solved.extend(words), shortest(words))[1])
    coder.encode_batch(["some words", "some, words.", "some*** words!!"])
    assert sorted(w for w in solved if "some" in w) == ["▁some"] and len(solved) == len(set(solved))


def test_pairs_are_judged_once(transducer, monkeypatch):
    rows, judged = [t for t in texts() if len(t) < 400], []
    transducer._pairs = None
    may = transducer.may_follow
    monkeypatch.setattr(transducer, "may_follow", lambda a, b: (judged.append(len(a)), may(a, b))[1])
    first = [x.tolist() for x in p.Encoder(transducer).encode_batch(rows)]
    many = sum(judged)
    judged.clear()
    assert [x.tolist() for x in p.Encoder(transducer).encode_batch(rows)] == first and sum(judged) < many / 5


def test_parts_of_a_frame_and_its_nulls(spark, library, monkeypatch):
    rows = [(k, None if k % 7 == 0 else f"Zeile {k}: größer, {'x' * (k % 50)}!") for k in range(300)]
    monkeypatch.setattr(p, "TOGETHER", 500)
    got = p.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), p.default_model()).collect()
    assert [(r.doc_id, r.ids) for r in got] == [(k, None if t is None else library.encode(t)) for k, t in rows]
    assert all((r.exact, r.n_fallback is None) == ((None, True) if r.ids is None else (True, False)) for r in got)
    assert all(r.n_fallback == sum("<0x" in library.id_to_piece(i) for i in r.ids) for r in got if r.ids is not None)
