import random
import re
from collections import Counter
from zlib import crc32

from astrolith.llm import spelling


def words_by_hand(rows, least, count, every):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(words, ratio):
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (n, len(near), best if best and words[best] >= ratio * n else None)
    rows = set()
    for w, (n, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.add((w, n, k, form, words[form] if form else None, root))
    return rows


COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def rows_of(df):
    return {tuple(r[c] for c in COLUMNS) for r in df.collect()}


def corpus(seed, size):
    """Words of few letters with slips, so that many have the same letters."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    rows = []
    for doc in range(size):
        text = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base[: rng.choice((2, 8, 25))])
            if rng.random() < 0.1:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(("", "a", "b", w[i] * 2, "É", "÷")) + w[i + 1 :]
            text.append(rng.choice((w, w.capitalize())))
        rows.append((doc, rng.choice((" ", "-", "1", "Ā")).join(text)))
    return rows


def test_against_all_pairs(spark):
    rows = [*corpus(1, 900), (None, "Abbéab " * 9), (5, None), (6, ""), (7, "ab " * 300_000 + "abbéab" * 1), (7, "abbéab"), (7, "abbéab")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string").repartition(5)
    for every, split in ((None, 2_000), (3, 3)):
        words = words_by_hand(rows, 6, 5, every)
        assert len(words) > 90
        counted = spelling.count_words(docs, drop_every=every)
        assert {(r.word, r.n) for r in counted.collect()} == set(words.items())
        assert rows_of(spelling.group_variants(counted, split_above=split)) == variants_by_hand(words, 5)


def test_chains_of_forms_and_ties(spark):
    words = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 700, "abbbbb": 4000, "cccccc": 2, "ccccca": 50, "cccccb": 50, "dddddd": 7, "x": 9, "xy": 50, "": 3}
    df = spark.createDataFrame([*words.items()], "word string, n long")
    got = rows_of(spelling.group_variants(df, split_above=1))
    assert got == variants_by_hand(words, 5)
    assert {(w, root) for w, *_, root in got} >= {("aaaaaa", "abbbbb"), ("cccccc", "ccccca"), ("dddddd", "dddddd")}
    assert spelling.group_variants(df.limit(0)).count() == 0


def test_batches_are_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    rows = corpus(2, 40)
    got = spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string"), min_count=1)
    assert {(r.word, r.n) for r in got.collect()} == set(words_by_hand(rows, 6, 1, None).items())


def test_signatures_meet_at_any_edit():
    rng = random.Random(3)
    for _ in range(3000):
        w = "".join(rng.choice("etaoinqzé") for _ in range(rng.randint(2, 12)))
        i = rng.randrange(len(w))
        for v, (parts, covered) in ((w[:i] + rng.choice("etzéü") + w[i + 1 :], spelling.SAME_SIZE), (w[:i] + w[i + 1 :], spelling.NEXT_SIZE)):
            sigs = lambda x: {(c, "".join(sorted(set_ for set_ in x if set_ not in spelling._letters_of(parts, c)))) for c in spelling.combinations(range(parts), covered)}  # noqa: E731, B023
            assert sigs(w) & sigs(v)
