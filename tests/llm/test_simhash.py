import hashlib
import random

import numpy as np
import xxhash

from astrolith.llm import simhash


def brute(texts: dict):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return low.encode().split()

    def fp(t):
        w = words(t)
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: fp(t) for i, t in texts.items()}
    comp = {i: i for i in fps}
    while True:
        new = {i: min(comp[j] for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 3) for i in fps}
        if new == comp:
            return fps, comp
        comp = new


def test_against_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("alpha beta gamma delta Eps zeta".split()) for _ in range(rnd.choice([40, 300]))) for _ in range(25)]
    texts = {0: None, 1: "", 2: " \t\n", 3: "One", 4: "one two", 5: "ONE"}
    for k in range(120):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = rnd.choice(["x", "beta"])
        texts[6 + k] = " ".join(w)
    fps, comp = brute(texts)
    docs = spark.createDataFrame([(k, v, "a") for k, v in texts.items()], "doc_id long, text string, fp string")
    for split in (20_000, 1):
        got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs, split_above=split).collect()}
        assert got == {i: (fps[i], comp[i]) for i in texts}


def test_trie_join_against_brute_force():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    v = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 48, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 48, 400).astype(np.uint64)) for c in centres]))
    root = simhash.trie_forest(np.zeros(len(v), np.int64), v)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    lab = np.arange(len(v))
    while True:
        new = np.where(near, lab[None, :], len(v)).min(axis=1)
        if (new == lab).all():
            break
        lab = new
    assert (root == lab).all()


def test_long_texts_are_read_in_blocks():
    body = b"Some words of a text  \n" * 3000
    whole, was = simhash.fingerprint(body), simhash.word_blocks
    try:
        simhash.word_blocks = lambda b: was(b, 100)
        assert simhash.fingerprint(body) == whole
    finally:
        simhash.word_blocks = was


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "a b c")], "doc_id long, text string")).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {2}


def test_one_row_of_each_group_stays_by_row_not_by_id(spark):
    a, b, c = "alpha beta gamma delta " * 20, "one two three four five " * 20, "lorem ipsum dolor sit " * 20
    rows = [(1, a, "s"), (1, b, "t"), (2, a, "u"), (3, c, "v"), (3, c, "v"), (None, b, "w"), (None, "quite another text here", "x"), (4, None, "y"), (5, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    for split in (20_000, 1):
        got = sorted((tuple(r) for r in simhash.drop_near_duplicates(docs, split_above=split).collect()), key=str)
        assert got == sorted([(1, a, "s"), (1, b, "t"), (3, c, "v"), (None, "quite another text here", "x"), (4, None, "y")], key=str)
    assert simhash.drop_near_duplicates(docs).columns == docs.columns
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_stay_against_brute_force(spark):
    rnd = random.Random(9)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    base = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(12)]
    rows = []
    for k in range(150):
        w = rnd.choice(base).split()
        if rnd.random() < 0.3:
            w[rnd.randrange(60)] = "x"
        rows.append((rnd.choice([None, k // 2, k // 3]), " ".join(w)))
    fps, comp = brute({k: t for k, (_, t) in enumerate(rows)})
    want = {}
    for k, (i, t) in enumerate(rows):
        key = (i is None, i or 0, hashlib.md5(t.encode()).digest())
        want[comp[k]] = min(want.get(comp[k], (key, rows[k])), (key, rows[k]), key=lambda x: x[0])
    got = [tuple(r) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted((r for _, r in want.values()), key=str)
