import random
from collections import Counter
from dataclasses import replace
from hashlib import sha256

import numpy as np

from astrolith.llm import repeats as r


def brute(texts, n=400):
    count = Counter(t[p : p + n] for _, t in texts for p in range(len(t) - n + 1))
    out = {}
    for i, t in texts:
        spans = []
        for p in range(len(t) - n + 1):
            if count[t[p : p + n]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + n
                else:
                    spans.append([p, p + n])
        kept = b"".join(t[a:z] for a, z in zip([0] + [z for _, z in spans], [a for a, _ in spans] + [len(t)]))
        out[i] = (len(t), len(t) - len(kept), len(spans), sha256(kept).hexdigest())
    return out


def texts():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(n) for n in (60, 90, 100, 150, 300)]
    out = ["", "short", "a" * 399, "a" * 400, "a" * 900, "a" * 1200, "ab" * 500, "The " * 300, "x" + "The " * 150 + "y", passages[3], passages[3], passages[3] + passages[3], prose(400), None]
    line = prose(14)
    out += [(line + "\n") * 12, prose(30) + (line + "\n") * 9 + prose(30)]
    for _ in range(40):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            parts += [prose(rnd.choice([0, 20, 80])), rnd.choice(passages)[rnd.randrange(60) :]]
        out.append("".join(parts))
    return list(enumerate(out))


def test_against_brute_force(spark):
    rows = texts()
    want = brute([(i, (t or "").encode()) for i, t in rows])
    docs = spark.createDataFrame([(i, t, b"k") for i, t in rows], "doc_id long, text string, key binary")
    for s in (r.Settings(), replace(r.Settings(), split_above=1, flush_rows=50), replace(r.Settings(), split_above=5)):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.digest(r.remove_repeats(docs, s)).collect()}
        assert got == want


def test_hot_copies_repeated_rows_and_null_ids(spark):
    body = "".join(random.Random(1).choice("abcdef ") for _ in range(700))
    rows = [(k, body) for k in range(1500)] + [(5, body), (None, body), (None, "z" * 10), (9_999, "q" + body[:450])]
    got = r.digest(r.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    assert sum(x.n_removed == 700 for x in got) == 1502
    assert [x.n_removed for x in got if x.doc_id == 9_999] == [450]
    assert r.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_sort_against_sorted_bytes():
    rng = np.random.default_rng(0)
    lens = rng.integers(0, 30, 200)
    rows = np.where(np.arange(30) < lens[:, None], rng.integers(0, 2, (200, 30)), 0).astype(np.uint8)
    group = np.sort(rng.integers(0, 5, 200))
    s = r.Suffixes(rows, lens)
    order = s.sort(group)
    key = lambda k: rows[k, : lens[k]].tobytes()
    assert [(group[k], key(k)) for k in order] == sorted((group[k], key(k)) for k in range(200))
    near = s.neighbours(order, group)
    for p in range(1, 200):
        if group[order[p]] == group[order[p - 1]]:
            a, b = key(order[p - 1]), key(order[p])
            assert near[p] == next((d for d in range(min(len(a), len(b))) if a[d] != b[d]), min(len(a), len(b)))


def test_a_collision_is_found_and_sorted_by_bytes(monkeypatch):
    rows, lens = np.array([[1, 2], [3, 4], [1, 2]], np.uint8), np.array([2, 2, 2])
    monkeypatch.setattr(r, "_powers", lambda n: np.zeros(n + 1, np.uint64))
    order, near = r._sorted_with_extensions(rows, lens, np.zeros(3, np.int64))
    assert [rows[k].tolist() for k in order] == [[1, 2], [1, 2], [3, 4]] and near.tolist() == [-1, 2, 0]


def test_blocks_of_a_long_text(monkeypatch):
    body = bytes(random.Random(2).choice(b"abcd ") for _ in range(5000)) + b"The " * 400
    whole = r.anchors(body, r.Settings())
    monkeypatch.setattr(r, "BLOCK", 700)
    part = r.anchors(body, r.Settings())
    strings = lambda a: sorted((p - o, p) for p, f, z in zip(a.pos, a.first, a.last) for o in range(f, z + 1))
    assert strings(whole) == strings(part) and [s for s, _ in strings(whole)] == list(range(len(body) - 399))


def common_passage(spans=(330, 380, 430)):
    rnd = random.Random(8)
    noise = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    shared = [noise(n) for n in spans]
    out = [noise(rnd.randrange(350, 500)) + p + noise(rnd.randrange(350, 500)) for p in shared for _ in range(60)]
    page = noise(1200)
    return list(enumerate(out + [noise(500) + page + str(k) for k in range(60)]))


def test_no_group_that_one_task_sorts_grows_with_a_common_passage(spark, tmp_path, monkeypatch):
    real = r._solve

    def told(s):
        run = real(s)

        def solve(batches):
            from uuid import uuid4

            seen = Counter()

            def counted():
                for b in batches:
                    seen.update(b.column(1).to_pylist())
                    yield b

            yield from run(counted())
            (tmp_path / uuid4().hex).write_text(str(max(seen.values(), default=0)))

        return solve

    monkeypatch.setattr(r, "_solve", told)
    rnd = random.Random(9)
    noise = lambda a, z: "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(a, z)))
    passage, page = noise(130, 131), noise(450, 451)
    rows = list(enumerate([noise(150, 190) + passage + noise(150, 190) for _ in range(650)] + [noise(20, 30) + page for _ in range(650)]))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.digest(r.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == brute([(i, t.encode()) for i, t in rows]) and sum(x[1] > 0 for x in got.values()) == 650
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    # Hundreds share a passage shorter than a string, and hundreds a page: neither meets in one task.
    assert sizes and max(sizes) <= 500


def test_large_groups_in_bands(spark):
    rows = common_passage()
    rows += [(500 + k, t) for k, (_, t) in enumerate(rows[100:130] * 2)] + [(1000 + k, None) for k in range(2)]
    want = brute([(i, (t or "").encode()) for i, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for s in (replace(r.Settings(), split_above=25), replace(r.Settings(), split_above=2)):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.digest(r.remove_repeats(docs, s)).collect()}
        assert got == want
