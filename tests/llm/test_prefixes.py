import hashlib
import random
from zlib import crc32

import pytest

from astrolith.llm import contraction, prefixes


def rebuilt_by_hand(rows, shared):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, mark, (role, text)))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in convs.items()}
    if not shared:
        return turns
    h = lambda c: crc32(str(c).encode()) % 6
    return {c: turns.get(c - c % 100, [])[: h(c)] + t[h(c) :] for c, t in turns.items()}


def trie_by_hand(convs):
    nodes, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, sha))
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 9), *range(100, 130), 205, 399, *range(1000, 1012)]:
        for t in range(rng.choice((1, 2, 3, 8))):
            rows.append((c, t, rng.choice(("user", "assistant")), rng.choice(("a", "bb", "é😀", "", None))))
    return rows


@pytest.mark.parametrize("shared", [False, True])
def test_against_all_prefixes(spark, shared, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 2)
    # Null turns, roles, texts and ids; equal turns; repeated rows; copies of one conversation; one long conversation and a long text.
    rows = [*conversations(4), (3, None, None, None), (3, 0, "user", "z"), (3, 0, "user", "z"), (None, 0, "user", "lost"), (0, 5, "user", "t" * 400_000)]
    rows += [(c, t, "user", "same") for c in range(2000, 2030) for t in range(4)] + [(3000, t, "tool", "long") for t in range(90)]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], SCHEMA).repartition(6)
    make = prefixes.with_shared_heads if shared else prefixes.as_they_are
    got = prefixes.trie(*make(df)).collect()
    want = trie_by_hand(rebuilt_by_hand(rows, shared))
    assert len(got) == len(want) and {tuple(r[c] for c in COLUMNS) for r in got} == want


def test_empty_and_turnless(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefixes.trie(*prefixes.with_shared_heads(df)).count() == 0
    lone = next(c for c in range(101, 200) if crc32(str(c).encode()) % 6 > 0)
    df = spark.createDataFrame([(lone, 0, "user", "gone", 0, "")], SCHEMA)
    assert [tuple(r[c] for c in COLUMNS) for r in prefixes.trie(*prefixes.with_shared_heads(df)).collect()] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar", "forest"])
def test_contraction_of_any_shape(spark, shape):
    rng = random.Random(5)
    n = 150
    parent = {0: None}
    for i in range(1, n):
        parent[i] = {"chain": i - 1, "star": 0, "random": rng.randrange(i), "caterpillar": i - 1 if i % 2 else max(0, i - 2), "forest": None if i % 50 == 0 else i - 1 - (i % 50 > 1 and rng.randrange(2))}[shape]
    value = {i: rng.randrange(10) for i in parent}
    want = dict(value)
    for i in range(n - 1, 0, -1):
        if parent[i] is not None:
            want[parent[i]] += want[i]
    df = spark.createDataFrame([(i, p, value[i], 1) for i, p in parent.items()], "id long, parent long, v long, w long")
    got = contraction.subtree_totals(df, ["v", "w"]).collect()
    assert len(got) == n and {r.id: r.v for r in got} == want
    assert contraction.subtree_totals(df.limit(0), ["v"]).count() == 0


def test_circles_are_an_error(spark):
    with pytest.raises(RuntimeError):
        contraction.subtree_totals(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "id long, parent long, v long"), ["v"], max_rounds=3)
