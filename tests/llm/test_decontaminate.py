import random
import re
from hashlib import sha256

from astrolith.llm import decontaminate as d


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, x in items:
            iw = words(x)
            n = min(13, len(iw))
            for s in range(len(iw) - n + 1) if iw else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(k))
        ids = ",".join(sorted(found))
        out[i] = (len(w), len(hit), len(found), sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["the", "Of", "élan", "x9", "to", "a", "ñandú", "word"]
    text = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", ",", ".", "\n"]) for _ in range(n))
    items = [(k, text(rnd.choice([20, 45]))) for k in range(10)] + [(10, "Short item"), (11, ""), (12, None), (100, "one"), (13, items0 := text(30)), (14, items0)]
    docs = []
    for k in range(80):
        parts = [text(rnd.choice([0, 5, 60]))]
        for _ in range(rnd.choice([0, 1, 2])):
            w = (rnd.choice(items)[1] or "").split()
            a = rnd.randrange(max(1, len(w) - 14))
            parts += [" ".join(w[a : a + rnd.choice([12, 13, 14, 30])]).upper().replace("É", "é").replace("Ñ", "ñ").replace("Ú", "ú"), text(rnd.choice([0, 30, 400]))]
        docs.append((k, " - ".join(parts)))
    docs += [(80, None), (81, ""), (82, "short ITEM one"), (83, "...")]
    want = brute(docs, items)
    frame = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (64 << 20, 2500):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.digest(d.find_contamination(frame, bench, max_block_bytes=block)).collect()}
        assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    r = d.digest(d.find_contamination(docs, none)).collect()
    assert [(x.n_words, x.n_hit, x.n_items, x.contaminated) for x in r] == [(2, 0, 0, False)]
    assert d.find_contamination(docs.limit(0), none).count() == 0


def test_search_finds_all_at_lane_borders():
    pats = [b" ab cd ef gh ", b" cd ef gh ij ", b" a ", b"x" * 70]
    data = (b"q" * 505 + b" ab cd ef gh ij a a " + b"x" * 75) * 7
    want = sorted((i, p) for p in pats for i in range(len(data)) if data.startswith(p, i))
    assert sorted(d.Searcher(pats).search(data)) == want


def test_rows_are_judged_by_their_own_text_whatever_the_blocks(spark):
    passage = " ".join(f"word{k}" for k in range(30))
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(30)] + [(99, passage)], "item_id long, text string")
    clean = "a text of its own that no benchmark holds"
    rows = [(None, passage, "a"), (None, clean, "b"), (1, passage, "c"), (1, clean, "d"), (2, None, "e"), (2, clean, "f"), (3, "x " * 5000 + passage, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    want = sorted(((None, clean, "b"), (1, clean, "d"), (2, None, "e"), (2, clean, "f"), (3, "x " * 5000 + passage, "g")), key=str)
    for block in (64 << 20, 20_000, 5_000):
        got = d.drop_contaminated(docs, items, max_block_bytes=block)
        assert got.columns == docs.columns and sorted((tuple(r) for r in got.collect()), key=str) == want
        found = d.find_contamination(docs, items, max_block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.contaminated) for r in found) == sorted(
            (str(i), len((t or "").split()), 30 if t and passage in t else 0, t == passage) for i, t, _ in rows
        )
