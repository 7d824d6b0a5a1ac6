import hashlib
import random
import re

from astrolith.llm import pii


def base_by_hand(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def discovered_by_hand(texts, rounds, accept, least, weight):
    """The rounds of patterns and instances over plain dictionaries."""
    seeds, forms, edges = {}, {}, set()
    for text in texts:
        base = pii.base_spans(text)
        for k, s, e in base + [(None, s, e) for s, e in pii.candidate_spans(text, [b[1:] for b in base])]:
            i = pii.instance_of(text[s:e])
            seeds.setdefault(i, set()).update([] if k is None else [k])
            forms.setdefault(i, set()).update(pii.fits(text[s:e]) if k is None else [k])
            edges |= {(i, p) for p in pii.patterns_of(text, s, e)}
    belief = {i: [float(k in seeds[i]) for k in range(4)] for i in seeds}
    for _ in range(rounds):
        score = {}
        for p in {p for _, p in edges}:
            own = [i for i, q in edges if q == p]
            known = [i for i in own if max(belief[i]) > 0]
            if len(known) >= least:
                below = sum(max(belief[i]) for i in own) + sum(not forms[i] for i in own) + weight * sum(not seeds[i] and bool(forms[i]) and max(belief[i]) == 0 for i in own) + 1
                score[p] = [sum(belief[i][k] for i in own) / below for k in range(4)]
        fresh = {}
        for i in belief:
            best = [max([score[p][k] for j, p in edges if j == i and p in score], default=0) for k in range(4)]
            fresh[i] = [float(k in seeds[i]) if seeds[i] else best[k] if k in forms[i] and best[k] >= accept else 0.0 for k in range(4)]
        belief = fresh
    return {i: b.index(max(b)) for i, b in belief.items() if not seeds[i] and max(b) > 0}


def corpus(seed):
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for k in range(60):
        texts += [
            f"Please call me at +1 ({number(3)}) {number(3)}-{number(4)} today",
            f"write to mail: joe{k}@mail{k % 3}.example.org now",
            f"host {rng.randrange(200)}.{rng.randrange(200)}.0.{rng.randrange(200)} is up",
            f"commit {number(3)}abc{number(4)}def{number(3)} was built in run {number(9)} again",
            "nothing here but words and 12 numbers in 2024",
        ]
    unseen = [f"Please call me at 0171 {number(3)}-{number(4)} today", "write to mail: ann (at) host (dot) org now", "Please call me at 030 5551234"]
    return texts, unseen


def test_base_forms_and_candidates_against_plain_patterns():
    rng = random.Random(1)
    for _ in range(8_000):
        text = "".join(rng.choice("ab@.@-+ 0123456789().é\n") for _ in range(rng.randint(0, 40)))
        base = pii.base_spans(text)
        assert base == base_by_hand(text)
        spans = sorted(pii.candidate_spans(text, [b[1:] for b in base]))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert all(e <= b[1] or s >= b[2] for s, e in spans for b in base)
    make = lambda n: "x@" + "a." * n + "1" * n + " +1 (017) 555-7713 " + "9" * n + "@"
    assert pii.base_spans(make(500)) == base_by_hand(make(500))
    assert [k for k, *_ in pii.base_spans(make(200_000))] == [0]
    assert [make(200_000)[s:e] for s, e in pii.candidate_spans(make(200_000), [b[1:] for b in pii.base_spans(make(200_000))])] == ["555-7713"]


def test_discovers_what_the_forms_miss(spark):
    texts, unseen = corpus(2)
    rows = [(k % 50, t, "x", 1) for k, t in enumerate([*texts, *unseen])] + [(None, unseen[0], "x", 1), (None, unseen[0], "x", 1), (7, None, "x", 1), (8, "", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, kind int").repartition(5)
    got = pii.digest(pii.find_pii(docs)).collect()
    assert len(got) == len(rows)
    want = discovered_by_hand([r[1] or "" for r in rows], pii.ROUNDS, pii.ACCEPT, pii.LEAST_KNOWN, pii.UNKNOWN_WEIGHT)
    assert sorted(want.values()) == [0, 3, 3]
    said = []
    for doc, text, *_ in rows:
        text = text or ""
        base = base_by_hand(text)
        added = [(want[i], s, e) for s, e in pii.candidate_spans(text, [b[1:] for b in base]) if (i := pii.instance_of(text[s:e])) in want]
        name = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        said.append((doc, *(sum(k == b[0] for b in base) for k in range(4)), hashlib.sha256(name(base).encode()).hexdigest(), name(sorted(base + added)), len(added)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, said)) == sorted(key((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans, r.n_added)) for r in got)
    clean = [r for r in got if r.spans == ""]
    assert len(clean) == 60 + 60 + 2  # builds, plain words, null and empty texts
    assert pii.digest(pii.find_pii(docs.limit(0))).count() == 0


def test_patterns_can_be_read(spark):
    texts, unseen = corpus(3)
    found, patterns = pii.bootstrap(pii.marks(spark.createDataFrame([(t,) for t in [*texts, *unseen]], "text string").selectExpr("1 AS doc_id", "text")))
    best = {r.pattern for r in patterns.where("b3 > 0.75").collect()}
    assert "me at {}" in best
    assert {r.instance for r in found.collect()} >= {"ann@host.org", "0305551234"}


def test_held_out_seeds_come_back(spark, monkeypatch):
    """Hide the phone form from every fifth text: contexts alone bring most of them back, and no commit."""
    texts, _ = corpus(4)
    texts = [t.replace("+1 (", "001 (") if "call" in t and k % 25 == 0 else t for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(docs)).collect()}
    hidden = [k for k, t in enumerate(texts) if "001 (" in t]
    assert len(hidden) >= 10 and all("phone" in got[k] for k in hidden)
    assert not any(got[k] for k, t in enumerate(texts) if "commit" in t)
