"""The five stages against plain versions, over rows that are null, empty, long, repeated, and with clashing columns."""

import sentencepiece
from test_decontaminate import words
from test_models import plain_scan
from test_simhash import brute

import corpus_pipeline
from astrolith.llm import pieces, quality, secrets

SF = "/root/testdata/sf0.001"
CLASHING = ("redacted", "row", "secrets", "n_candidates", "h", "own_id", "copies", "parts", "words", "found", "judged", "fp", "keep", "body", "doc_id2")


def plain_kept(rows, scorer, items, trees):
    reader = quality.Reader(scorer.bits)

    def good(text):
        buckets, n, _ = reader.read(None if text is None else text.encode())
        return scorer.score(buckets, n) >= quality.Settings().threshold

    rows = [r for r in rows if good(r["text"])]
    _, group = brute({k: r["text"] for k, r in enumerate(rows)})
    best = {}
    for k, r in enumerate(rows):
        at = (r["doc_id"] is None, r["doc_id"] or 0)
        if group[k] not in best or at < best[group[k]][0]:
            best[group[k]] = (at, r)
    rows = [r for _, r in best.values()]
    windows = {tuple(w[i : i + 13]) for x in items if (w := words(x)) for i in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}

    def contaminated(text):
        w, hit = words(text), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        return bool(hit) and 20 * len(hit) >= len(w)

    rows = [r for r in rows if not contaminated(r["text"])]
    out = []
    for r in rows:
        spans, text = [(s, s + n) for s, n, p in plain_scan(r["text"], trees) if p >= 0.5 - 1e-12], r["text"]
        for s, e in reversed(spans):
            text = text[:s] + secrets.MARK + text[e:]
        out.append((r["doc_id"], text))
    return out


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 110")
    base = docs.collect()
    long = " ".join(r.text for r in base if r.lang == "en" and len(r.text) > 300) * 8
    key = 'The usual note says that token = "0123deadbeef4567feedface89abc0ffee012345" was used by the team of that day, and then it was removed again.'
    odd = [(None, None), (1_000, None), (1_001, ""), (1_002, long), (None, long), (1_003, key), (1_003, key), (1_004, base[3].text), (1_004, base[4].text)]
    like = base[0].asDict()
    frame = spark.createDataFrame([tuple(({**like, "doc_id": i, "text": t, "n_chars": 0})[c] for c in docs.columns) for i, t in odd], docs.schema)
    from pyspark.sql import functions as F

    rows = docs.unionByName(frame).select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
    stage, columns = rows, rows.columns
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, stage, SF).write.parquet(str(tmp_path / name))
        stage = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert stage.columns == columns
            assert all(r[c] == f"own {c}" for r in stage.select(*(f"`{c}`" for c in CLASHING)).collect() for c in CLASHING)
    got = sorted((str(r.doc_id), list(r.ids)) for r in stage.collect())
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = plain_kept([r.asDict() for r in rows.collect()], quality.fit(rows), items, secrets.default_trees(spark))
    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.default_model())
    assert 40 < len(kept) < len(base)
    assert got == sorted((str(i), library.encode(t)) for i, t in kept)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0
