from collections import Counter
from zlib import crc32

import numpy as np

from astrolith.llm import sharding


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_against_one_key_at_a_time():
    keys = np.r_[np.arange(500), [2**63 - 1, -1, -(2**63)]].astype(np.int64)
    for n in (1, 2, 24, 1000):
        assert sharding.jump_hash(keys.view(np.uint64), n).tolist() == [jump(int(k) % 2**64, n) for k in keys]


def test_shards_slots_and_growth(spark):
    rows = [(k, "é" * (k % 7), "x") for k in range(3000)] + [(5, None, "x"), (5, None, "x"), (None, "", "x")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, shard string"), 24, rows_per_bucket=20).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
        if r.doc_id == 10:
            assert (r.size, r.text_crc32) == (14, crc32("ééé".encode()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 24 and max(sizes.values()) < 1.5 * min(sizes.values())
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_string_keys_repeated_keys_and_long_texts(spark):
    words = [(f"doc-{k}", "t" * k, 1) for k in range(800)] + [(None, None, 1)]
    docs = spark.createDataFrame(words, "doc_id string, text string, slot int")
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign_shards(docs, 24).collect()}
    again = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign_shards(docs.repartition(3), 24, rows_per_bucket=5).collect()}
    assert got == again and len(got) == 801 and all(b in (a, 24) for a, b in got.values())
    assert len({a for a, _ in got.values()}) == 24
    assert {r.doc_id: r.shard for r in sharding.assign_shards(docs, 25).collect()} == {k: b for k, (_, b) in got.items()}
    # One key holds most rows; one text is very long.
    hot = spark.createDataFrame([(7, f"x{k}") for k in range(500)] + [(k, "y") for k in range(100)] + [(3, "long " * 400_000)], "doc_id int, text string")
    rows = sharding.assign_shards(hot, 4, rows_per_bucket=10).collect()
    assert len(rows) == 601 and max(r.size for r in rows) == 2_000_008
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
