"""Sharding by jump consistent hashing.

``jump_hash`` maps a 64-bit key to one of ``n`` shards without a ring table: a linear congruential
sequence seeded by the key gives the shard counts at which the key would move, and the last one
below ``n`` is its shard. With one more shard a key either stays or moves into the new shard, so
only about ``1 / (n + 1)`` of the rows move.

Slots number a shard's rows from 0 without gaps, without one sort of a whole shard: rows are dealt to
buckets by a hash of their key, buckets of a shard are counted and their counts summed up (a table of
``shards * buckets`` rows), and rows are numbered inside their bucket only. The bucket count follows
the row count, so that a bucket's size doesn't grow with the input.

Keys: whole numbers are taken as they are; keys of other types (strings, say) by the XXH64 of their text, so they are as
stable. A repeated key's rows go to one shard, but their buckets depend on the text too, so that no task holds all of them.
Ties: rows equal in key, size and CRC-32 get slots in any order. Texts of any length count whole; only their sizes and
checksums move.

Nulls: a null key hashes as 0; a null text has no bytes. Repeated rows get slots of their own.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astrolith.session import cut

#: Multiplier of the jump hash's generator: a fixed value of the published algorithm.
JUMP = 2862933555777941757
ROWS_PER_BUCKET = 200_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of unsigned 64-bit ``keys``, all at once."""
    if shards < 1:
        raise ValueError("at least one shard")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        s = state[live] * np.uint64(JUMP) + np.uint64(1)
        state[live] = s
        nxt = ((shard[live] + 1) * (float(1 << 31) / ((s >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        stay = nxt < shards
        live = live[stay]
        shard[live] = nxt[stay]
    return shard


def _shards_of(shards: int, grown: int):
    @F.pandas_udf("struct<shard:int,grown:int>")
    def both(keys: pd.Series) -> pd.DataFrame:
        k = keys.to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump_hash(k, shards).astype(np.int32), "grown": jump_hash(k, grown).astype(np.int32)})

    return both


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for each row; the law is ``key``."""
    text = F.col(text_col)
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    key = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
    )
    # A null would turn its batch's keys into floating point, which rounds large ones.
    placed = rows.withColumn("to", _shards_of(shards, shards + 1)(F.coalesce(key, F.lit(0).cast("long"))))
    buckets = max(1, -(-docs.select(F.lit(1)).count() // (shards * rows_per_bucket)))
    # A bucket is a function of what rows are numbered by, so slots don't depend on how the table is dealt.
    bucket = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket")
    placed = placed.select("doc_id", "size", "text_crc32", F.col("to.shard").alias("shard"), F.col("to.grown").alias("grown_shard"), bucket)
    # Written once, in a few bytes a row: texts are read once, and counts and slots come from the same rows.
    placed = cut(placed)
    ids = placed.select("shard", "bucket")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ids.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("k", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("k") - 1).cast("long").alias("slot"), "grown_shard")


#: For tables of one bucket: the jump sequence by recursion, and CRC-32 by its table.
ORACLE = f"""
WITH RECURSIVE
steps(i, c, k) AS (SELECT range, range::BIGINT, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
body AS (SELECT doc_id, text, list_prepend(4294967295::BIGINT, [('0x' || x)::BIGINT for x in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]) AS l FROM documents),
facts AS (SELECT doc_id, CAST(8 + len(l) - 1 AS BIGINT) AS size, xor(list_reduce(l, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM body, crc),
jump(doc_id, n, key, b, j) AS (
  SELECT DISTINCT doc_id, n, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END, -1::BIGINT, 0::BIGINT FROM documents, (VALUES (24), (25)) AS v(n)
  UNION ALL
  SELECT doc_id, n, k, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT FROM (SELECT *, (key * {JUMP} + 1) % 18446744073709551616 AS k FROM jump WHERE j < n)),
shards AS (SELECT doc_id, max(b) FILTER (WHERE n = 24)::INT AS shard, max(b) FILTER (WHERE n = 25)::INT AS grown_shard FROM jump WHERE j >= n GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard FROM facts JOIN shards USING (doc_id)
"""
