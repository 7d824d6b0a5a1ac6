"""Benchmark decontamination: Wu-Manber search for the word windows of benchmark items.

**Words.** A-Z lower-cased; words are runs of 0-9, a-z and non-ASCII characters. A window is
13 consecutive words of an item (an item of fewer, but some, words is one window). A document
word inside any occurrence of a window is hit; ``contaminated`` means n_hit > 0 and
``20 * n_hit >= n_words``.

**Search.** A text is its words joined and framed by one space, so that a window is a byte
pattern. Patterns form classes by length. In each class a shift table over hashed blocks says how
far the search may jump, the last block's hash selects a bucket where the shift is zero, and a
direct comparison confirms. The search runs at many places of a batch of texts at once.

**Scale.** Documents are read once and never shuffled as long as all windows and their item ids fit in
``max_block_bytes``. A larger benchmark is dealt into blocks of windows (without ids), which reach the tasks one
after the other, each searched in all documents; hits, told apart by the text's MD5, are then joined with the
windows' items and united. A verdict belongs to the text, so it is the same whatever the number of blocks.

Nulls and empty texts have no words (n_words 0, not contaminated); null or wordless items have no
windows; a null item_id is ignored. Repeated rows give repeated rows, rows of one id but different texts are
judged by their own texts; windows that items share count for each of them. Very long texts are searched whole.
Empty tables give empty results or no hits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.llm.text import id_and_bytes, own_columns, text_hash
from astrolith.session import cut

WINDOW = 13
#: Byte table: word bytes to themselves (A-Z lower-cased), all others to a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text that are searched at once, and bytes between the places where searches start.
SEARCH_BYTES = 4 << 20
LANE = 512


def framed(body: bytes | None) -> tuple[bytes, int]:
    words = (body or b"").translate(WORDS).split()
    return b" " + b" ".join(words) + b" ", len(words)


def windows_of(item: bytes | None, size: int = WINDOW) -> list[bytes]:
    words = (item or b"").translate(WORDS).split()
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))] if words else []


class WuManber:
    """One length class: patterns of at least ``m`` bytes, of which the first ``m`` drive the shifts."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = b = min(self.m, 16 if self.m >= 32 else 8 if self.m >= 16 else 4)
        self.bits = max(12, min(22, int(np.ceil(np.log2(len(patterns) * (self.m - b + 1) * 8)))))
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        self.shift = np.full(1 << self.bits, self.m - b + 1, np.int32)
        for end in range(b, self.m + 1):
            np.minimum.at(self.shift, self._hash(np.ascontiguousarray(heads[:, end - b : end])), self.m - end)
        last = self._hash(np.ascontiguousarray(heads[:, self.m - b :]))
        self.buckets: dict[int, list[int]] = {}
        for i, h in enumerate(last.tolist()):
            self.buckets.setdefault(h, []).append(i)

    def _mix(self, parts) -> np.ndarray:
        h = np.uint64(0)
        for x in parts:
            h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
            h = h ^ (h >> np.uint64(29))
        return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)

    def _hash(self, rows: np.ndarray) -> np.ndarray:
        b = self.block
        kind = np.dtype("<u8") if b >= 8 else np.dtype(f"<u{1 << (b.bit_length() - 1)}")
        step = kind.itemsize
        at = [*range(0, b - step + 1, step)]
        if at[-1] != b - step:
            at.append(b - step)
        return self._mix([np.ascontiguousarray(rows[:, i : i + step]).view(kind)[:, 0].astype(np.uint64) for i in at])

    def search(self, data: bytes) -> list[tuple[int, int]]:
        """(start, pattern) of all occurrences in ``data``."""
        n, b, m = len(data), self.block, self.m
        if n < m:
            return []
        raw = np.frombuffer(data, np.uint8)
        kind = np.dtype("<u8") if b >= 8 else np.dtype(f"<u{1 << (b.bit_length() - 1)}")
        step = kind.itemsize
        view = np.ndarray((n - step + 1,), kind, raw, strides=(1,))
        offs = [*range(0, b - step + 1, step)]
        if offs[-1] != b - step:
            offs.append(b - step)
        pos = np.arange(0, n - m + 1, LANE)  # of the first byte that a pattern would have
        stop = np.minimum(pos + LANE, n - m + 1)
        found: list[tuple[int, int]] = []
        while len(pos):
            at = pos + (m - b)
            h = self._mix([view[at + o].astype(np.uint64) for o in offs])
            shift = self.shift[h]
            zero = np.flatnonzero(shift == 0)
            if len(zero):
                for p, key in zip(pos[zero].tolist(), h[zero].tolist()):
                    for k in self.buckets.get(key, ()):
                        if data.startswith(self.patterns[k], p):
                            found.append((p, k))
                shift = np.maximum(shift, 1)
            pos = pos + shift
            alive = pos < stop
            if not alive.all():
                pos, stop = pos[alive], stop[alive]
        return found


class Searcher:
    """All windows of a block, in length classes: a short window must not shorten the others' shifts."""

    def __init__(self, windows: list[bytes]):
        classes: dict[int, list[bytes]] = {}
        for w in windows:
            classes.setdefault(len(w).bit_length(), []).append(w)
        self.parts = [WuManber(x) for _, x in sorted(classes.items())]

    def search(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        for part in self.parts:
            for p, k in part.search(data):
                yield p, part.patterns[k]


def _hits(shared, kind: pa.DataType = pa.string()):
    def solve(find, items_of, ids, texts, counts):  # items_of: window -> item ids
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        per: dict[int, list[tuple[int, bytes]]] = {}
        spots = list(find.search(b"\0".join(texts)))
        if spots:
            rows = np.searchsorted(starts, [p for p, _ in spots], "right") - 1
            for row, (p, w) in zip(rows.tolist(), spots):
                per.setdefault(row, []).append((p - int(starts[row]), w))
        spans: list[list[dict]] = [[] for _ in texts]
        items: list[list] = [[] for _ in texts]
        for row, got in per.items():
            got.sort(key=lambda x: x[0])
            spaces = np.flatnonzero(np.frombuffer(texts[row], np.uint8) == 32)
            merged: list[list[int]] = []
            for p, w in got:
                a = int(np.searchsorted(spaces, p))
                z = a + w.count(b" ") - 1
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            spans[row] = [{"a": a, "z": z} for a, z in merged]
            items[row] = sorted({i for _, w in got for i in items_of[w]})
        return pa.record_batch(
            [pa.concat_arrays(ids), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))), pa.array(items, pa.list_(kind))],
            names=["doc_id", "n_words", "spans", "items"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_of = shared.value
        find = Searcher(sorted(items_of))
        ids, texts, counts, held = [], [], [], 0
        for b in batches:
            at = 0
            for i, x in enumerate(b.column(1)):
                t, n = framed(x.as_py())
                texts.append(t)
                counts.append(n)
                held += len(t)
                if held >= SEARCH_BYTES:
                    ids.append(b.column(0).slice(at, i + 1 - at))
                    yield solve(find, items_of, ids, texts, counts)
                    at, ids, texts, counts, held = i + 1, [], [], [], 0
            if at < b.num_rows:
                ids.append(b.column(0).slice(at))
        if texts:
            yield solve(find, items_of, ids, texts, counts)

    return run


def _windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(window, id)`` rows of all items."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("body")).where("id is not null and body is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(w, i) for i, x in zip(b.column(0).to_pylist(), b.column(1)) for w in windows_of(x.as_py(), size)]
            yield pa.record_batch([pa.array([w for w, _ in found], pa.binary()), pa.array([i for _, i in found], pa.string())], names=["window", "id"])

    return rows.mapInArrow(run, "window binary, id string").distinct()


def _small(windows: DataFrame, max_block_bytes: int) -> dict[bytes, list[str]] | None:
    """Window -> item ids, if all of them together stay within the bound."""
    if (windows.agg(F.sum(F.octet_length("window") + F.octet_length("id") + 100)).first()[0] or 0) > max_block_bytes:
        return None
    rows = windows.toArrow()
    found: dict[bytes, list[str]] = {}
    for w, i in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        found.setdefault(w, []).append(i)
    return found


def _block_hits(docs: DataFrame, windows: DataFrame, text_col: str, max_block_bytes: int) -> DataFrame:
    """``(h, spans, items)`` of each different text with hits, for windows of any number: a block of them at a time."""
    spark = docs.sparkSession
    windows = cut(windows)
    single = cut(windows.select("window").distinct())
    used = single.agg(F.sum(F.octet_length("window") + 100)).first()[0] or 0
    n = -(-used // max_block_bytes)
    bodies = docs.select(F.col(text_col).cast("binary").alias("body")).select(text_hash("body").alias("h"), "body")
    found = None
    for k in range(n):
        rows = single.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k).toArrow()
        shared = spark.sparkContext.broadcast({w: [w] for w in rows.column(0).to_pylist()})
        got = bodies.mapInArrow(_hits(shared, pa.binary()), "h binary, n_words long, spans array<struct<a:long,z:long>>, items array<binary>")
        got = cut(got.where(F.size("spans") > 0).dropDuplicates(["h"]).select("h", "spans", "items"))
        found = got if found is None else found.unionByName(got)
        shared.unpersist()
    spans = found.groupBy("h").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    ids = found.select("h", F.explode("items").alias("window")).join(windows, "window").groupBy("h").agg(F.array_sort(F.collect_set("id")).alias("items"))
    return spans.join(ids, "h")


def _n_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.size(F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))).cast("long")


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_block_bytes: int = 64 << 20) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans (hit word ranges ``[a, z)``), items (sorted as strings), n_hit, contaminated."""
    windows = _windows(items, item_col, item_text_col, WINDOW)
    small = _small(windows, max_block_bytes)
    if small is not None:
        rows = id_and_bytes(docs, id_col, text_col)
        kind = rows.schema["doc_id"].dataType.simpleString()
        found = rows.mapInArrow(_hits(docs.sparkSession.sparkContext.broadcast(small)), f"doc_id {kind}, n_words long, spans array<struct<a:long,z:long>>, items array<string>")
    else:
        hits = _block_hits(docs, windows, text_col, max_block_bytes)
        base = docs.select(F.col(id_col).alias("doc_id"), _n_words(F.col(text_col)).alias("n_words"), text_hash(F.col(text_col).cast("binary")).alias("h"))
        none = lambda kind: F.array().cast(kind)
        found = base.join(hits, "h", "left").select("doc_id", "n_words", F.coalesce("spans", none("array<struct<a:bigint,z:bigint>>")).alias("spans"), F.coalesce("items", none("array<string>")).alias("items"))
    # Spans may overlap across blocks only; walk them in order and count each word once.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["z"]).alias("end"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["z"] - F.greatest(s["end"], x["a"]))).alias("n")),
        lambda s: s["n"],
    )
    out = found.withColumn("n_hit", covered)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = """
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lowered, sizes WHERE len(w) >= k)),
hits AS (SELECT g.doc_id, g.i, g.k, x.item_id FROM grams g JOIN windows x ON g.win = x.win AND g.k = x.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l.w) AS contaminated
FROM lowered l LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def drop_contaminated(docs: DataFrame, items: DataFrame, max_block_bytes: int = 64 << 20, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns; each row is judged by its own text.

    The decision is made beside the text, without a join. With a benchmark of several blocks it needs all of
    them, so that verdicts are joined by the text's MD5.
    """
    windows = _windows(items, "item_id", "text", WINDOW)
    small = _small(windows, max_block_bytes)
    if small is None:
        bad = find_contamination(docs.select(text_hash(F.col(text_col).cast("binary")).alias("bad_h"), F.col(text_col).alias("text")), items, id_col="bad_h", max_block_bytes=max_block_bytes)
        rows = docs.select(F.struct(*own_columns(docs.columns)).alias("row"), text_hash(F.col(text_col).cast("binary")).alias("h"))
        return rows.join(bad.where("contaminated").select(F.col("doc_id").alias("h")).distinct(), "h", "left_anti").select("row.*")
    shared = docs.sparkSession.sparkContext.broadcast(small)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Searcher(sorted(shared.value))
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts, counts = zip(*(framed(None if (t := x.as_py()) is None else t.encode()) for x in part.column(at)))
                spots: dict[int, list[tuple[int, int]]] = {}
                starts = np.cumsum([0] + [len(t) + 1 for t in texts])
                for p, w in find.search(b"\0".join(texts)):
                    row = int(np.searchsorted(starts, p, "right")) - 1
                    spots.setdefault(row, []).append((p - int(starts[row]), len(w)))
                good = np.ones(part.num_rows, bool)
                for row, got in spots.items():
                    n_hit, end = 0, 0
                    for p, n in sorted(got):
                        a = max(end, p + 1)
                        if p + n - 1 > a:
                            n_hit += texts[row].count(b" ", a, p + n)
                            end = p + n
                    good[row] = not (n_hit and 20 * n_hit >= counts[row])
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
