"""SimHash near-duplicates: fingerprints linked at a Hamming distance, by a binary trie self-join.

**Fingerprint.** Lower-case A-Z, words are runs without ASCII white space, shingles are
three words joined by a space (repeats count; a text of fewer words is one shingle). A bit
is 1 if it is set in over half of the shingles' XXH64 values (seed 42). No words: zero.

**Join.** Distinct fingerprints only, so a group of copies is one row. Two fingerprints
that differ in at most three bits agree on one of four 16-bit blocks; so each fingerprint
goes, rotated, to four groups, one for each block, and each group's members form a
binary trie below that block. Tasks walk node pairs of the tries together, level by level,
adding up differing bits, and drop a pair once it exceeds the budget; small node pairs
are compared directly. A task emits a spanning forest of its links, never all pairs.

**Skew.** A group of over ``split_above`` distinct fingerprints is dealt anew on a second
block: with one block equal, one of the other three differs in at most one bit, so each
member goes to its own second block and to those with one set bit cleared. No link is lost.

Nulls: a null text has no words; a null id keeps its row. Repeated rows stay repeated.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.llm.text import LOWER, id_and_bytes, own_columns, text_hash, word_blocks
from astrolith.operators.components import roots
from astrolith.session import cut

BITS, BLOCKS, WIDTH = 64, 4, 16
BUDGET = 3
#: Node pairs of at most this many comparisons are compared directly.
DIRECT = 512
#: Comparisons made at once.
CHUNK = 1 << 20


def fingerprint(body: bytes | None, words_per_shingle: int = 3) -> int:
    if not body:
        return 0
    k, digest = words_per_shingle, xxhash.xxh64_intdigest
    ones, n, tail = np.zeros(BITS, np.int64), 0, []
    for words in word_blocks(body.translate(LOWER)):
        words = tail + words
        if len(words) >= k:
            join = b" ".join
            h = np.fromiter((digest(join(s), 42) for s in zip(*(words[i:] for i in range(k)))), np.uint64, len(words) - k + 1)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            n += len(h)
        tail = words[-(k - 1) :] if k > 1 else []
    if not n:
        if not tail:
            return 0
        return digest(b" ".join(tail), 42)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, fp)`` per row: the text's MD5 (that of no bytes for a null text) and the fingerprint as a signed 64-bit number."""
    rows = id_and_bytes(docs, id_col, text_col).select("doc_id", text_hash("body").alias("h"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "h", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, h binary, fp long")


def _compress(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while True:
        a, b = parent[i], parent[j]
        open_ = a != b
        if not open_.any():
            return parent
        a, b, i, j = a[open_], b[open_], i[open_], j[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        parent = _compress(parent)


def _compare(parent: np.ndarray, v: np.ndarray, pairs: np.ndarray, budget: int) -> np.ndarray:
    """Compare all members of node pairs (columns: a_lo, a_hi, b_lo, b_hi), a chunk at a time."""
    na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
    ends = np.cumsum(na * nb)
    start = 0
    while start < len(pairs):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        size = (na * nb)[start:stop]
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row = np.repeat(np.arange(start, stop), size)
        i, j = pairs[row, 0] + k // nb[row], pairs[row, 2] + k % nb[row]
        near = (i != j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
        parent = _unite(parent, i[near], j[near])
        start = stop
    return parent


def trie_forest(group: np.ndarray, v: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For rows sorted by (group, v): each row's root among rows linked inside its group.

    Depth by depth, a node is a range of rows with a common prefix. Node pairs carry the
    bits in which their prefixes differ.
    """
    n = len(v)
    parent = np.arange(n)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    last = np.r_[first[1:], n] if n else first
    some = last - first > 1
    front = np.stack([first[some], last[some], first[some], last[some], np.zeros(some.sum(), np.int64)], axis=1)
    for bit in range(BITS - 1, -2, -1):
        small = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2]) <= DIRECT if bit >= 0 else np.ones(len(front), bool)
        parent = _compare(parent, v, front[small, :4], budget)
        front = front[~small]
        if not len(front):
            break
        ones = np.r_[0, np.cumsum((v >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)]
        a0, a1, b0, b1, err = front.T
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        off = ~same
        front = np.concatenate([
            np.stack([a0, am, b0, bm, err], axis=1),
            np.stack([am, a1, bm, b1, err], axis=1),
            np.stack([a0, am, bm, b1, err + 1], axis=1),
            np.stack([am, a1, b0, bm, err + 1], axis=1)[off],
        ])
        front = front[(front[:, 4] <= budget) & (front[:, 0] < front[:, 1]) & (front[:, 2] < front[:, 3])]
        alone = (front[:, 0] == front[:, 2]) & (front[:, 1] == front[:, 3]) & (front[:, 1] - front[:, 0] == 1)
        front = front[~alone]
    return parent


def _links(budget: int, flush_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(group, turn, rot):
            root = trie_forest(group, rot, budget)
            far = root != np.arange(len(root))
            s = (turn * WIDTH).astype(np.uint64)
            fp = np.where(s == 0, rot, (rot >> s) | (rot << ((np.uint64(BITS) - s) % np.uint64(BITS))))
            return pa.record_batch([pa.array(fp[far].view(np.int64)), pa.array(fp[root[far]].view(np.int64))], names=["src", "dst"])

        kept: list[tuple[np.ndarray, ...]] = []
        held = 0
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            kept.append((cols[0], cols[1], cols[2].view(np.uint64)))
            held += b.num_rows
            if held >= flush_at:
                g, t, r = (np.concatenate(x) for x in zip(*kept))
                edge = int(np.searchsorted(g, g[-1], "left"))
                if edge:
                    yield solve(g[:edge], t[:edge], r[:edge])
                kept, held = [(g[edge:], t[edge:], r[edge:])], len(g) - edge
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*kept)))

    return run


def links(fps: DataFrame, budget: int = BUDGET, split_above: int = 20_000, flush_at: int = 200_000) -> DataFrame:
    """Edges ``(src, dst)`` whose components are those of the links between distinct ``fp``."""
    if budget >= BLOCKS:
        raise ValueError("with four blocks at most three bits may differ")
    spark = fps.sparkSession
    turns = F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("turn"), _rotated("fp", t * WIDTH).alias("rot")) for t in range(BLOCKS))))
    rows = fps.select(turns.alias("x")).select("x.turn", "x.rot").withColumn("grp", F.shiftleft("turn", WIDTH).bitwiseOR(_block("rot", 0)))
    sizes = rows.groupBy("grp").count().where(F.col("count") > split_above)  # 4 * 2^16 groups at most
    hot = cut(sizes.select("grp"))
    normal = rows.select("grp", "turn", "rot")
    if not hot.isEmpty():
        normal = rows.join(F.broadcast(hot), "grp", "left_anti").select("grp", "turn", "rot")
        second = rows.join(F.broadcast(hot), "grp")
        parts = []
        for s in range(1, BLOCKS):
            own = _block("rot", s)
            keys = F.explode(_own_and_cleared(own))
            parts.append(second.select("grp", "turn", "rot", keys.alias("sub")).select((F.lit(1 << 40) + F.col("grp") * F.lit(1 << 18) + F.lit(s << 16) + F.col("sub")).alias("grp"), "turn", "rot"))
        for p in parts:
            normal = normal.unionByName(p)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = normal.repartition(n, "grp").sortWithinPartitions("grp", _sortable("rot"))
    return dealt.mapInArrow(_links(budget, flush_at), "src long, dst long")


def _own_and_cleared(own):
    """A block's value, and those that it has with one of its set bits cleared."""
    mask = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    cleared = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.when(own.bitwiseAND(mask(i)) != 0, own - mask(i)))
    return F.concat(F.array(own), F.filter(cleared, lambda x: x.isNotNull()))


def _rotated(col: str, by: int):
    c = F.col(col)
    return c if by == 0 else F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, BITS - by))


def _block(col: str, i: int):
    return F.shiftrightunsigned(F.col(col), BITS - WIDTH * (i + 1)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def _sortable(col: str):
    """Unsigned order: flip the sign bit."""
    return F.col(col).bitwiseXOR(F.lit(-(1 << 63)))


def _rooted(distinct: DataFrame, budget: int, split_above: int) -> DataFrame:
    """``distinct`` with the root of each fingerprint's group."""
    root = roots(links(distinct, budget, split_above)).select(F.col("id").alias("fp"), "root")
    return distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, split_above: int = 20_000) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row for each row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included.
    """
    marked = cut(fingerprints(docs, id_col, text_col).select("doc_id", "fp"))
    rooted = _rooted(cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))), budget, split_above)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(known, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, split_above: int = 20_000) -> DataFrame:
    """One row of each group of linked rows, with its columns: that of smallest id (nulls last), then of least text MD5.

    Rows are told apart by id and text, never by id alone: rows of one id whose texts aren't linked all stay, and
    null ids follow the same rule. Where rows equal in both differ in other columns, the one of least row hash stays.
    """
    keyed = cut(fingerprints(docs, id_col, text_col).groupBy("doc_id", "h").agg(F.first("fp").alias("fp"), F.count("*").alias("copies")))
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "h", "copies")
    rooted = _rooted(cut(keyed.groupBy("fp").agg(F.min(order).alias("best"))), budget, split_above)
    stay = cut(rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.*"))
    names = docs.columns

    def rows_of(found: DataFrame) -> DataFrame:
        keyed_docs = docs.select(F.struct(*own_columns(names)).alias("row"), F.col(id_col).alias("own_id"), text_hash(F.col(text_col).cast("binary")).alias("own_h"))
        return keyed_docs.join(found, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_h") == F.col("h")), "left_semi")

    kept = rows_of(stay.where("copies = 1")).select("row.*")
    again = stay.where("copies > 1")
    if not again.isEmpty():
        same = rows_of(again).groupBy("own_id", "own_h").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = kept.unionByName(same.select("row.*"))
    return kept
