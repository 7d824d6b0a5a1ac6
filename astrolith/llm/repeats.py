"""Removal of repeated 400-byte strings by a hash-compared suffix sort.

Every byte goes that a string of ``length`` (400) bytes covers which also starts anywhere else, in the same
document or another; overlaps count, and strings are judged on the input.

**Anchors.** Each 400-byte string has one anchor: the first gram of ``gram`` bytes with the least order among
its grams. The order is a gram's hash, after a flag for grams of a short period, so that long runs of a period
get few anchors. The anchor depends on the string's content only: two equal strings have the same anchor at
the same offset. An anchor stands for a range of strings, given by the nearest grams before and after it
that would take its place. Anchor hashes that occur once are dropped by a count.

**Suffix sort.** For the other anchors, the bytes to the right and, reversed, to the left, as far as
its strings reach, are two families of suffixes. In groups of equal anchors both are sorted by a bottom-up
mergesort; a comparison takes the longest common extension by binary search over prefix polynomial hashes, so
it needs a logarithmic number of steps. Neighbours' extensions are verified byte by byte afterwards, and a
batch in which a hash collided is sorted by its bytes. Rows whose left extensions reach ``o`` bytes and right
ones ``400 - o`` form runs of either order; the 400-byte string ``o`` bytes left of an anchor is repeated if
another row shares both runs. The least and the largest such ``o`` bound what the anchor removes.

**Scale.** Equal texts are counted first, and only one of them is searched. Anchors are written once, in 20 bytes
each. Texts move twice, dealt by a hash of the text; contexts move only for anchors that occur again. Equal contexts
inside one text are settled there. A group of more than ``split_above`` anchors is dealt anew in bands of offsets, by the
bytes that all strings of a band share (an eighth less than a string at least), so that it is sorted in parts. Equal contexts of
different texts are counted and settled first, and one of each goes on; a part of one row has no repeats and is dropped before
contexts move. Parts that are still too large get narrower bands, down to one offset, where all equal strings are equal contexts.

Nulls: a null text is empty; a null id keeps its row. Repeated rows are occurrences of their own. Texts shorter
than ``length`` stay whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.session import cut


@dataclass(frozen=True)
class Settings:
    length: int = 400
    gram: int = 100
    split_above: int = 500
    flush_rows: int = 4_096


#: Numbers of large groups, and of their rows without contexts, up to which they are sent to all tasks.
HOT_SENT = 100_000
#: A band of offsets is this share of a string, and of the band before it.
BANDS = 8
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A polynomial hash of each run of ``gram`` bytes, well mixed."""
    n = len(b)
    h = np.zeros(n - gram + 1, np.uint64)
    # Doubling: hashes of runs of 1, 2, 4, ... bytes; the run's length is put together from these.
    cur, size, at = b.astype(np.uint64) + np.uint64(1), 1, 0
    while True:
        if gram & size:
            h = h * np.uint64(pow(int(BASE), size, 1 << 64)) + cur[at : at + len(h)]
            at += size
        size *= 2
        if size > gram:
            break
        half = size // 2
        cur = cur[:-half] * np.uint64(pow(int(BASE), half, 1 << 64)) + cur[half:]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _window_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours: blocks' minima from the left and from the right."""
    n = len(h)
    pad = -n % w
    x = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    fore = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


PERIOD, PROBE = 50, 16


def _orders(body: bytes, gram: int) -> np.ndarray:
    """The order of each gram: its hash, with the top bit set if it has a period of at most ``PERIOD``."""
    raw = np.frombuffer(body, np.uint8)
    h = gram_hashes(raw, gram) >> np.uint64(1)
    found = set()
    step = max(1, gram - PERIOD - PROBE - 1)
    for p in range(0, len(body) - PROBE, step):
        word, at = body[p : p + PROBE], p
        while (at := body.find(word, at + 1, p + PERIOD + PROBE)) >= 0:
            found.add(at - p)
    for d in found:
        same = np.r_[0, np.cumsum(raw[:-d] == raw[d:])]
        k = gram - d
        flag = same[k:] - same[:-k] == k
        h[: len(flag)][flag[: len(h)]] |= np.uint64(1 << 63)
    return h


@dataclass
class Anchors:
    """Positions, hashes, and the range of offsets of the strings that each anchor stands for."""

    pos: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    last: np.ndarray


#: Long texts are gone through in overlapping blocks.
BLOCK = 1 << 20


def anchors(body: bytes, s: Settings) -> Anchors:
    parts = [np.zeros((0, 3), np.int64)]
    hashes = [np.zeros(0, np.uint64)]
    w = s.length - s.gram + 1
    strings = len(body) - s.length + 1
    for at in range(0, max(0, strings), BLOCK):
        low, high = max(0, at - w), min(len(body), at + BLOCK + 2 * s.length)
        h = _orders(body[low:high], s.gram)
        if len(h) < w:
            continue
        # The leftmost least gram of each string.
        least = _window_minimum(h, w)
        n = len(least)
        # Where a gram equals its windows' minimum it is a candidate; the first one at or after a start is the start's anchor.
        padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
        cand = np.flatnonzero(~_window_minimum(~padded, w) == h)
        value = h[cand]
        # Next candidate at or after each start whose order is the start's minimum: candidates come in order, so walk by value.
        start = np.arange(n)
        k = np.searchsorted(cand, start)
        pick = k.copy()
        open_ = np.flatnonzero(value[pick] != least)
        while len(open_):
            pick[open_] += 1
            open_ = open_[value[pick[open_]] != least[open_]]
        x = cand[pick]
        edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        begin, end = edge, np.r_[edge[1:], n] - 1
        here = x[edge]
        # Strings that start in this block only; a range that crosses the border is given in two parts.
        a, z = np.maximum(begin + low, at), np.minimum(end + low, at + BLOCK - 1)
        good = a <= z
        where = here[good] + low
        parts.append(np.stack([where, where - z[good], where - a[good]], axis=1))
        hashes.append(h[here[good]])
    rows = np.concatenate(parts)
    return Anchors(rows[:, 0], np.concatenate(hashes), rows[:, 1], rows[:, 2])


class Suffixes:
    """Rows of bytes of one width with their true lengths, sorted inside groups by hashed comparisons."""

    def __init__(self, rows: np.ndarray, lens: np.ndarray):
        self.rows, self.lens = rows, lens
        self.width = rows.shape[1]
        scaled = (rows.astype(np.uint64) + np.uint64(1)) * _powers(self.width)[: self.width]
        self.prefix = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(scaled, axis=1, dtype=np.uint64)], axis=1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes by binary search over the prefix hashes: all start at 0, so prefixes compare directly."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.lens[i], self.lens[j])
        while True:
            live = low < high
            if not live.any():
                return low
            mid = (low + high + 1) // 2
            same = self.prefix[i, mid] == self.prefix[j, mid]
            low = np.where(live & same, mid, low)
            high = np.where(live & ~same, mid - 1, high)

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether row i comes before row j; equal rows keep their order."""
        k = self.common(i, j)
        a_end, b_end = self.lens[i] <= k, self.lens[j] <= k
        at = np.minimum(k, self.width - 1)
        a, b = self.rows[i, at], self.rows[j, at]
        return np.where(a_end | b_end, np.where(a_end & b_end, i < j, a_end), a < b)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Row numbers in order; rows of a group are neighbours before and after. All merges of a pass go on at once."""
        n = len(group)
        order = np.arange(n)
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, n])
        base, count = np.repeat(start, size), np.repeat(size, size)
        run, at = 1, np.arange(n) - base
        while run < size.max(initial=0):
            mine = at // run  # the run that a place lies in
            other = np.where(mine % 2 == 0, mine + 1, mine - 1)
            low = np.minimum(other * run, count)
            high = np.minimum(low + run, count)
            first, lo, hi = low.copy(), low.copy(), high.copy()
            # Binary search for the number of rows in the other run that come first.
            while True:
                live = np.flatnonzero(lo < hi)
                if not len(live):
                    break
                mid = (lo[live] + hi[live]) // 2
                there = order[base[live] + mid]
                before = self.less(there, order[live])
                lo[live[before]] = mid[before] + 1
                hi[live[~before]] = mid[~before]
            place = base + np.minimum(mine, other) * run + (at - mine * run) + (lo - first)
            new = np.empty(n, np.int64)
            new[place] = order
            order = new
            run *= 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Each place's common prefix with the place before it (-1 at a group's start), verified; a collision sorts by bytes."""
        out = np.full(len(order), -1, np.int64)
        if len(order) < 2:
            return out
        inner = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        i, j = order[inner - 1], order[inner]
        k = self.common(i, j)
        longest = np.minimum(self.lens[i], self.lens[j])
        differ = self.rows[i] != self.rows[j]
        differ[np.arange(self.width) >= longest[:, None]] = True
        full = np.concatenate([differ, np.ones((len(i), 1), bool)], axis=1)
        if (full.argmax(axis=1) != k).any():
            raise Collision
        # The earlier row ends at the border, or has the lesser byte there.
        at = np.minimum(k, self.width - 1)
        if ((self.lens[i] > k) & ((self.lens[j] <= k) | (self.rows[i, at] > self.rows[j, at]))).any():
            raise Collision
        out[inner] = k
        return out


class Collision(Exception):
    pass


def _sorted_with_extensions(rows: np.ndarray, lens: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = Suffixes(rows, lens)
    try:
        order = s.sort(group)
        return order, s.neighbours(order, group)
    except Collision:
        keys = [rows[k, : lens[k]].tobytes() for k in range(len(rows))]
        order = np.array(sorted(range(len(rows)), key=lambda k: (group[k], keys[k])), np.int64)
        near = np.full(len(order), -1, np.int64)
        for p in range(1, len(order)):
            a, b = order[p - 1], order[p]
            if group[a] == group[b]:
                x, y = keys[a], keys[b]
                near[p] = next((d for d in range(min(len(x), len(y))) if x[d] != y[d]), min(len(x), len(y)))
        return order, near


def repeated_offsets(group: np.ndarray, left: np.ndarray, left_len: np.ndarray, right: np.ndarray, right_len: np.ndarray, length: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the least and the largest offset ``first <= o <= last`` whose string another row of the group shares (-1: none)."""
    n = len(group)
    lo, hi = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    r_order, r_near = _sorted_with_extensions(right, right_len, group)
    l_order, l_near = _sorted_with_extensions(left, left_len, group)
    r_new, l_new = np.empty(n, np.int64), np.empty(n, np.int64)
    # Rows that no other row reaches in sum can be left out at once.
    best = lambda near: np.maximum(near, np.r_[near[1:], -1])
    r_best, l_best = np.empty(n, np.int64), np.empty(n, np.int64)
    r_best[r_order], l_best[l_order] = best(r_near), best(l_near)
    hope = (r_best >= 0) & (r_best + l_best >= length)
    if not hope.any():
        return lo, hi
    for o in range(first, last + 1):
        can = hope & (l_best >= o) & (r_best >= length - o)
        if not can.any():
            continue
        r_new[r_order] = np.cumsum(r_near < length - o)
        l_new[l_order] = np.cumsum(l_near < o)
        rows = np.flatnonzero(can & (left_len >= o) & (right_len >= length - o))
        key = r_new[rows] * (n + 1) + l_new[rows]
        by = np.argsort(key, kind="stable")
        k = key[by]
        same = np.r_[False, k[1:] == k[:-1]]
        shared = rows[by[same | np.r_[same[1:], False]]]
        lo[shared] = np.where(lo[shared] < 0, o, lo[shared])
        hi[shared] = o
    return lo, hi


def _key(text: F.Column) -> F.Column:
    return F.unhex(F.md5(text))


def _as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


#: An anchor in the written form: hash, place, and its strings' offsets.
ANCHOR = np.dtype([("g", "<i8"), ("pos", "<i8"), ("first", "<i2"), ("last", "<i2")])


def _packed_anchors(s: Settings):
    """A text's anchors as one run of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                a = anchors(x.as_py(), s)
                rows = np.empty(len(a.pos), ANCHOR)
                rows["g"], rows["pos"], rows["first"], rows["last"] = _as_signed(a.hash), a.pos, a.first, a.last
                out.append(rows.tobytes())
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["key", "anchors"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            runs = part.column(1).to_pylist()
            rows = np.frombuffer(b"".join(runs), ANCHOR)
            key = part.column(0).take(pa.array(np.repeat(np.arange(len(runs)), [len(x) // ANCHOR.itemsize for x in runs])))
            yield pa.record_batch([key, *(pa.array(rows[c].astype(np.int64)) for c in ANCHOR.names)], names=["key", *ANCHOR.names])


def _context_rows(s: Settings):
    """Contexts of the listed anchors. Equal contexts inside a text are settled here; the first of them goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                out: list[list] = [[] for _ in range(8)]
                part = b.slice(at, 64)
                for key, body, spots in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                    body = body.as_py()
                    seen: dict[tuple, int] = {}
                    for x in sorted(spots, key=lambda x: (x["pos"], x["first"])):
                        p, first, last = x["pos"], x["first"], x["last"]
                        left, right = body[p - last : p][::-1], body[p : p + s.length - first]
                        same = seen.get((x["g"], first, last, left, right))
                        if same is None:
                            seen[x["g"], first, last, left, right] = len(out[0])
                            for col, v in zip(out, (key, x["g"], p, first, last, left, right, False)):
                                col.append(v)
                        else:
                            out[7][same] = True
                            for col, v in zip(out, (key, None, p, first, last, None, None, True)):
                                col.append(v)
                if out[0]:
                    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names=["key", "g", "pos", "first", "last", "left", "right", "twice"])

    return run


def _matrix(rows: list[bytes], lens: np.ndarray) -> np.ndarray:
    width = max(1, int(lens.max(initial=0)))
    out = np.zeros((len(rows), width), np.uint8)
    out[np.arange(width) < lens[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
    return out


def _solve(s: Settings):
    """Sorted rows of groups to removed ranges ``(key, a, z)``."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        unique: dict[tuple, tuple] = {}
        for r in rows:
            unique.setdefault((r[1], r[0], r[2], r[3], r[4]), r)
        rows = sorted(unique.values(), key=lambda r: r[1])
        group = np.array([r[1] for r in rows])
        many = np.r_[False, group[1:] == group[:-1]]
        many |= np.r_[many[1:], False]
        rows = [r for r, m in zip(rows, many) if m]
        if not rows:
            return None
        group = group[many]
        lens = np.array([[len(r[5]), len(r[6])] for r in rows])
        first, last = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        lo, hi = repeated_offsets(group, _matrix([r[5] for r in rows], lens[:, 0]), lens[:, 0], _matrix([r[6] for r in rows], lens[:, 1]), lens[:, 1], s.length, int(first.min()), int(last.max()))
        hit = np.flatnonzero(lo >= 0)
        pos = np.array([r[2] for r in rows])
        return pa.record_batch([pa.array([rows[k][0] for k in hit], pa.binary()), pa.array(pos[hit] - hi[hit]), pa.array(pos[hit] - lo[hit] + s.length)], names=["key", "a", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held += zip(*(b.column(i).to_pylist() for i in range(7)))
            if len(held) >= s.flush_rows:
                tail = held[-1][1]
                k = len(held)
                while k and held[k - 1][1] == tail:
                    k -= 1
                if k and (out := solve(held[:k])) is not None:
                    yield out
                held = held[k:]
        if held and (out := solve(held)) is not None:
            yield out

    return run


def _sent(small: DataFrame) -> DataFrame:
    """Written rows, marked to be sent to all tasks if they are few."""
    return F.broadcast(small) if small.count() <= HOT_SENT else small


def _banded(rows: DataFrame, s: Settings, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows of large groups, dealt anew: ranges of those whose context in a band occurs again, and the rows left to sort.
    Equal strings that reach ``lo`` to ``hi`` bytes to the left of an anchor, a band, share ``lo`` bytes to its left and
    ``length - hi`` to its right."""
    spot, lo = F.struct("key", "pos", "first"), F.col("lo")
    hi = F.least(lo + (width - 1), F.lit(s.length - s.gram))
    piece = lambda c, n: F.substring(c, F.lit(1), n.cast("int"))
    banded = rows.withColumn("lo", F.explode(F.expr(f"sequence(first - first % {width}, last - last % {width}, {width}L)")))
    banded = banded.withColumns({"low": F.greatest("first", lo), "high": F.least("last", hi), "h": F.xxhash64("lo", "g", piece("left", lo), piece("right", s.length - hi))})
    head = F.concat_ws(":", *(F.col(c).cast("string") for c in ("h", "low", "high")), F.lit("")).cast("binary")
    context = F.unhex(F.md5(F.concat(head, piece("left", F.col("high")), piece("right", s.length - F.col("low")))))
    # Equal texts give equal rows, which count once. ``first`` names the row, ``low`` and ``high`` its offsets in the band.
    marked = cut(banded.select("key", "pos", "first", "low", "high", "h", context.alias("c")).distinct())
    again = _sent(cut(marked.groupBy("c").agg(F.min(spot).alias("one"), F.count("*").alias("n")).where("n > 1").select("c", "one")))
    known = marked.join(again, "c", "left")
    ranges = known.where("one IS NOT NULL").select("key", (F.col("pos") - F.col("high")).alias("a"), (F.col("pos") - F.col("low") + s.length).alias("z"))
    parts = cut(known.where(F.col("one").isNull() | (F.col("one") == spot)).select("key", "pos", "first", "low", "high", "h"))
    met = _sent(cut(parts.groupBy("h").count().where("count > 1").select("h")))
    back = rows.join(_sent(cut(parts.join(met, "h", "left_semi"))), ["key", "pos", "first"])
    kept = {"left": piece("left", F.col("high")), "right": piece("right", s.length - F.col("low"))}
    return ranges, cut(back.withColumns(kept).select("key", F.col("h").alias("g"), "pos", F.col("low").alias("first"), F.col("high").alias("last"), "left", "right"))


def repeated_ranges(texts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(key, a, z)``: bytes ``[a, z)`` go from the text of that key. ``texts`` has (key, body); equal rows count once."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = texts.where(F.octet_length("body") >= s.length)
    # Anchors are sought once and written in 20 bytes each; they are counted and filtered from there.
    packed = cut(long.mapInArrow(_packed_anchors(s), "key binary, anchors binary"))
    found = packed.mapInArrow(_unpacked, "key binary, g long, pos long, first long, last long")
    spot = F.struct("key", "pos", "first")
    again = cut(found.groupBy("g").agg(F.min(spot).alias("x"), F.max(spot).alias("y"), F.count("*").alias("n")).where("x <> y").select("g", "n"))
    # Anchors with a ten-thousandth of all anchors and more: at most 10,000, so they can be sent to all tasks, and their
    # rows don't meet in one.
    total = packed.agg(F.sum(F.octet_length("anchors"))).first()[0] or 0
    most = again.where(F.col("n") >= max(10_000, total // ANCHOR.itemsize // 10_000 + 1)).select("g")
    frequent = found.join(F.broadcast(most), "g", "left_semi")
    others = found.join(F.broadcast(most), "g", "left_anti").join(again.select("g"), "g", "left_semi")
    # The anchors that occur again are written once: contexts, group sizes and ranges all follow from them.
    dup = cut(frequent.unionByName(others))
    # A text's anchors are bounded by its own length.
    spots = dup.groupBy("key").agg(F.collect_set(F.struct("g", "pos", "first", "last")).alias("spots"))
    contexts = cut(long.join(spots, "key").select("key", "body", "spots").mapInArrow(_context_rows(s), "key binary, g long, pos long, first long, last long, left binary, right binary, twice boolean"))
    local = contexts.where("twice").select("key", (F.col("pos") - F.col("last")).alias("a"), (F.col("pos") - F.col("first") + s.length).alias("z"))
    rows = contexts.where("g is not null").select("key", "g", "pos", "first", "last", "left", "right")
    ranges = local
    width, small_groups = s.length, []
    while width > 1 and not (hot := cut(rows.groupBy("g").count().where(F.col("count") > s.split_above).select("g"))).isEmpty():
        width, large = max(1, width // BANDS), _sent(hot)
        small_groups.append(rows.join(large, "g", "left_anti").select(*rows.columns))
        settled, rows = _banded(rows.join(large, "g", "left_semi").select(*rows.columns), s, width)
        ranges = ranges.unionByName(settled)
    for part in small_groups:
        rows = rows.unionByName(part)
    dealt = rows.repartition(n, "g").sortWithinPartitions("g")
    return ranges.unionByName(dealt.mapInArrow(_solve(s), "key binary, a long, z long"))


def _apply(kind: str, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for body, copies, ranges in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                body = body.as_py()
                spans: list[list[int]] = []
                if copies and copies > 1 and len(body) >= s.length:
                    spans = [[0, len(body)]]
                else:
                    for r in sorted(ranges or (), key=lambda r: r["a"]):
                        if spans and r["a"] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], r["z"])
                        else:
                            spans.append([r["a"], r["z"]])
                kept, at = [], 0
                for a, z in spans:
                    kept.append(body[at:a])
                    at = z
                kept.append(body[at:])
                for col, v in zip(out, (len(body), sum(z - a for a, z in spans), len(spans), [{"a": a, "z": z} for a, z in spans], b"".join(kept))):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])), pa.binary())
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<a:long,z:long>>, kept binary"


def remove_repeats(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``(doc_id, n_bytes, n_removed, n_spans, spans, kept)``: byte ranges removed, and the other bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), _key(text).alias("key"), text.cast("binary").alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    copies = cut(rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep")).where("copies > 1"))
    total = docs.select(F.lit(1)).count()
    # Texts with a ten-thousandth of all rows and more: at most 10,000, so they can be sent to all tasks. Their copies
    # are settled where they are read; only rows with the least id go on.
    most = copies.where(F.col("copies") >= F.greatest(F.lit(1000), F.lit(total // 10_000 + 1))).select("key", F.col("rep").alias("most_rep"), F.col("copies").alias("most"))
    marked = rows.join(F.broadcast(most), "key", "left")
    settled = F.col("most").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("most_rep"))
    rest = marked.where(~settled).select("doc_id", "key", "body")
    ranges = repeated_ranges(rest.select("key", "body"), s)
    facts = ranges.groupBy("key").agg(F.collect_list(F.struct("a", "z")).alias("ranges")).join(copies.select("key", "copies"), "key", "full_outer")
    run, schema = _apply(kind, s)
    done = rest.join(facts, "key", "left").select("doc_id", "body", "copies", "ranges")
    quick = marked.where(settled).select("doc_id", "body", F.col("most").alias("copies"), F.lit(None).cast("array<struct<a:long,z:long>>").alias("ranges"))
    return done.unionByName(quick).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every 400-byte string by its hash. Texts are taken as hexadecimal digits, in parts that overlap.
ORACLE = """WITH body AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT *, octet_length(b)::BIGINT AS n FROM body),
hexed AS (SELECT r, n, hex(b) AS h FROM sized WHERE n >= 400),
part AS (SELECT r, n, k, substr(h, 2 * 1024 * k + 1, 2 * 1423) AS h FROM (SELECT *, unnest(range(0, (n - 400) // 1024 + 1)) AS k FROM hexed)),
win AS (SELECT r, 1024 * k + o AS p, md5(substr(h, 2 * o + 1, 800)) AS w FROM (SELECT *, unnest(range(0, least(1024, n - 399 - 1024 * k))) AS o FROM part)),
dup AS (SELECT w FROM win GROUP BY w HAVING count(*) > 1),
hit AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM win SEMI JOIN dup USING (w)),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR p > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS s FROM hit),
span AS (SELECT r, s, min(p) AS a, max(p) + 400 AS z FROM marked GROUP BY r, s),
gaps AS (SELECT r, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS kept, max(z) AS last, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed
  FROM (SELECT span.*, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS e FROM span) JOIN hexed USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN kept IS NULL THEN hex(b) ELSE kept || substr(hex(b), 2 * last + 1) END)) AS kept_sha256
FROM sized LEFT JOIN gaps USING (r)
"""
