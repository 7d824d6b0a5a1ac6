"""SentencePiece encoding and decoding by a weighted finite-state transducer.

**Compilation.** The model file gives the normaliser (dummy prefix, white space escapes), the pieces and the
byte fallback. Its transducer reads characters and writes pieces: an arc for each piece, and for each
character without a piece an arc that writes its bytes. For a unigram model an arc weighs the
piece's negative score. For a BPE model arcs are free, but carry the last piece as state: piece b may
follow piece a only if no merge of lower rank would ever join them across their border, else the weight is
infinite. One path per text is then finite, namely the BPE segmentation.

**Encoding.** Composition with an input is a lattice over its positions; its shortest path in the
tropical semiring (min, +) gives the pieces. As no piece holds white space after another character,
no arc crosses a word's start, so the lattice falls apart into words; nor does one cross two characters that are
neighbours in no piece, so words fall apart into units: runs of one class of characters, as neighbours connect them.
Distinct units of a batch are solved together, position by position; units that a worker saw before are looked up, in a
memory of bounded size that keeps those met most, and so are the results for pairs of pieces.

**Decoding.** Pieces and bytes are joined, white space marks become spaces, the dummy prefix goes.

Documents are read once, without a shuffle; the compiled tables' size is bounded by the vocabulary.
Nulls: a null text has null ids; an empty text has none. Text that holds U+2581 itself is decoded with a
space there, as the format can't tell them apart. Repeated rows and null ids keep their rows; an empty
table gives an empty result; other columns are not read. Texts of any length are whole.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
FREE = np.iinfo(np.int64).max
#: Words of more characters are solved one at a time.
LONG = 48
#: Bits of the number of pairs of pieces whose judgement is kept.
PAIR_BITS = 21
#: Texts are encoded together up to about so many bytes.
TOGETHER = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of one protobuf message: (number, int, bytes or 4 raw bytes)."""
    at = 0

    def varint():
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError("not a model file")


class Lookup:
    """Places of 64-bit keys, by buckets of their mixed top bits."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        h = self._mix(keys)
        self.order = np.argsort(h)
        self.keys = keys[self.order]
        self.start = np.searchsorted(h[self.order] >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    @staticmethod
    def _mix(keys: np.ndarray) -> np.ndarray:
        return keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among those given, or -1."""
        out = np.full(len(keys), -1, np.int64)
        bucket = (self._mix(keys) >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            hit = self.keys[here] == keys[open_]
            out[open_[hit]] = self.order[here[hit]]
            at[open_] += 1
            open_ = open_[~hit & (here + 1 < end[open_])]
        return out


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    dummy_prefix: bool
    squeeze: bool


def read_model(data: bytes) -> Model:
    m = Model([], [], [], False, True, True)
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append(piece)
            m.scores.append(score)
            m.kinds.append(kind)
        elif number == 2:
            kind = dict(_fields(value)).get(3, 1)
            if kind not in (1, 2):
                raise ValueError("only unigram and BPE models")
            m.bpe = kind == 2
        elif number == 3:
            spec = dict(_fields(value))
            if spec.get(2):
                raise ValueError("only the identity character map")
            m.dummy_prefix, m.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
    return m


class Transducer:
    """Compiled tables. Symbols: piece ids, then characters that occur inside pieces only."""

    def __init__(self, model: Model):
        self.model = model
        self._encoder: Encoder | None = None
        self.symbol: dict[str, int] = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, USER)}
        self.byte = [-1] * 256
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds)):
            if k == BYTE:
                self.byte[int(p[3:5], 16)] = i
        self.unknown = model.kinds.index(UNKNOWN)
        texts = [p for p in self.symbol if len(p) > 1]
        inside = {c for p in texts for c in p}
        self.neighbours = {p[k : k + 2] for p in texts for k in range(len(p) - 1)}
        self.size = len(model.pieces)
        for c in sorted(inside - self.symbol.keys()):
            self.symbol[c] = self.size
            self.size += 1
        self.longest = max(map(len, self.symbol), default=1)
        self.rank = np.full(self.size + 1, -1, np.int64)  # single characters exist from the start
        self.left, self.right = np.full(self.size + 1, -1, np.int64), np.full(self.size + 1, -1, np.int64)
        self.length = np.ones(self.size + 1, np.int64)
        for p, i in self.symbol.items():
            self.length[i] = len(p)
        if model.bpe:
            self._compile_merges(texts)
        self.words = not any(SPACE in p.lstrip(SPACE) for p in texts)
        self.classes = self._classes()
        arcs = [(p, i) for p, i in self.symbol.items() if i < len(model.pieces) and (not model.bpe or len(p) == 1 or self.left[i] >= 0)]
        # The input side is a trie: a state for each prefix of a piece, and a step for each state and character (0: any other).
        prefixes: dict[str, int] = {p[:j]: -1 for p, _ in arcs for j in range(1, len(p) + 1)}
        prefixes.update(arcs)
        state = {p: k for k, p in enumerate(prefixes)}
        letters = sorted({c for p in prefixes for c in p} | {c for c in self.symbol if len(c) == 1})
        char = {c: k for k, c in enumerate(letters, 1)}
        self.alphabet = len(letters) + 1
        self.char = np.zeros(max(map(ord, letters), default=0) + 2, np.int64)  # the last: characters beyond
        self.char[[ord(c) for c in letters]] = list(char.values())
        self.char_symbol = np.array([self.size, *(self.symbol.get(c, self.size) for c in letters)], np.int64)
        self.first = np.array([-1, *(state.get(c, -1) for c in letters)], np.int64)
        deeper = [p for p in prefixes if len(p) > 1]
        self.steps = Lookup(np.array([state[p[:-1]] * self.alphabet + char[p[-1]] for p in deeper], np.int64))
        self.step_to = np.array([state[p] for p in deeper] + [-1], np.int64)  # the last: no such step
        self.arc_id = np.array([*prefixes.values(), -1], np.int64)
        self._pairs: np.ndarray | None = None
        self.cost = np.zeros(self.size + 1)
        if not model.bpe:
            floor = min((s for s, k in zip(model.scores, model.kinds) if k == NORMAL), default=0.0)
            for i, s in enumerate(model.scores):
                self.cost[i] = -s if model.kinds[i] == NORMAL else -0.1 if model.kinds[i] == USER else 0
            self.cost[self.size] = 10.0 - floor

    def _classes(self) -> list[str]:
        """Characters that neighbours in pieces connect; two of different classes are neighbours in no piece."""
        of: dict[str, set[str]] = {}
        for a, b in self.neighbours:
            if self.words and a == SPACE:
                continue
            x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
            if x is not y:
                x |= y
                of.update(dict.fromkeys(y, x))
        return sorted({id(x): "".join(sorted(x)) for x in of.values()}.values(), key=len, reverse=True)

    def _compile_merges(self, texts: list[str]) -> None:
        """Each piece's rank and the two symbols of its last merge; all pairs of symbols that make a piece."""
        order = sorted(texts, key=lambda p: (-self.model.scores[self.symbol[p]], self.symbol[p]))
        joins: dict[tuple[int, int], int] = {}
        for r, p in enumerate(order):
            i = self.symbol[p]
            self.rank[i] = r
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    joins[a, b] = i
        # As lists while compiling.
        for p in order:
            i = self.symbol[p]
            seq = [self.symbol[c] for c in p]
            while len(seq) > 1:
                best = min(((self.rank[joins[x]], k) for k, x in enumerate(zip(seq, seq[1:])) if x in joins), default=None)
                if best is None:
                    break
                k = best[1]
                if len(seq) == 2:
                    self.left[i], self.right[i] = seq
                seq[k : k + 2] = [joins[seq[k], seq[k + 1]]]
        self.joins = Lookup(np.array([a * (self.size + 1) + b for a, b in joins], np.int64))
        self.join_rank = np.append(self.rank[list(joins.values())], FREE)  # the last: no such pair

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a: undo the later of the two symbols at the border, step by step,
        and look for a merge across it that came before the symbol that was undone last."""
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        until = np.full(len(a), FREE)  # merges across the border below this rank would have happened
        equal = np.zeros(len(a), bool)  # whether one of that rank itself, being further left, would have too
        while len(live):
            x, y = a[live], b[live]
            r = self.join_rank[self.joins.find(x * (self.size + 1) + y)]
            bad = (r != FREE) & ((r < until[live]) | ((r == until[live]) & equal[live]))
            ok[live[bad]] = False
            done = bad | ((self.rank[x] < 0) & (self.rank[y] < 0))
            live, x, y = live[~done], x[~done], y[~done]
            of_a = self.rank[x] >= self.rank[y]
            # Of equal ranks the left one merged first, so the right one is undone first.
            of_a &= ~((self.rank[x] == self.rank[y]) & (self.rank[y] >= 0))
            until[live] = np.where(of_a, self.rank[x], self.rank[y])
            equal[live] = ~of_a
            a[live] = np.where(of_a, self.right[x], x)
            b[live] = np.where(of_a, y, self.left[y])
        return ok

    def shortest(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Blocks of words of about one length: the words, the symbols of their shortest paths one after another, and
        where each path ends. ``size`` stands for a character without a piece."""
        order = sorted(words, key=len)
        for at in range(0, len(order), 8192):
            some = order[at : at + 8192]
            yield some, *self._solve(some)

    def _solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n, lens = len(words), np.array([len(w) for w in words])
        top = int(lens.max(initial=0))
        code = np.zeros((top, n), np.int64)
        flat = self.char[np.minimum(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), len(self.char) - 1)]
        starts = np.cumsum(lens) - lens
        for j in range(top):
            has = lens > j
            code[j, has] = flat[starts[has] + j]
        last = np.full((top + 1, n), -1, np.int64)  # the piece that ends a prefix's path
        cost = np.full((top + 1, n), np.inf)
        cost[0] = 0
        # Forward: arcs that start at i are tried against the path that ends there.
        for i in range(top):
            here = np.flatnonzero((lens > i) & np.isfinite(cost[i]))
            if not len(here):
                continue
            rows, at = here, self.first[code[i, here]]
            for j in range(i, min(top, i + self.longest)):
                if j > i:
                    keep = lens[rows] > j
                    rows = rows[keep]
                    if not len(rows):
                        break
                    at = self.step_to[self.steps.find(at[keep] * self.alphabet + code[j, rows])]
                piece = self.arc_id[at]
                if j == i:
                    piece[piece < 0] = self.size  # byte fallback: a character always has an arc
                hit = piece >= 0
                r, p = rows[hit], piece[hit]
                known = at >= 0
                rows, at = rows[known], at[known]
                if self.model.bpe and i and len(r):
                    fine = self._follows(last[i, r], p, code[i - 1, r], code[i, r])
                    r, p = r[fine], p[fine]
                new = cost[i, r] + self.cost[p]
                better = new < cost[j + 1, r]
                r, p = r[better], p[better]
                cost[j + 1, r], last[j + 1, r] = new[better], p
        steps, at = np.full((n, top), -1, np.int64), lens.copy()
        for k in range(top - 1, -1, -1):
            on = np.flatnonzero(at > 0)
            if not len(on):
                break
            steps[on, k] = last[at[on], on]
            at[on] -= self.length[steps[on, k]]
        used = steps >= 0
        return steps[used], np.cumsum(used.sum(axis=1))

    def encoder(self) -> Encoder:
        """This process's encoder: its memories outlive a task where Spark uses a worker again."""
        if not self._encoder:
            self._encoder = Encoder(self)
        return self._encoder

    def _follows(self, a, b, before, after):
        # A character without a piece may still be a symbol inside larger ones.
        a, b = np.where(a == self.size, self.char_symbol[before], a), np.where(b == self.size, self.char_symbol[after], b)
        if self._pairs is None:
            self._pairs = np.full(1 << PAIR_BITS, -1, np.int64)
        # Pairs judged before are kept with their result, the latest of each place.
        pair = a * (self.size + 1) + b
        place = Lookup._mix(pair) >> np.uint64(64 - PAIR_BITS)
        kept = self._pairs[place]
        ok = (kept & 1).astype(bool)
        new = np.flatnonzero(kept >> 1 != pair)
        if len(new):
            ok[new] = self.may_follow(a[new], b[new])
            self._pairs[place[new]] = pair[new] * 2 + ok[new]
        return ok


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs of ``size`` from ``start``, one run after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Encoder:
    """Texts to piece ids and back, with a memory of at most ``remember`` units besides those of a batch.

    Units are numbered as they are met; ``ids`` holds their piece ids, one unit after another.
    """

    def __init__(self, transducer: Transducer, remember: int = 800_000):
        self.t, self.remember = transducer, remember
        self.number = defaultdict(count().__next__)
        self.ids = np.zeros(0, np.int32)
        self.start, self.size, self.met = (np.zeros(0, np.int64) for _ in range(3))
        runs = "|".join([*(f"[{re.escape(c)}]+" for c in transducer.classes), "."])
        self.split = re.compile(f"{SPACE}*(?:{runs})" if transducer.words else runs, re.S)
        out = []
        for i, (p, k) in enumerate(zip(transducer.model.pieces, transducer.model.kinds)):
            out.append(b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode())
        self.out = pa.array(out, pa.large_binary())

    def normalise(self, text: str) -> str:
        m = self.t.model
        if m.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if m.dummy_prefix else "") + text.replace(" ", SPACE)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray | None]:
        ids, edges = self.encode_together(texts)
        return [None if x is None else ids[a:z] for x, a, z in zip(texts, edges, edges[1:])]

    def encode_together(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin; the last: where they end."""
        if len(self.number) > self.remember:
            self._forget()
        number, old = self.number.__getitem__, len(self.number)
        parts = [np.zeros(0, np.int64)]
        for x in texts:
            units = [] if x is None else self.split.findall(self.normalise(x))
            parts.append(np.fromiter(map(number, units), np.int64, len(units)))
        if len(self.number) > old:
            self._solve(list(islice(reversed(self.number), len(self.number) - old))[::-1])
        met = np.concatenate(parts)
        self.met += np.bincount(met, minlength=len(self.met))
        size = self.size[met]
        ids = self.ids[_places(self.start[met], size)]
        return ids, np.r_[0, np.cumsum(size)][np.cumsum([len(x) for x in parts])]

    def _forget(self) -> None:
        """Half of the memory goes: the units that were met least; the counts of the others fade."""
        stays = np.zeros(len(self.number), bool)
        stays[np.argpartition(-self.met, self.remember // 2)[: self.remember // 2]] = True
        units, size = list(compress(self.number, stays.tolist())), self.size[stays]
        self.number = defaultdict(count(len(units)).__next__, zip(units, range(len(units))))
        self.ids = self.ids[_places(self.start[stays], size)]
        self.start, self.size, self.met = np.cumsum(size) - size, size, self.met[stays] // 2

    def _units(self, word: str) -> list[str]:
        """The word cut between characters that are neighbours in no piece."""
        near = self.t.neighbours
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in near]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def _solve(self, new: list[str]) -> None:
        """The ids of the units of the next numbers."""
        none, first, at = self.t.size, len(self.size), len(self.ids)
        start, size, runs, odd = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [self.ids], []
        for some, path, ends in self.t.shortest([u for u in new if len(u) <= LONG]):
            k, begin = np.fromiter(map(self.number.__getitem__, some), np.int64, len(some)) - first, np.r_[0, ends[:-1]]
            start[k], size[k] = at + begin, ends - begin
            runs.append(path.astype(np.int32))
            at += len(path)
            odd += [(k[j], self._ids(some[j], path[begin[j] : ends[j]])) for j in np.unique(np.searchsorted(ends, np.flatnonzero(path == none), "right"))]
        long = {k: self._units(u) for k, u in enumerate(new) if len(u) > LONG}
        inner = {x: self._ids(x, _one(self.t, x)) if len(x) > LONG else None for us in long.values() for x in us}
        for some, path, ends in self.t.shortest([x for x, ids in inner.items() if ids is None]):
            inner |= {x: self._ids(x, path[a:z]) for x, a, z in zip(some, [0, *ends[:-1]], ends)}
        odd += [(k, np.concatenate([inner[x] for x in us])) for k, us in long.items()]
        for k, ids in odd:
            start[k], size[k] = at, len(ids)
            runs.append(ids)
            at += len(ids)
        self.ids, self.start, self.size = np.concatenate(runs), np.r_[self.start, start], np.r_[self.size, size]
        self.met = np.r_[self.met, np.zeros(len(new), np.int64)]

    def _ids(self, word: str, path: np.ndarray) -> np.ndarray:
        ids, at = [], 0
        t = self.t
        for p in path.tolist():
            if p == t.size:
                raw = word[at].encode("utf-8", "surrogatepass")
                ids += [t.byte[b] for b in raw] if min(t.byte) >= 0 else [t.unknown]
            else:
                ids.append(p)
            at += int(t.length[p])
        return np.array(ids, np.int32)

    def decode(self, ids) -> bytes:
        return self.decode_batch([ids])[0]

    def decode_batch(self, many: list) -> list[bytes | None]:
        """The bytes of each list of ids."""
        some = [np.asarray(x, np.int32) for x in many if x is not None]
        found = iter(self.decode_together(np.concatenate([np.zeros(0, np.int32), *some]), np.cumsum([0, *map(len, some)])))
        return [None if x is None else next(found) for x in many]

    def decode_together(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        taken = self.out.take(pa.array(ids))
        _, ends, body = taken.buffers()
        at, body = np.frombuffer(ends, np.int64)[edges].tolist(), memoryview(body or b"")
        dummy = self.t.model.dummy_prefix
        return [bytes(body[a + (dummy and body[a:z][:1] == b" ") : z]) for a, z in zip(at, at[1:])]


def _one(t: Transducer, word: str) -> np.ndarray:
    """The shortest path of one long word; arcs from a position are tried together."""
    n = len(word)
    last, cost = [-1] * (n + 1), [float("inf")] * (n + 1)
    cost[0] = 0.0
    for i in range(n):
        if cost[i] == float("inf"):
            continue
        ends, ids = [i + 1], [t.symbol[word[i]] if t.symbol.get(word[i], t.size) < len(t.model.pieces) else t.size]
        for j in range(i + 2, min(n, i + t.longest) + 1):
            p = t.symbol.get(word[i:j])
            if p is not None and (not t.model.bpe or t.left[p] >= 0):
                ends.append(j)
                ids.append(p)
        fine = [True] * len(ids)
        if t.model.bpe and i:
            a = last[i] if last[i] != t.size else t.symbol.get(word[i - 1], t.size)
            b = [p if p != t.size else t.symbol.get(word[i], t.size) for p in ids]
            fine = t.may_follow(np.full(len(b), a), np.array(b)).tolist()
        for j, p, ok in zip(ends, ids, fine):
            if ok and cost[i] + t.cost[p] < cost[j]:
                cost[j], last[j] = cost[i] + t.cost[p], p
    path, at = [], n
    while at:
        path.append(last[at])
        at -= int(t.length[last[at]])
    return np.array(path[::-1], np.int64)


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, n_fallback, exact)``: exact says whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(Transducer(read_model(model)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        fallback = np.zeros(len(encoder.out), bool)
        fallback[[i for i in encoder.t.byte if i >= 0]] = True
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // TOGETHER
            cuts = np.flatnonzero(np.r_[True, size[1:] != size[:-1]]).tolist() if b.num_rows else []
            for at, end in zip(cuts, [*cuts[1:], b.num_rows]):
                part = b.slice(at, end - at)
                texts = part.column(1).to_pylist()
                ids, edges = encoder.encode_together(texts)
                back = [None if x is None else x.encode() == y for x, y in zip(texts, encoder.decode_together(ids, edges))]
                null = np.array([x is None for x in texts])
                counts = np.diff(np.r_[0, np.cumsum(fallback[ids])][edges])
                yield pa.record_batch(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids), mask=pa.array(null)), pa.array(counts, pa.int64(), mask=null), pa.array(back, pa.bool_())],
                    names=["doc_id", "ids", "n_fallback", "exact"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_fallback long, exact boolean")


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from piece ids; bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(Transducer(read_model(model)))
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            back = encoder.decode_batch(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array([None if x is None else x.decode("utf-8", "replace") for x in back], pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_fallback", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "exact")


def default_model(path: str = "/opt/tokenizers/piece_bpe_32k.model") -> bytes:
    with open(path, "rb") as f:
        return f.read()
