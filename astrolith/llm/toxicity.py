"""Toxicity: a factorization machine over hashed terms.

A text is the set of its distinct lower-cased words, hashed into ``2 ** bits`` buckets. The score is the
logistic of ``b + sum w_i + sum_{i<j} <v_i, v_j>`` over the text's buckets; the pairwise part, computed in
linear time as half of ``|sum v|^2 - sum |v|^2``, learns what linear weights cannot, such as an insult
that counts only beside a group mention, or only without one. Every bucket that occurs in ``min_rows`` learned rows
gets a weight and factors: terms are not screened by their own share of ones, which would drop those that say
something only beside others. Weights and factors are learned together by AdaGrad, for the first part of the steps
freely, then with proximal penalties: L1 on ``w`` and a group penalty on each ``v_i``, which leave buckets without
evidence at zero.

**Scale.** Learning uses at most ``max_train_rows`` labelled rows (a documented bound: the labels of lowest
id hash, then the rows of lowest hash of id and text). The chosen labels are broadcast, so only their texts leave the
scan; the chosen rows' bucket lists are the only thing that reaches the driver. Scoring reads every whole
text once, without a shuffle; the model that tasks get has at most ``2 ** bits`` rows.

Held-out rows (``crc32(doc_id as text) mod 4 = 2``) are never learned from. Labels, lang, source and
doc_id are not inputs of a score. Null and empty texts have no terms and get the score of the bias; null
labels are ignored; labels that contradict each other count as toxic; a null id is scored. Equal rows count once in
learning and get equal scores; different texts under one id are rows of their own, within the bound. Very long texts
are read whole, in blocks. Without both classes among the labels all scores are the share of ones (0 without
labels). An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.llm.decontaminate import WORDS
from astrolith.llm.text import id_and_bytes, text_mark, word_blocks

THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    rank: int = 4
    max_train_rows: int = 20_000
    min_rows: int = 3  # buckets in fewer learned rows carry no evidence
    epochs: int = 12
    min_steps: int = 500  # few rows are gone through more often
    free: float = 0.3  # share of the steps without penalties
    batch: int = 512
    rate: float = 0.2
    start: float = 0.03  # spread of the factors at first
    l1: float = 0.015
    group: float = 0.6
    positive_weight: float = 5.0


class Terms:
    """Distinct buckets of a text; words seen before are looked up."""

    def __init__(self, bits: int):
        self.mask, self.known = (1 << bits) - 1, {}

    def __call__(self, body: bytes | None) -> np.ndarray:
        known, out = self.known, set()
        if len(known) > 1_000_000:
            known.clear()
        for words in word_blocks((body or b"").translate(WORDS)):
            for w in set(words):
                k = known.get(w)
                if k is None:
                    k = known[w] = crc32(w) & self.mask
                out.add(k)
        return np.fromiter(out, np.int32, len(out))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Machine:
    bias: float
    slot: np.ndarray  # bucket -> row of w and v, or -1
    w: np.ndarray
    v: np.ndarray

    def score(self, buckets: np.ndarray) -> float:
        rows = self.slot[buckets]
        rows = np.sort(rows[rows >= 0])
        z = self.bias
        if len(rows):
            v = self.v[rows]
            total = v.sum(axis=0)
            z += float(self.w[rows].sum() + 0.5 * (total @ total - (v * v).sum()))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))))


def learn(buckets: list[np.ndarray], labels: np.ndarray, s: Settings) -> Machine:
    y = labels.astype(np.float64)
    n = len(y)
    slot = np.full(1 << s.bits, -1, np.int32)
    share = float(y.mean()) if n else 0.0
    if not n or share in (0.0, 1.0):
        return Machine(float(np.log((share + 1e-9) / (1 - share + 1e-9))), slot, np.zeros(0), np.zeros((0, s.rank)))
    flat = np.concatenate(buckets)
    used = np.flatnonzero(np.bincount(flat, minlength=1 << s.bits) >= s.min_rows)
    slot[used] = np.arange(len(used))
    m = len(used)
    cols, row_of = slot[flat], np.repeat(np.arange(n), [len(b) for b in buckets])
    cols, row_of = cols[cols >= 0], row_of[cols >= 0]
    lens = np.bincount(row_of, minlength=n)
    ptr = np.r_[0, np.cumsum(lens)]
    rng = np.random.default_rng(7)
    b, w, v = float(np.log(share / (1 - share))), np.zeros(m), rng.normal(0, s.start, (m, s.rank))
    gw, gv, gb = np.full(m, 1e-2), np.full((m, s.rank), 1e-2), 1e-2
    weight = np.where(y > 0, s.positive_weight, 1.0)
    epochs = max(s.epochs, -(-s.min_steps * s.batch // n))
    for epoch in range(epochs):
        order = rng.permutation(n)
        penalty = epoch >= s.free * epochs
        for at in range(0, n, s.batch):
            pick = order[at : at + s.batch]
            k, size = len(pick), lens[pick]
            first = np.cumsum(size) - size
            row = np.repeat(np.arange(k), size)
            c = cols[np.repeat(ptr[pick] - first, size) + np.arange(size.sum())]
            here, inv = np.unique(c, return_inverse=True)
            vc, some = v[c], size > 0
            total = np.zeros((k, s.rank))
            if some.any():
                total[some] = np.add.reduceat(vc, first[some], axis=0)
            z = b + np.bincount(row, w[c], k) + 0.5 * ((total**2).sum(axis=1) - np.bincount(row, (vc**2).sum(axis=1), k))
            g = 20 * weight[pick] * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[pick]) / k
            gb += g.sum() ** 2
            b -= s.rate * g.sum() / np.sqrt(gb)
            dw = np.bincount(inv, g[row], len(here))
            gw[here] += dw**2
            step = s.rate / np.sqrt(gw[here])
            new = w[here] - step * dw
            pull = g[row][:, None] * (total[row] - vc)
            dv = np.stack([np.bincount(inv, pull[:, f], len(here)) for f in range(s.rank)], axis=1)
            gv[here] += dv**2
            steps = s.rate / np.sqrt(gv[here])
            factors = v[here] - steps * dv
            if penalty:
                new = np.sign(new) * np.maximum(np.abs(new) - step * s.l1, 0)
                norm = np.sqrt((factors**2).sum(axis=1))
                factors *= np.maximum(1 - steps.mean(axis=1) * s.group / np.maximum(norm, 1e-12), 0)[:, None]
            w[here], v[here] = new, factors
    live = (w != 0) | (np.abs(v).sum(axis=1) > 0)
    slot[:] = -1
    slot[used[live]] = np.arange(live.sum())
    return Machine(b, slot, w[live], v[live])


def _bucketed(rows: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(bits)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(2), pa.array([np.sort(terms(x.as_py())) for x in b.column(1)], pa.list_(pa.int32()))], names=["mark", "y", "buckets"])

    return rows.mapInArrow(run, "mark long, y int, buckets array<int>")


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(mark, y, buckets)`` of at most ``max_train_rows`` labelled rows that are not held out."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull())
    marks = marks.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(settings.max_train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    rows = texts.join(F.broadcast(chosen), "id").select(text_mark("id", "body").alias("mark"), "body", "y")
    different = rows.groupBy("mark").agg(F.first("body").alias("body"), F.max("y").alias("y"))
    return _bucketed(different, settings.bits).orderBy("mark").limit(settings.max_train_rows)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Learn from the labelled rows that are not held out, at most ``max_train_rows`` of them."""
    got = training_rows(docs, labels, settings, id_col, text_col, label_col).toArrow().to_pydict()
    order = sorted(range(len(got["mark"])), key=got["mark"].__getitem__)
    return learn([np.array(got["buckets"][i], np.int32) for i in order], np.array([got["y"][i] for i in order]), settings)


def score(docs: DataFrame, machine: Machine, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = id_and_bytes(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    bits = settings.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, terms = shared.value, Terms(bits)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([m.score(terms(x.as_py())) for x in b.column(1)], pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return score(docs, fit(docs, labels, settings), settings)
