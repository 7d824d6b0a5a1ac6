"""Quality: overlapping heuristic labellers, their accuracies by EM, and a hashed linear scorer.

**Labellers** vote 0 (bad), 1 (good), 2 (between) or 3 (too short to tell) on each whole text: share of symbols, of capitals, of
tokens without a letter or digit, of tokens equal to the one before, of the most frequent token, of
tokens that end in odd marks, of distinct tokens, of function words.

**Label model.** No labels are used. Vote patterns of *all* documents are counted (at most 4^8 patterns,
whatever the input's size), and expectation-maximisation on the counts estimates each labeller's
vote probabilities in either class and the prior; a 3 says nothing. Posteriors follow per pattern.

**Scorer.** Posteriors are soft labels of a logistic model over hashed token shapes (a word's
characters as classes, runs shortened, and pairs of neighbouring shapes, and repeats), learned on at
most ``max_train_rows`` different rows (a documented bound: those of lowest hash of id and text; the choice is
broadcast, so only its texts leave the scan). It then scores every whole text. A document is kept at a score of
``threshold`` or more.

Nulls: null and empty texts have no tokens, all votes are 3, and they are
rejected (score 0); a null id keeps its row and is an id like others in the choice. Equal rows count once in learning
(each counts in the label model) and equal texts get equal scores; different texts under one id are rows of their own,
within the bound. Very long texts are read whole, in blocks. With no documents the result is empty. Other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.llm.text import LOWER, id_and_bytes, text_mark, word_blocks
from astrolith.session import cut

#: Votes are 0 (bad), 1 (good), 2 (between) and 3 (the text is too short to tell).
ABSTAIN, SHORT = 2, 3
#: Tokens added to a text's length, so that a few tokens alone don't decide.
SMOOTH = 8
#: Common function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one "
    "der die und das von zu den mit ist im des sich nicht ein eine auf dem für als auch "
    "le la les de et à un une est que dans en pour du qui sur pas par au avec "
    "el los y del se las por con para su al lo como más o pero".encode().split()
)


@dataclass(frozen=True)
class Settings:
    bits: int = 16
    max_train_rows: int = 20_000
    rounds: int = 50
    steps: int = 300
    rate: float = 0.5
    l2: float = 1e-4
    threshold: float = 0.5


_RUNS = [(re.compile(rb"([0Aa])\1+"), rb"\1"), (re.compile(rb"([^0Aa])\1+"), rb"\1\1")]


#: Byte classes: letters a or A, digits 0, all else itself.
_CLASSES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_LONGEST = max(map(len, FUNCTION_WORDS)) + 6


def shape(token: bytes) -> bytes:
    """Byte classes with their runs shortened."""
    for pattern, to in _RUNS:
        token = pattern.sub(to, token)
    return token[:24]


class _Facts(dict):
    """Row numbers of tokens in a table of facts; a new token is looked at once."""

    def __init__(self):
        super().__init__()
        self.classes: dict[bytes, tuple[tuple, tuple]] = {}
        self.rows: list[tuple] = []
        self.table, self.done = np.zeros((1024, 8), np.int64), 0

    def __missing__(self, t: bytes) -> int:
        classes = t.translate(_CLASSES)  # all facts but one follow from these, and few differ
        facts = self.classes.get(classes) or self._facts(classes)
        k = self[t] = len(self.rows)
        self.rows.append(facts[len(t) <= _LONGEST and t.strip(b".,;:!?\"'()").translate(LOWER) in FUNCTION_WORDS])
        return k

    def _facts(self, classes: bytes) -> tuple[tuple, tuple]:
        capitals, digits = classes.count(b"A"), classes.count(b"0")
        letters = capitals + classes.count(b"a")
        rest = len(classes) - letters - digits
        odd = rest - 1 if rest and len(classes) > 1 else rest  # one mark beside a word is nothing odd
        row = (crc32(shape(classes)), len(classes), letters, capitals, odd, not letters and not digits, odd >= 1 and letters > 0)
        if len(self.classes) < 100_000:
            self.classes[classes] = ((*row, False), (*row, True))
        return (*row, False), (*row, True)

    def of(self, k: np.ndarray) -> np.ndarray:
        """Facts of rows; new rows are written to the table, whose room doubles."""
        n = len(self.rows)
        if self.done < n:
            if n > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(n, 2 * len(self.table)) - len(self.table), 8), np.int64)])
            self.table[self.done : n] = self.rows[self.done :]
            self.done = n
        return self.table[k]


class Reader:
    """Counts over a text's tokens."""

    def __init__(self, bits: int):
        self.mask, self.facts = (1 << bits) - 1, _Facts()

    def read(self, body: bytes | None) -> tuple[np.ndarray, int, list[int]]:
        """(buckets of shapes and of neighbouring shapes, number of tokens, votes) of a text."""
        if len(self.facts) > 500_000:
            self.facts = _Facts()
        facts = self.facts
        blocks = [np.fromiter(map(facts.__getitem__, block), np.int64, len(block)) for block in word_blocks(body or b"")]
        if not blocks:
            return np.zeros(0, np.int64), 0, [SHORT] * 8
        k = np.concatenate(blocks)
        n = len(k)
        f = facts.of(k)
        s = f[:, 0] & self.mask
        same = k[1:] == k[:-1]
        s[1:][same] = 1  # a repeat is a shape of its own
        pairs = (s[:-1] * 31 + s[1:] * 17 + 7) & self.mask
        chars, letters, upper, odd, bare, marked, func = f[:, 1:].sum(axis=0).tolist()
        order = np.sort(k)
        starts = np.flatnonzero(np.r_[True, order[1:] != order[:-1]])
        top, distinct = int(np.diff(np.r_[starts, n]).max()), len(starts)
        vote = lambda x, good, bad: 1 if x <= good else 0 if x >= bad else ABSTAIN
        votes = [
            vote(odd / chars, 0.01, 0.08),
            vote(upper / letters, 0.15, 0.5) if letters >= 40 else SHORT,
            vote(bare / n, 0.02, 0.15),
            vote(int(same.sum()) / n, 0.02, 0.15),
            vote(top / n, 0.12, 0.3) if n >= 30 else SHORT,
            vote(marked / n, 0.05, 0.25),
            vote(-distinct / n, -0.25, -0.08) if n >= 100 else SHORT,
            SHORT if n < 30 else 1 if func / n >= 0.12 else ABSTAIN if func / n >= 0.02 else 0,
        ]
        return np.concatenate([s, pairs]), n, votes

    def counted(self, body: bytes | None) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(distinct buckets, their smoothed shares, votes) of a text."""
        b, n, votes = self.read(body)
        bucket, count = np.unique(b, return_counts=True)
        return bucket, count / (n + SMOOTH), votes


def label_model(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int) -> tuple[float, np.ndarray, np.ndarray]:
    """EM: (prior of good, per class and labeller the vote probabilities, posterior of each pattern)."""
    votes, weight = np.array(patterns).reshape(len(patterns), -1), counts.astype(float)
    k = votes.shape[1]
    good = ((votes == 1).sum(1) + 1.0) / ((votes < ABSTAIN).sum(1) + 2.0)
    # Start from a vote in which any two bad votes outweigh the good ones: most labellers see one kind of fault.
    good = np.where((votes == 0).sum(1) >= 1, np.minimum(good, 0.4), np.maximum(good, 0.6))
    prior, table = 0.5, np.zeros((2, k, 4))
    for _ in range(rounds):
        for c, post in ((0, 1 - good), (1, good)):
            for v in range(3):
                table[c, :, v] = ((votes == v) * (weight * post)[:, None]).sum(0) + 0.5
        table[:, :, :3] /= table[:, :, :3].sum(2, keepdims=True)
        table[:, :, SHORT] = 1.0  # says nothing of the class
        prior = float(np.clip((weight * good).sum() / max(weight.sum(), 1e-9), 0.01, 0.99))
        at = np.arange(k)
        up = np.log(prior) + np.log(table[1, at, votes]).sum(1)
        down = np.log(1 - prior) + np.log(table[0, at, votes]).sum(1)
        good = 1 / (1 + np.exp(np.clip(down - up, -35, 35)))
    return prior, table, good


@dataclass
class Scorer:
    bias: float
    w: np.ndarray
    bits: int

    def score(self, buckets: np.ndarray, n: int) -> float:
        if not n:
            return 0.0
        z = self.bias + float(self.w[buckets].sum()) / (n + SMOOTH)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def learn(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, s: Settings) -> Scorer:
    """Logistic regression on soft labels, full batches, AdaGrad."""
    n, size = len(rows), 1 << s.bits
    w, bias = np.zeros(size), 0.0
    if n:
        cols, vals = np.concatenate([b for b, _ in rows]).astype(np.int64), np.concatenate([v for _, v in rows])
        row = np.repeat(np.arange(n), [len(b) for b, _ in rows])
        used, cols = np.unique(cols, return_inverse=True)
        u, g2, gb2 = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
        for _ in range(s.steps):
            z = bias + np.bincount(row, u[cols] * vals, n)
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - target) / n
            d = np.bincount(cols, g[row] * vals, len(used)) + s.l2 * u / n
            g2, gb2 = g2 + d**2, gb2 + g.sum() ** 2
            u -= s.rate * d / np.sqrt(g2)
            bias -= s.rate * g.sum() / np.sqrt(gb2)
        w[used] = u
    return Scorer(bias, w, s.bits)


def _read(rows: DataFrame, bits: int, features: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(bits)
        for b in batches:
            got = [(reader.counted if features else reader.read)(x.as_py()) for x in b.column(1)]
            out = [b.column(0), pa.array(["".join(map(str, v)) for _, _, v in got])]
            if features:
                out += [pa.array([x for x, _, _ in got], pa.list_(pa.int64())), pa.array([x for _, x, _ in got], pa.list_(pa.float64()))]
            yield pa.record_batch(out, names=["doc_id", "votes", "buckets", "shares"][: len(out)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, votes string" + (", buckets array<long>, shares array<double>" if features else ""))


def _votes_and_marks(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """``(mark, votes)`` of each row, written once: counts and the choice of rows come from these few bytes a row."""
    marked = id_and_bytes(docs, id_col, text_col)
    return cut(_read(marked.select(text_mark("doc_id", "body").alias("doc_id"), "body"), s.bits, False).withColumnRenamed("doc_id", "mark"))


def chosen_marks(marks: DataFrame, n: int, most: int) -> DataFrame:
    """The ``most`` least of different marks (hashes) of ``n`` rows. Only marks below a bound are sorted; it grows until they are enough."""
    share = min(1.0, 4 * most / max(n, 1))
    while share < 1:
        low = marks.where(F.col("mark") < F.lit(int(share * 2**64) - 2**63)).select("mark").distinct()
        if low.count() >= most:
            return low.orderBy("mark").limit(most)
        share = min(1.0, 8 * share)
    return marks.select("mark").distinct().orderBy("mark").limit(most)


def training_rows(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", marks: DataFrame | None = None) -> DataFrame:
    """At most ``max_train_rows`` different rows, with their mark as doc_id."""
    marked = id_and_bytes(docs, id_col, text_col).withColumn("mark", text_mark("doc_id", "body"))
    marks = marked.select("mark") if marks is None else marks
    chosen = chosen_marks(marks, marks.count(), s.max_train_rows)
    picked = marked.join(F.broadcast(chosen), "mark", "left_semi").groupBy("mark").agg(F.first("body").alias("body"))
    return picked.select(F.col("mark").alias("doc_id"), "body")


def fit(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Reads ``docs`` twice: for all rows' votes, and for the chosen rows' texts."""
    seen = _votes_and_marks(docs, s, id_col, text_col)
    counted = sorted((r["votes"], r["count"]) for r in seen.groupBy("votes").count().collect())  # 4^8 rows at most
    if not counted:
        return learn([], np.zeros(0), s)
    patterns = [tuple(map(int, v)) for v, _ in counted]
    _, _, good = label_model(patterns, np.array([c for _, c in counted]), s.rounds)
    posterior = {v: p for (v, _), p in zip(counted, good)}
    got = _read(training_rows(docs, s, id_col, text_col, seen.select("mark")), s.bits, True).toArrow().to_pydict()
    order = sorted(range(len(got["doc_id"])), key=got["doc_id"].__getitem__)
    train = [(np.array(got["buckets"][i], np.int64), np.array(got["shares"][i])) for i in order]
    return learn(train, np.array([posterior[got["votes"][i]] for i in order]), s)


def score(docs: DataFrame, scorer: Scorer, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, votes, score, keep)``: votes has a character for each labeller (0 to 3)."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = id_and_bytes(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        reader = Reader(scorer.bits)
        for b in batches:
            got = [reader.read(x.as_py()) for x in b.column(1)]
            scores = [scorer.score(x, n) for x, n, _ in got]
            yield pa.record_batch([b.column(0), pa.array(["".join(map(str, v)) for _, _, v in got]), pa.array(scores, pa.float64())], names=["doc_id", "votes", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, votes string, score double")
    return scored.withColumn("keep", F.col("score") >= s.threshold)


def classify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return score(docs, fit(docs, s), s)


def keep(docs: DataFrame, s: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with their columns; the text is read beside them."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, s, text_col=text_col))
    threshold, names = s.threshold, docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        reader = Reader(scorer.bits)
        for b in batches:
            kept = []
            for x in b.column(at):
                t = x.as_py()
                buckets, n, _ = reader.read(t.encode() if t is not None else None)
                kept.append(scorer.score(buckets, n) >= threshold)
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
