"""Spelling variant grouping by PartEnum signatures.

**Words.** Maximal runs of letters (``A-Za-z`` and U+00C0 to U+00FF), A-Z lower-cased; a word has at least ``min_length``
code points and ``min_count`` occurrences. Two words are near if one inserted, deleted or replaced code point makes one
the other. A word's form is its most frequent near word (ties: smallest in code-point order) if that is ``ratio`` times
as frequent; its root is the end of the chain of forms.

**Signatures.** A word is the multiset of its letters, a binary vector over (letter, occurrence). A replacement is a
Hamming distance of two between vectors of one size, an insertion or deletion a distance of one between sizes that are
neighbours. Letters are dealt to parts; a distance of k spoils at most k parts, so two near words agree in all letters of
some choice of ``parts - k`` parts. Each choice is one exact signature: (size, choice, its letters in order). Words with a
signature in common meet in an equi-join and are verified by their edit distance, which counts code points, inside the join,
so that only near pairs become rows.

**Scale.** Texts are read once and counted inside their tasks, and only (word, count) is shuffled. The rest works on
different words. Signatures shared by more than ``split_above`` words are split exactly: an edit leaves the first or
the last half of a word as it is, so such words meet by signature and half, first or last. A word has at most some
thousand near words by its length and alphabet, whatever the corpus, so no group of near words grows with it.

Nulls: a null text has no words; a null id counts as an empty one (for ``drop_every``). Empty texts and tables give no
words. Texts of any length count whole. Repeated rows count again. Ties are by code-point order. Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.session import cut

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Latin-1 table: letters to themselves (A-Z lower-cased), all else to a space. A character beyond Latin-1 becomes a question mark first.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
#: Letters are dealt to parts in this order, so that parts get equal shares of usual text; others go by code point.
BY_USE = "etaoinsrhldcumfpgwybvkxjqz"
#: Different words that a task holds before it hands on their counts.
HELD = 400_000
#: (parts, parts that a signature covers) at a distance of two and of one.
SAME_SIZE, NEXT_SIZE = (5, 3), (4, 3)
SPLIT_ABOVE = 2_000


def runs_of(text: str | None, least: int = 1) -> list[bytes]:
    """The lower-cased runs of letters of at least ``least`` code points, as Latin-1."""
    return [w for w in (text or "").encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= least]


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int | None = None) -> DataFrame:
    """``(word, n)`` of all documents.

    ``drop_every`` damages runs for tests of recall: where it divides h = crc32(``<id>:<run>``), the run loses its code
    point ``h mod length``.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w.decode("latin-1"), n) for w, n in held.items() if n]
            held.clear()
            return pa.record_batch([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for at, text in enumerate(batch.column(1)):
                runs = runs_of(text.as_py(), min_length)
                held.update(runs)
                if drop_every:
                    key = batch.column(0)[at].as_py()
                    start = crc32(b"%s:" % ("" if key is None else str(key)).encode())
                    for run in {w for w in runs if crc32(_utf8(w), start) % drop_every == 0}:
                        at_ = crc32(_utf8(run), start) % len(run)
                        n = runs.count(run)
                        held[run] -= n
                        if len(run) > min_length:
                            held[run[:at_] + run[at_ + 1 :]] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    parts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _letters_of(parts: int, chosen: tuple[int, ...]) -> str:
    """The letters that a choice of parts leaves out."""
    others = [chr(c) for c in range(0xC0, 0x100)]
    return "".join(c for i, c in enumerate(BY_USE) if i % parts not in chosen) + "".join(c for c in others if ord(c) % parts not in chosen)


def _signatures(words: DataFrame, shape: tuple[int, int], size: Column, kind: str) -> DataFrame:
    """``(sig, word, n, size)``, a row for each choice of parts."""
    parts, covered = shape
    ordered = F.array_join(F.array_sort(F.split("word", "")), "")
    sigs = [F.xxhash64(F.lit(kind), F.lit(k), "size", F.translate("ordered", _letters_of(parts, c), "")) for k, c in enumerate(combinations(range(parts), covered))]
    return words.select("word", "n", size.alias("size"), ordered.alias("ordered")).select(F.explode(F.array(*sigs)).alias("sig"), "word", "n", "size")


def _split(sigs: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds ``half``: rows of hot signatures come twice, with the first and the last half of their word."""
    half = F.floor(F.col("size") / 2).cast("int")
    first, last = F.concat(F.lit("<"), F.left("word", half)), F.concat(F.lit(">"), F.right("word", F.col("size") - half))
    return sigs.join(hot.withColumn("_hot", F.lit(True)), "sig", "left").select("sig", F.explode(F.when(F.col("_hot"), F.array(first, last)).otherwise(F.array(F.lit("")))).alias("half"), "word", "n")


def near_pairs(words: DataFrame, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """``(word, near, n, near_n)``: all pairs of different words with one edit between them, in both orders.

    ``words`` has ``word`` (different ones) and ``n``. Words of fewer than two code points are near to few others and
    are compared like any other.
    """
    length = F.length("word")
    one_edit = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    found = None
    # A shorter word meets the longer ones under its own size, a longer word the shorter ones under its size less one.
    for left, right, order in (
        (_signatures(words, SAME_SIZE, length, "same"), None, F.col("a.word") < F.col("b.word")),
        (_signatures(words, NEXT_SIZE, length, "next"), _signatures(words, NEXT_SIZE, length - 1, "next"), F.lit(True)),
    ):
        counts = (left if right is None else left.unionByName(right)).groupBy("sig").agg(F.count("*").alias("_n"))
        hot = cut(counts.where(F.col("_n") > split_above).select("sig"))
        a = _split(left, hot).alias("a")
        b = _split(left if right is None else right, hot).alias("b")
        met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.half") == F.col("b.half")) & order & one_edit)
        met = met.select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("an"), F.col("b.n").alias("bn"))
        found = met if found is None else found.unionByName(met)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("an").alias("n"), F.col("bn").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("bn").alias("n"), F.col("an").alias("near_n"))))
    return found.distinct().select(both.alias("p")).select("p.*")


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(word, root)`` of ``(word, form)`` rows whose forms lead nowhere back: each round doubles the way that is followed."""
    at = cut(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("ended")))
    for _ in range(max_rounds):
        nxt = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = cut(at.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNull().alias("ended")))
        if at.where(~F.col("ended")).isEmpty():
            return at.select("word", "root")
    raise RuntimeError(f"forms did not end in {max_rounds} doublings")


def group_variants(words: DataFrame, ratio: int = RATIO, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for each of the counted ``words``."""
    words = cut(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("near")))
    near = near_pairs(words, split_above).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.k") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.k")).alias("form_n")
    )
    rows = cut(rows)
    # A form is `ratio` times as frequent as its word, so chains are short and have no circles.
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


_BYTES = "[('0x' || x)::BIGINT for x in regexp_extract_all(hex(encode({})), '..')]"
#: Near words by deletions and by patterns with one open place.
ORACLE = f"""
WITH RECURSIVE
steps(i, c, k) AS (SELECT range, range::BIGINT, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY 1, 2),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES.format("coalesce(doc_id::VARCHAR, '') || ':' || run")}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS h FROM own, crc),
said AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM said WHERE length(word) >= {MIN_LENGTH} GROUP BY 1 HAVING sum(n) >= {MIN_COUNT}),
cuts AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
less AS (SELECT word, n, i, substring(word, 1, i::INT) AS l, substring(word, i::INT + 2) AS r FROM cuts),
one AS (
  SELECT less.word, w.word AS near, less.n, w.n AS near_n FROM less JOIN w ON w.word = less.l || less.r
  UNION SELECT w.word, less.word, w.n, less.n FROM less JOIN w ON w.word = less.l || less.r
  UNION SELECT a.word, b.word, a.n, b.n FROM less a JOIN less b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM one),
formed AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {RATIO} * w.n THEN r.near END AS form, CASE WHEN r.near_n >= {RATIO} * w.n THEN r.near_n END AS form_n FROM w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
way(word, here, d) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT way.word, f.form, d + 1 FROM way JOIN formed f ON f.word = way.here WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, arg_max(way.here, way.d) AS root FROM formed f JOIN way USING (word) GROUP BY ALL
"""
