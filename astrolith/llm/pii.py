"""Personal data by fixed forms, and by bootstrapped contextual extraction.

**Base.** E-mail addresses, IP addresses, payment cards and phone numbers by their forms, leftmost and without overlap in
each kind; matches that fail a check (parts of an address, digits, Luhn sum) are dropped and not tried again.

**Bootstrapping.** Base spans are the seeds. Each seed and each candidate (what else looks like an identifier: digit groups,
words that mix letters and digits, spelled-out addresses) has lexical patterns: the word before and the own shape, the two words
before, the words on both sides, and the own shape between its neighbours' classes. In the bipartite graph of patterns and
instances (identifiers without their separators) a round of joins scores patterns by their instances and then instances by their
patterns::

    score(pattern, kind) = known of the kind / (known of any kind + misfits + weight * unknown + 1)
    score(instance, kind) = the best score of a pattern with enough known instances, for kinds that it has the form for

Instances that reach ``accept`` are known in the next round, with their score as weight, and their spans are added. So a number
without its prefix is found after words that often come before numbers with one. Base spans stay, whatever comes.

**Scale.** Texts are read once, inside their tasks. What is shuffled are identifiers and their patterns, each pair once however
often it occurs; a pattern that most identifiers share is summed before the shuffle. Rows are told apart by numbers of their
own, so that repeated ids don't mix.

Nulls: a null text is empty; null ids are kept. Empty texts have no spans. Texts of any length are scanned whole. Ties between
kinds go to the first of ``KINDS``. Repeated rows give repeated rows; their identifiers count once. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.session import cut

KINDS = ("email", "ip", "card", "phone")
ROUNDS, ACCEPT, LEAST_KNOWN, UNKNOWN_WEIGHT = 3, 0.75, 3, 0.25

# Fixed forms.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can begin at the start of a run of digits only, which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates.
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[A-Za-z0-9._%+=@/()-]+")
NEXT_GROUP = re.compile(r" [(+]?[0-9][0-9().-]*(?![A-Za-z0-9])")
SPELLED = re.compile(r"([A-Za-z0-9._%+-]+) ?(?:@|\(at\)|\[at\]| at ) ?([A-Za-z0-9-]+(?:(?: ?\. ?| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]+)+)", re.IGNORECASE)
SPELLED_MARK = re.compile(r"@|[(\[]at[)\]]| dot ", re.IGNORECASE)
LONGEST, LEAST_DIGITS, REACH = 80, 5, 64


def luhn(digits: str) -> bool:
    return sum((2 * d - 9 * (d > 4)) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start, in code points."""
    found = [(0, s, e) for s, e in _emails(text)]
    if DIGIT.search(text):
        found += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in "._%+=@/(-)":
        end -= 1
    while start < end and text[start] in "._%=@/)-":
        start += 1
    return start, end


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def candidate_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that look like identifiers and don't touch the ``taken`` ones."""
    walls = _merged(taken)
    found: list[tuple[int, int]] = []
    k = 0
    for mark in SPELLED_MARK.finditer(text):
        at = mark.start()
        while k < len(walls) and walls[k][1] <= at:
            k += 1
        if k < len(walls) and walls[k][0] <= at or found and at < found[-1][1]:
            continue
        low = max(at - REACH, 0, max((e for _, e in [*walls[max(0, k - 1) : k], *found[-1:]]), default=0))
        high = min(len(text), mark.end() + REACH, walls[k][0] if k < len(walls) else len(text))
        found += [m.span() for m in SPELLED.finditer(text, low, high) if m.start() <= at < m.end()]
    walls = _merged([*walls, *found])
    at, k = 0, 0
    while m := DIGIT.search(text, at):
        at = m.start()
        while k < len(walls) and walls[k][1] <= at:
            k += 1
        if k < len(walls) and walls[k][0] <= at:
            at = walls[k][1]
            continue
        low, high = walls[k - 1][1] if k else 0, walls[k][0] if k < len(walls) else len(text)
        if found and found[-1][1] <= at:
            low = max(low, found[-1][1])
        start = at
        while start > low and at - start < LONGEST and TOKEN.match(text, start - 1):
            start -= 1
        end = TOKEN.match(text, start, high).end()
        groups = [_trimmed(text, start, end)]
        if not any(c.isalpha() for c in text[start:end]):
            while n := NEXT_GROUP.match(text, end, high):
                end = n.end()
                groups.append(_trimmed(text, n.start() + 1, end))
        at = max(end, at + 1)
        whole = (groups[0][0], groups[-1][1])
        if len(groups) > 1 and sum(c.isdigit() for c in text[slice(*whole)]) <= 19:
            groups = [whole]
        found += [g for g in groups if g[1] - g[0] <= LONGEST and sum(c.isdigit() for c in text[slice(*g)]) >= LEAST_DIGITS]
    return sorted(found)


def fits(value: str) -> list[int]:
    """The kinds whose form a candidate may have."""
    digits, letters = sum(c.isdigit() for c in value), any(c.isalpha() for c in value)
    if SPELLED.fullmatch(value):
        return [0]
    if letters:
        return []
    out = [1] if len(parts := re.split(r"[^0-9]+", value)) == 4 and all(p and len(p) <= 3 for p in parts) else []
    return out + ([2] if 12 <= digits <= 19 else []) + ([3] if 7 <= digits <= 15 else [])


def instance_of(value: str) -> str:
    """A value without what separates its parts."""
    v = re.sub(r"[(\[]at[)\]]| at ", "@", re.sub(r"[(\[]dot[)\]]| dot ", ".", value.lower()))
    return re.sub(r"[\x20()-]+", "", v)


def _word(token: str) -> str:
    token = token.lower()[:REACH]
    return "<mail>" if "@" in token else re.sub(r"[0-9]+", "0", token)


def patterns_of(text: str, start: int, end: int) -> list[str]:
    before = text[max(0, start - REACH) : start]
    after = text[end : end + REACH]
    words = [_word(w) for w in before.split()[-2:]]
    one, two = words[-1] if words else "^", words[-2] if len(words) > 1 else "^"
    follows = _word(after.split()[0]) if after.split() else "$"
    shape = re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}_", re.sub(r"[^\W\d_]+", "a", text[start:end]))[:REACH]
    edge = lambda c: "." if not c else " " if c.isspace() else "a" if c.isalnum() else c
    return [f"{one} {{{shape}}}", f"{two} {one} {{}}", f"{one} {{}} {follows}", f"{edge(before[-1:])}{{{shape}}}{edge(after[:1])}"]


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_MARK = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("fits", pa.list_(pa.int32())), ("patterns", pa.list_(pa.string()))])
_ROWS = "base array<struct<kind:int,start:long,end:long>>, marks array<struct<kind:int,start:long,end:long,instance:string,fits:array<int>,patterns:array<string>>>"


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, marks, row)``: base spans, and all seeds and candidates (kind null) with their patterns. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for body in batch.column(1):
                text = body.as_py() or ""
                spans = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                own = [(k, s, e, [k]) for k, s, e in spans]
                own += [(None, s, e, fits(text[s:e])) for s, e in candidate_spans(text, [x[1:] for x in spans])]
                found.append([{"kind": k, "start": s, "end": e, "instance": instance_of(text[s:e])[:REACH], "fits": f, "patterns": patterns_of(text, s, e)} for k, s, e, f in own])
            yield pa.record_batch([batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_MARK))], names=["doc_id", "base", "marks"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {_ROWS}")
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def _by_kind(make) -> list[Column]:
    return [make(k).alias(f"b{k}") for k in range(len(KINDS))]


def bootstrap(marked: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, least_known: int = LEAST_KNOWN, unknown_weight: float = UNKNOWN_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """``(instance, kind, score)`` of the discovered identifiers, and ``(pattern, known, b0 .. b3)``, the last round's pattern scores."""
    seen = marked.select(F.explode("marks").alias("m")).select("m.*")
    # An instance is what its seeds say; several kinds count for each.
    edge = [F.max((F.col("kind") == k).cast("int")).alias(f"s{k}") for k in range(len(KINDS))]
    own = seen.groupBy("instance").agg(*(F.coalesce(e, F.lit(0)).alias(f"s{k}") for k, e in enumerate(edge)), F.array_distinct(F.flatten(F.collect_set("fits"))).alias("fits"))
    known = F.greatest(*(F.col(f"s{k}") for k in range(len(KINDS)))) > 0
    # Rows that can be no kind are misfits: they weigh against patterns as seeds of another kind do.
    own = cut(own.withColumn("state", F.when(known, 1).when(F.size("fits") == 0, -1).otherwise(0)))
    edges = cut(seen.select("instance", F.explode("patterns").alias("pattern")).distinct())
    beliefs = own.select("instance", "state", "fits", *_by_kind(lambda k: F.col(f"s{k}").cast("double")))
    scored = None
    for _ in range(rounds):
        met = edges.join(beliefs, "instance")
        belief = F.greatest(*(F.col(f"b{k}") for k in range(len(KINDS))))
        sums = met.groupBy("pattern").agg(
            *(F.sum(f"b{k}").alias(f"p{k}") for k in range(len(KINDS))), F.count_if(belief > 0).alias("known"), F.sum(belief).alias("all"), F.count_if(F.col("state") == -1).alias("misfits"), F.count_if((F.col("state") == 0) & (belief == 0)).alias("unknown")
        )
        below = F.col("all") + F.col("misfits") + F.lit(unknown_weight) * F.col("unknown") + 1
        scored = cut(sums.where(F.col("known") >= least_known).select("pattern", "known", *_by_kind(lambda k: F.col(f"p{k}") / below)))
        best = edges.join(scored.drop("known"), "pattern").groupBy("instance").agg(*(F.max(f"b{k}").alias(f"n{k}") for k in range(len(KINDS))))
        score = lambda k: F.when(F.col("state") == 1, F.col(f"b{k}")).when(F.array_contains("fits", k) & (F.col(f"n{k}") >= accept), F.col(f"n{k}")).otherwise(0.0)
        beliefs = cut(own.select("instance", "state", "fits", *_by_kind(lambda k: F.col(f"s{k}").cast("double"))).join(best, "instance", "left").select("instance", "state", "fits", *_by_kind(score)))
    top = F.greatest(*(F.col(f"b{k}") for k in range(len(KINDS))))
    first = F.coalesce(*(F.when(F.col(f"b{k}") == top, F.lit(k)) for k in range(len(KINDS))))
    return beliefs.where((F.col("state") == 0) & (top > 0)).select("instance", first.alias("kind"), top.alias("score")), scored


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``(doc_id, base, added)``: arrays of structs (kind number, start, end) for each row."""
    marked = marks(docs, id_col, text_col)
    found, _ = bootstrap(marked, **settings)
    open_ = marked.select("row", F.explode("marks").alias("m")).where("m.kind is null").select("row", "m.instance", "m.start", "m.end")
    added = open_.join(found.select("instance", "kind"), "instance").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return marked.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
