"""Partitions of points: ranges of curve keys, octants, k-d cells, longest-side cells, and their placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolith.functions import keys
from astrolith.functions.geometry import AXES
from astrolith.session import cut, shuffled


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) in the order of the columns, without one task that sees all rows.

    Rows are dealt by range and written once, so that each range has a fixed number; counts of ranges
    are summed up (one row per range), and rows are numbered inside their range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return dealt.withColumn("_k", F.row_number().over(inside)).join(F.broadcast(starts), "_range").withColumn("rank", F.col("_start") + F.col("_k") - 1).drop("_range", "_start", "_k")


def running_sum(df: DataFrame, weight: str, *order: str) -> DataFrame:
    """Adds ``before``: the sum of ``weight`` over all rows earlier in the order (which must tell rows apart), range by range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = dealt.groupBy("_range").agg(F.sum(weight).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_own", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return summed.join(F.broadcast(starts), "_range").withColumn("before", F.col("_start") + F.col("_own")).drop("_range", "_start", "_own")


def tile(rank: Column, n: int, pieces: int) -> Column:
    """The piece of a rank when ``n`` rows are split evenly and the first ``n mod pieces`` pieces take one row more."""
    q, r = divmod(n, pieces)
    big = F.lit(r * (q + 1))
    rest = F.floor((rank - big) / F.lit(max(q, 1))) + r
    return F.when(rank < big, F.floor(rank / F.lit(q + 1))).otherwise(rest).cast("int")


def range_of_reader(n: int, reader: int, readers: int) -> tuple[int, int]:
    """(start, count) of one of ``readers`` even ranges of ``n`` rows."""
    q, r = divmod(n, readers)
    return reader * q + min(reader, r), q + (reader < r)


def row_slice(points: DataFrame, start: int, count: int) -> DataFrame:
    return points.where((F.col("id") >= start) & (F.col("id") < start + count))


#: Bits of (key, id) that a round of counting refines.
DIGIT = 9


def cuts_by_counting(keyed: DataFrame, ranks: list[int]) -> list[tuple[int, int]]:
    """The (key, id) of the rows at the given ascending ranks of the order by key, then id; ``id`` is unique among equal keys.

    Rounds of histograms over the leading bits: each round counts, in one scan without a shuffle of rows, the next bits of the
    rows that agree with a cut so far, and the driver gets at most ``2^DIGIT`` counts a cut. Ids are looked at only for
    cuts that fall inside equal keys.
    """
    digits = [(F.col("key"), shift) for shift in range(3 * keys.BITS - DIGIT, -1, -DIGIT)]
    flipped = F.col("id").cast("long").bitwiseXOR(F.lit(-(2**63)))  # unsigned order of bits is the order of ids
    digits += [(flipped, shift) for shift in range(63, -1, -DIGIT)]
    places = [((), r) for r in ranks]  # digits so far, and rows to pass among those that share them
    live = keyed.select("key", "id")
    for at, (column, shift) in enumerate(digits):
        width = 1 if shift == 63 else DIGIT
        digit = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        live = live.withColumn(f"_d{at}", digit)
        names = [f"_d{k}" for k in range(at + 1)]
        open_ = sorted({p for p, _ in places})
        rows = live
        if at:
            sent = keyed.sparkSession.createDataFrame([tuple(p) for p in open_], ", ".join(f"{n} int" for n in names[:-1]))
            rows = live.join(F.broadcast(sent), names[:-1], "left_semi")  # a row for each cut at most
        counts: dict[tuple, list] = {}
        for r in rows.groupBy(*names).count().collect():
            counts.setdefault(tuple(r[:-2]), []).append((r[-2], r[-1]))
        nxt = []
        for prefix, left in places:
            for d, n in sorted(counts[prefix]):
                if left < n:
                    break
                left -= n
            nxt.append(((*prefix, d), left, n))
        places = [(p, left) for p, left, _ in nxt]
        if column is not flipped and shift == 0 and all(n == 1 for *_, n in nxt):
            break  # no cut inside equal keys
    k = sum(c is not flipped for c, _ in digits)
    join = lambda ds, widths: sum(d << w for d, w in zip(ds, widths))
    out = []
    for p, _ in places:
        key = join(p[:k], [w for _, w in digits[:k]])
        out.append((key, join(p[k:], [w for _, w in digits[k:]]) - 2**63 if len(p) > k else -(2**63)))
    return out


def by_key_ranges(keyed: DataFrame, pieces: int) -> DataFrame:
    """Adds ``piece``: equal counts along the curve, ties by id. Cuts come from counts, so no rows are sorted or moved."""
    n = keyed.count()
    starts = [start for start, _ in (range_of_reader(n, k, pieces) for k in range(1, pieces)) if start < n]
    if not starts:
        return keyed.withColumn("piece", F.lit(0))
    cuts = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(i).alias("id")) for k, i in cuts_by_counting(keyed, starts)))
    own = F.struct(F.col("key").alias("key"), F.col("id").cast("long").alias("id"))
    return keyed.withColumn("piece", F.size(F.filter(cuts, lambda c: c <= own)))


def level_counts(keyed: DataFrame, depth: int, bits: int = 3, top: int = 0) -> DataFrame:
    """``(depth, node, n)`` for the levels from ``top`` to ``depth``: points are counted once, at the deepest level, and
    a cell's count goes to each cell above it, in one shuffle."""
    deep = keyed.groupBy(keys.prefix(F.col("key"), depth, bits).alias("_node")).agg(F.count("*").alias("_n"))
    above = deep.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(depth))))
    node = F.call_function("shiftright", F.col("_node"), (F.lit(bits) * (F.lit(depth) - F.col("depth"))).cast("int")).alias("node")
    return above.groupBy("depth", node).agg(F.sum("_n").alias("n"))


def leaves(keyed: DataFrame, most: int, max_depth: int | None = None, bits: int = 3, step: int = 5) -> DataFrame:
    """``(depth, node, n)`` of the cells that are not split: at most ``most`` points, or the deepest level; their parents hold more.

    ``step`` levels are counted at a time; points go on only if their cell at the last of them is still too large. Without
    ``max_depth`` the key's own depth is the only bound, so only equal keys make larger cells.
    """
    deepest = 3 * keys.BITS // bits if max_depth is None else max_depth
    found, live, top = None, keyed, 0
    while True:
        low = min(top + step, deepest)
        counts = cut(level_counts(live, low, bits, top))
        small = (F.col("n") <= most) | (F.col("depth") == deepest)
        split = counts.where(~small).select((F.col("depth") + 1).alias("depth"), F.col("node").alias("up"))
        ends = counts.where((F.col("depth") > top) & small).withColumn("up", keys.parent(F.col("node"), bits)).join(split, ["depth", "up"], "left_semi").select("depth", "node", "n")
        if top == 0:
            ends = counts.where((F.col("depth") == 0) & small).select("depth", "node", "n").unionByName(ends)
        found = ends if found is None else found.unionByName(ends)
        large = counts.where((F.col("depth") == low) & ~small).select(F.col("node").alias("_large"))
        if low == deepest or large.isEmpty():
            return found
        live, top = live.join(shuffled(large), keys.prefix(F.col("key"), low, bits) == F.col("_large"), "left_semi"), low


def octants(keyed: DataFrame, min_pieces: int, max_depth: int | None = None, bits: int = 3) -> DataFrame:
    """Cells of at most ``floor(N / min_pieces)`` points; ``bits=1`` halves instead of octants."""
    return leaves(keyed, keyed.count() // min_pieces, max_depth, bits)


def assign_cells(keyed: DataFrame, cells: DataFrame, max_depth: int = keys.BITS, bits: int = 3) -> DataFrame:
    """Adds the ``(depth, node)`` of each point's cell. A point lies in one cell, so each depth is an equi-join."""
    up = F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    depths = cells.select("depth").distinct()
    tried = keyed.select("*", up).join(F.broadcast(depths), "depth", "left_semi")
    move = F.call_function("shiftright", F.col("key"), (F.lit(3 * keys.BITS) - F.lit(bits) * F.col("depth")).cast("int"))
    return tried.withColumn("node", move).join(shuffled(cells.select("depth", "node")), ["depth", "node"])


def _ranked_in_cells(points: DataFrame, *order: str) -> DataFrame:
    """Adds ``_at`` (1, 2, ... inside each cell) and ``_n``, a cell's points: ranks over all rows, less those of the cells before."""
    ranked = global_rank(points, "cell", *order)
    sizes = ranked.groupBy("cell").agg(F.count("*").alias("_n"), F.min("rank").alias("_least"))  # 2^levels rows
    return ranked.join(F.broadcast(sizes), "cell").withColumn("_at", F.col("rank") - F.col("_least") + 1).drop("rank", "_least")


def kd_cells(points: DataFrame, levels: int, exact: bool = True) -> DataFrame:
    """Adds ``cell``: ``levels`` halvings by the lower median of x, y, z in turn; what equals the median goes left.

    Exact medians come from ranks that no single task counts; ``exact=False`` takes each from a mergeable sketch,
    whose size does not grow with the cell.
    """
    out = points.withColumn("cell", F.lit(0))
    for level in range(levels):
        axis = AXES[level % 3]
        if exact:
            out = _ranked_in_cells(out, axis)
            cuts = out.groupBy("cell").agg(F.max(F.when(F.col("_at") == F.ceil(F.col("_n") / 2), F.col(axis))).alias("_cut"))
        else:
            cuts = out.groupBy("cell").agg(F.percentile_approx(axis, 0.5, 100_000).alias("_cut"))
        out = out.join(F.broadcast(cuts), "cell").withColumn("cell", F.col("cell") * 2 + (F.col(axis) > F.col("_cut")).cast("int")).drop("_cut", "_at", "_n")  # 2^levels cuts
    return out


def kd_tree_cells(points: DataFrame, levels: int) -> DataFrame:
    """Adds ``cell``: halvings by count, the left side taking ceil(n / 2) of a cell's points, ties by id."""
    out = points.withColumn("cell", F.lit(0))
    for level in range(levels):
        out = _ranked_in_cells(out, AXES[level % 3], "id")
        out = out.withColumn("cell", F.col("cell") * 2 + (F.col("_at") > F.ceil(F.col("_n") / 2)).cast("int")).drop("_at", "_n")
    return out


def longest_side_cells(points: DataFrame, levels: int) -> DataFrame:
    """Adds ``cell``: each cell is cut across its widest side at the mean; what lies above the mean goes right."""
    out = points.withColumn("cell", F.lit(0))
    for _ in range(levels):
        spans = out.groupBy("cell").agg(*((F.max(c) - F.min(c)).alias(f"_s{c}") for c in AXES), *(F.avg(c).alias(f"_m{c}") for c in AXES))
        wide = F.greatest("_sx", "_sy", "_sz")
        axis = F.when(F.col("_sx") == wide, 0).when(F.col("_sy") == wide, 1).otherwise(2)
        cuts = spans.select("cell", axis.alias("_axis"), F.when(axis == 0, F.col("_mx")).when(axis == 1, F.col("_my")).otherwise(F.col("_mz")).alias("_cut"))
        place = F.when(F.col("_axis") == 0, F.col("x")).when(F.col("_axis") == 1, F.col("y")).otherwise(F.col("z"))
        out = out.join(F.broadcast(cuts), "cell").withColumn("cell", F.col("cell") * 2 + (place > F.col("_cut")).cast("int")).drop("_axis", "_cut")
    return out


def longest_side_tree_cells(points: DataFrame, levels: int) -> DataFrame:
    """Adds ``cell``: each cell is halved by count across its widest side (the first of equal ones), the left side taking
    ceil(n / 2) of its points, ties by id."""
    out = points.withColumn("cell", F.lit(0))
    for _ in range(levels):
        spans = out.groupBy("cell").agg(*((F.max(c) - F.min(c)).alias(f"_s{c}") for c in AXES))
        wide = F.greatest(*(f"_s{c}" for c in AXES))
        axis = F.when(F.col("_sx") == wide, 0).when(F.col("_sy") == wide, 1).otherwise(2)
        sided = out.join(F.broadcast(spans.select("cell", axis.alias("_axis"))), "cell")  # 2^levels rows
        place = F.when(F.col("_axis") == 0, F.col("x")).when(F.col("_axis") == 1, F.col("y")).otherwise(F.col("z"))
        out = _ranked_in_cells(sided.withColumn("_place", place), "_place", "id")
        out = out.withColumn("cell", F.col("cell") * 2 + (F.col("_at") > F.ceil(F.col("_n") / 2)).cast("int")).drop("_at", "_n", "_axis", "_place")
    return out


def _running(order: str) -> Window:
    return Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def place_by_prefix(pieces: DataFrame, workers: int, weight: str = "n") -> DataFrame:
    """Adds ``worker``: the running weight before a piece, in shares of the average worker's load. One row per piece."""
    total = F.sum(weight).over(Window.partitionBy())
    before = F.sum(weight).over(_running("piece")) - F.col(weight)
    return pieces.withColumn("worker", F.least(F.lit(workers - 1), F.floor(before * workers / total)).cast("int"))


def needs_rebuild(sizes: DataFrame, ratio: float) -> bool:
    """Whether the largest piece exceeds the average by more than ``ratio``."""
    r = sizes.agg((F.max("n") / F.avg("n")).alias("r")).first()["r"]
    return r is not None and r > ratio


def is_sorted(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row: places where ``key`` falls along ``order``."""
    ranked = global_rank(df.select(key, order), order)
    nxt = ranked.select((F.col("rank") - 1).alias("rank"), F.col(key).alias("_next"))
    return ranked.join(nxt, "rank").agg(F.count_if(F.col("_next") < F.col(key)).alias("falls"))


def align(cuts: DataFrame, others: DataFrame) -> DataFrame:
    """Moves each cut (``at``) to the nearest of ``others`` (``at``), the lower one on a tie: neighbours by a window over both."""
    both = cuts.select("at", F.lit(1).alias("mine")).unionByName(others.select("at", F.lit(0).alias("mine")))
    w = Window.orderBy("at", "mine")
    other = F.when(F.col("mine") == 0, F.col("at"))
    low = F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(other, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = F.when(high.isNull() | (F.col("at") - low <= high - F.col("at")), low).otherwise(high)
    return both.withColumn("to", near).where("mine = 1").select("at", "to")
