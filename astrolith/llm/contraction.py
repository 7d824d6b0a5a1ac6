"""Subtree totals of rooted trees of any shape by parallel tree contraction.

Each round rakes and compresses. *Rake*: nodes that the round before found without children leave the tree, and their sums go to
their parents. *Compress*: nodes with one child, not raked now, leave if their random rank is less than their parent's and
their child's; the child moves up to the parent, which takes over what the node held. No two neighbours leave at once, so a
chain loses about a third of its nodes a round, and any tree of n nodes is down to its roots in O(log n) rounds. *Re-expansion*:
a raked node's total was final when it left; a compressed node's total is what it held plus the total of the child
that it had, which left in a later round. These pointers are followed by doubling.

A round is two joins of nodes with the messages of their neighbours, each written as a union and a grouping by node, so that
what many children send to one parent is combined before it is shuffled and no parent is a hot key. Nodes that leave are kept in
the round's own table. Rounds have equal plans (the seed is a column).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.session import cut


def _rank(c: str) -> Column:
    return F.struct(F.xxhash64("seed", F.col(c)), F.col(c))


def _with_children(live: DataFrame, values: list[str]) -> DataFrame:
    """Nodes with ``n`` (children), ``only`` (the least of them) and ``raking`` (whether one of them is to be raked)."""
    none = F.lit(None)
    own = F.struct("id", "parent", F.lit(True).alias("own"), "leaf", *values, F.lit(0).alias("n"), none.cast(live.schema["id"].dataType).alias("only"), F.lit(False).alias("raking"))
    up = F.struct(F.col("parent").alias("id"), none.cast(live.schema["id"].dataType).alias("parent"), F.lit(False).alias("own"), F.lit(False).alias("leaf"), *(F.lit(0).cast("long").alias(v) for v in values), F.lit(1).alias("n"), F.col("id").alias("only"), F.col("leaf").alias("raking"))
    sent = live.select("seed", F.explode(F.when(F.col("parent").isNull(), F.array(own)).otherwise(F.array(own, up))).alias("m")).select("seed", "m.*")
    met = sent.groupBy("id").agg(F.max("seed").alias("seed"), F.max("parent").alias("parent"), F.max("own").alias("own"), F.max("leaf").alias("leaf"), *(F.sum(v).alias(v) for v in values), F.sum("n").alias("n"), F.min("only").alias("only"), F.max("raking").alias("raking"))
    raked = F.col("leaf") & F.col("parent").isNotNull()
    bypassed = ~F.col("leaf") & (F.col("n") == 1) & ~F.col("raking") & F.col("parent").isNotNull() & (_rank("id") < _rank("parent")) & (_rank("id") < _rank("only"))
    return met.where("own").select("id", "seed", "parent", *values, "n", "only", raked.alias("raked"), F.coalesce(bypassed, F.lit(False)).alias("bypassed"))


def _without_gone(marked: DataFrame, values: list[str]) -> DataFrame:
    """The nodes that stay, with the sums and parents that those who leave hand on."""
    kind = marked.schema["id"].dataType
    zero = [F.lit(0).cast("long").alias(v) for v in values]

    def message(to: Column, parent: Column, over: int, leaf: Column, sums) -> Column:
        return F.struct(to.alias("id"), F.struct(F.lit(over).alias("over"), parent.cast(kind).alias("parent")).alias("p"), leaf.alias("leaf"), *sums)

    none, no = F.lit(None), F.lit(False)
    own = message(F.col("id"), F.col("parent"), 1, F.col("n") == 0, values)
    up = message(F.col("parent"), none, 0, no, values)
    down = message(F.col("only"), F.col("parent"), 2, no, zero)
    sent = marked.select((F.col("seed") + 1).alias("seed"), F.explode(F.when(F.col("raked"), F.array(up)).when(F.col("bypassed"), F.array(up, down)).otherwise(F.array(own))).alias("m")).select("seed", "m.*")
    return sent.groupBy("id").agg(F.max("seed").alias("seed"), F.max("p")["parent"].alias("parent"), F.max("leaf").alias("leaf"), *(F.sum(v).alias(v) for v in values))


def subtree_totals(tree: DataFrame, values: list[str], max_rounds: int = 400) -> DataFrame:
    """``(id, values...)``: each node's values summed over its subtree, itself included.

    ``tree`` has ``id`` (not null, one row each), ``parent`` (null for roots) and whole-number columns. Several roots are
    allowed. Parents have to be ids of the table and must not form circles (an error after ``max_rounds``).
    """
    live = tree.select("id", F.lit(0).alias("seed"), "parent", F.lit(False).alias("leaf"), *(F.col(v).cast("long").alias(v) for v in values))
    rounds: list[DataFrame] = []
    for _ in range(max_rounds):
        marked = cut(_with_children(live, values))
        rounds.append(marked)
        if marked.where("parent is not null").isEmpty():
            break
        live = _without_gone(marked, values)
    else:
        raise RuntimeError(f"the tree did not shrink to its roots in {max_rounds} rounds")
    every = lambda what, *cols: reduce(DataFrame.unionByName, (m.where(what).select("id", *cols, *values) for m in rounds))
    done = cut(every("raked").unionByName(rounds[-1].select("id", *values)))
    held = cut(every("bypassed", "only"))
    add = [(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
    after = [F.col(v).alias(f"_{v}") for v in values]
    while True:  # pointers lead to later rounds, so their chains are no longer than the rounds and halve each time
        nxt = held.select(F.col("id").alias("only"), F.col("only").alias("_next"), *after)
        held = cut(held.join(nxt, "only", "left").select("id", F.coalesce("_next", "only").alias("only"), *add, F.col("_next").isNotNull().alias("_more")))
        if held.where("_more").isEmpty():
            return done.unionByName(held.join(done.select(F.col("id").alias("only"), *after), "only").select("id", *add))
        held = held.drop("_more")
