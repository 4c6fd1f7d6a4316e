"""Mixing sources to target weights, with DataFrame functions only.

Documents are leaves of a tree of levels (say domain, language, source). A token budget goes down the tree by
weight. A node can use at most the tokens below it times `max_epochs`; what it can't use goes to its siblings by
weight, and only what a whole family can't use goes to the siblings of its parent. (Each family is filled like
communicating vessels: children in order of capacity by weight, the saturated ones first.) A leaf's budget is
then read off seeded epochs: in each epoch its documents stand in the order of a seeded hash; whole epochs come
first, then the longest prefix of the next whose tokens fit.

Budgets are exact integers. The prefix is found without gathering a leaf in one task: tokens are summed for each
leaf and hash range (the first three hex digits), and only the range in which the budget ends is put in order.

Nulls in a level count as the value ''. Null texts have no tokens. Rows that are equal in doc_id have one place
and stay or go together; a leaf without tokens is taken whole, once. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash

#: The table of leaves is broadcast up to so many rows; above that Spark joins it by shuffle.
BROADCAST_LEAVES = 20_000


def tokens(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def weight_of(level: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for value, w in weights.items():
        out = F.when(level == value, w).otherwise(out)
    return out.cast("long")


def fill(nodes: DataFrame, family: list[str], name: str, budget: str) -> DataFrame:
    """Adds `grant`: how much of its family's `budget` each child gets; nodes have cap and weight (>= 1)."""
    by = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), name)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    x = nodes.withColumn("_before", F.sum("cap").over(upto) - F.col("cap")).withColumn("_heavy", F.sum("weight").over(after))
    x = x.withColumn("_full", F.col("cap") * F.col("_heavy") <= F.col("weight") * (F.col(budget) - F.col("_before")))
    x = x.withColumn("_rest", F.col(budget) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(by), F.lit(0)))
    x = x.withColumn("_all", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(by))
    x = x.withColumn("_sofar", F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(upto), F.lit(0)))
    share = F.expr("(_rest * _sofar) div _all - (_rest * (_sofar - weight)) div _all")
    return x.withColumn("grant", F.when(F.col("_full"), F.col("cap")).otherwise(share)).drop("_before", "_heavy", "_full", "_rest", "_all", "_sofar")


def leaf_budgets(sizes: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """sizes: levels and avail, one row for each leaf. Adds budget, full (whole epochs) and rest (tokens of the next)."""
    caps = sizes.withColumn("cap", F.col("avail") * max_epochs)
    total = sizes.agg(F.coalesce(F.sum("avail"), F.lit(0)).alias("a"))
    num, den = share
    above = total.select(F.least(F.expr(f"a * {num} div {den}"), F.col("a") * max_epochs).alias("grant"))
    for k, level in enumerate(levels):
        family = levels[:k]
        nodes = caps.groupBy(*levels[: k + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(F.col(level), weights.get(level, {})))
        parent = above.select(*family, F.col("grant").alias("budget"))
        nodes = nodes.join(parent, family) if family else nodes.join(F.broadcast(parent), F.lit(True))  # the total is one row
        above = fill(nodes, family, level, "budget").select(*levels[: k + 1], "grant")
    out = sizes.join(above.withColumnRenamed("grant", "budget"), levels)
    out = out.withColumn("full", F.when(F.col("avail") > 0, F.expr("budget div avail")).otherwise(F.lit(0)))
    return out.withColumn("rest", F.col("budget") - F.col("full") * F.col("avail"))


def plan_leaves(base: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int], max_epochs: int, seed: int) -> DataFrame:
    """base: doc_id, levels, n_tokens. One row per leaf: levels, budget, full, cut (keys up to it are in the last,
    partial epoch; null: there is none)."""
    sizes = base.groupBy(*levels).agg(F.sum("n_tokens").alias("avail"))
    leaves = stash(leaf_budgets(sizes, levels, weights, share, max_epochs), "mix-leaves")
    partial = leaves.where((F.col("rest") > 0) | (F.col("full") == 0)).select(*levels, "full", "rest")
    docs = base.join(_small(partial), levels).withColumn("key", order_key(seed, F.col("full"), F.col("doc_id"))).withColumn("range", F.substring("key", 1, 3))
    ranges = docs.groupBy(*levels, "range").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*levels).orderBy("range")
    ranges = ranges.withColumn("after", F.sum("n").over(upto)).where(F.col("after") > F.col("rest"))
    cut = ranges.groupBy(*levels).agg(F.min(F.struct("range", (F.col("after") - F.col("n")).alias("before"))).alias("r")).select(*levels, F.col("r.range").alias("range"), F.col("r.before").alias("before"))
    cut = stash(cut, "mix-ranges")
    inside = docs.join(_small(cut), [*levels, "range"])
    inside = inside.withColumn("sofar", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*levels).orderBy("key"))).where(F.col("sofar") <= F.col("rest"))
    last = inside.groupBy(*levels).agg(F.max("key").alias("last"))
    ends = cut.join(last, levels, "left").select(*levels, F.coalesce("last", "range").alias("end"))
    out = leaves.join(ends, levels, "left")
    is_partial = (F.col("rest") > 0) | (F.col("full") == 0)
    return stash(out.select(*levels, "budget", "full", F.when(is_partial, F.coalesce("end", F.lit("g"))).alias("cut")), "mix-plan")  # 'g' is after every key


def _small(leaves: DataFrame) -> DataFrame:
    """A table with a row for each leaf at most; its rows are counted before it is broadcast."""
    return F.broadcast(leaves) if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else leaves


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], share: tuple[int, int] = (1, 1), max_epochs: int = 1, seed: int = 1) -> DataFrame:
    """The rows of docs that the mix takes, once for each epoch that takes them: all columns of docs, then epoch,
    n_tokens and leaf_budget, and the levels as columns with these names.

    levels: name -> column, from the root down. weights: level -> value -> weight (whole numbers from 1; 1 for
    values that aren't named). share: the budget as a fraction of all tokens. Columns of docs that clash with an
    added one keep their place, and the added one is left out.
    """
    if any(w < 1 for of in weights.values() for w in of.values()):
        raise ValueError("weights are whole numbers from 1")
    own = {f"_mix_{name}": F.coalesce(c.cast("string"), F.lit("")) for name, c in levels.items()}
    names = list(own)
    rows = docs.select("*", *(c.alias(n) for n, c in own.items()), tokens().alias("_mix_tokens"))
    base = stash(rows.select("doc_id", *names, F.col("_mix_tokens").alias("n_tokens")), "mix-base")
    plan = plan_leaves(base, names, {f"_mix_{k}": v for k, v in weights.items()}, share, max_epochs, seed)
    plan = plan.select(*names, F.col("budget").alias("_mix_budget"), F.col("full").alias("_mix_full"), F.col("cut").alias("_mix_cut"))
    taken = rows.join(_small(plan), names)
    epochs = F.when(F.col("_mix_cut").isNotNull() & (order_key(seed, F.col("_mix_full"), F.col("doc_id")) <= F.col("_mix_cut")), F.col("_mix_full") + 1).otherwise(F.col("_mix_full"))
    taken = taken.withColumn("_mix_epochs", epochs).where("_mix_epochs > 0").withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0), (F.col("_mix_epochs") - 1).cast("int"))))
    added = {"epoch": "_mix_epoch", "n_tokens": "_mix_tokens", "leaf_budget": "_mix_budget"} | {n: f"_mix_{n}" for n in levels}
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(v).alias(k) for k, v in added.items() if k not in docs.columns))
