"""Mixing sources to target weights: temperature, bisection, budgeted block permutations.

Source weights are the token shares raised to an exponent. The exponent is
bisected so that the weights' entropy reaches a share of the largest possible,
without any source being repeated more often than a limit. Each source then gets
its weight of the token budget: whole passes over its documents, and in the last
pass the first documents of a random permutation as far as the budget reaches.

The permutation is the order of a seeded hash of the id; its leading bits cut it
into blocks. Token sums of blocks find the block in which a source's budget
ends, and only that block's documents are summed one by one, so no task orders a
whole source and a source that holds a third of all rows is no hot key. Per
source the plan is one row.

Defined cases: null sources form a source; null texts have no tokens; a source
without tokens keeps its documents once; documents of equal id share their hash
and are in or out together; an empty table gives an empty result. A column of
``docs`` named like an added one is replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import WORD, stored

BLOCKS = 1024


def entropy(weights: np.ndarray) -> float:
    w = weights[weights > 0]
    return float(-(w * np.log(w)).sum())


def temperature_weights(tokens: np.ndarray, exponent: float) -> np.ndarray:
    """Normalised token shares to the power of ``exponent``; sources without tokens get none."""
    share = np.where(tokens > 0, tokens / max(1, tokens.sum()), 0)
    powered = np.where(share > 0, share ** exponent, 0)
    return powered / powered.sum() if powered.sum() > 0 else powered


def bisect_exponent(tokens: np.ndarray, budget: int, entropy_share: float, max_repeats: float) -> float:
    """The largest exponent up to 1 that reaches the entropy, raised where a source would be repeated beyond the limit."""
    n = int((tokens > 0).sum())
    if n < 2:
        return 1.0
    target = entropy_share * math.log(n)
    flat_enough = lambda e: entropy(temperature_weights(tokens, e)) >= target
    few_repeats = lambda e: float((temperature_weights(tokens, e)[tokens > 0] * budget / tokens[tokens > 0]).max()) <= max_repeats

    def edge(holds_low, low: float, high: float) -> float:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds_low(mid) else (low, mid)
        return (low + high) / 2

    flat = 1.0 if flat_enough(1.0) else edge(flat_enough, 0.0, 1.0)
    if few_repeats(flat):
        return flat
    return 1.0 if not few_repeats(1.0) else edge(lambda e: not few_repeats(e), flat, 1.0)


def budgets(tokens: np.ndarray, weights: np.ndarray, budget: int) -> np.ndarray:
    """Whole tokens per source that add up to the budget (largest remainders round up)."""
    exact = weights * budget
    whole = np.floor(exact).astype(np.int64)
    if weights.sum() > 0:
        most = np.argsort(-(exact - whole), kind="stable")[: int(budget - whole.sum())]
        whole[most] += 1
    return whole


def shuffle_hash(id_col: Column, seed: int, epoch: Column | int = 0) -> Column:
    return F.xxhash64(F.lit(seed), epoch if isinstance(epoch, Column) else F.lit(epoch), id_col)


def _block(h: Column) -> Column:
    return F.shiftright(h, 64 - int(math.log2(BLOCKS)))


def mixing_plan(counts: DataFrame, *, entropy_share: float, max_repeats: float, budget: int | None) -> DataFrame:
    """(source, weight, budget, passes, cut) for each source, from (source, h, n_tokens) of every document.

    The driver sees one total per source. ``cut`` is the last hash inside the
    last, partial pass; null where that pass is empty.
    """
    spark = counts.sparkSession
    totals = counts.groupBy("source").agg(F.sum("n_tokens").alias("t")).orderBy("source").collect()
    tokens = np.array([r["t"] for r in totals], dtype=np.int64)
    budget = int(tokens.sum()) if budget is None else budget
    weights = temperature_weights(tokens, bisect_exponent(tokens, budget, entropy_share, max_repeats))
    share = budgets(tokens, weights, budget)
    rows = [(r["source"], float(w), int(b), int(b // t) if t else 1, int(b % t) if t else 0) for r, w, b, t in zip(totals, weights, share, tokens.tolist(), strict=True)]
    kind = dict(counts.dtypes)["source"]
    plan = spark.createDataFrame(rows, f"source {kind}, weight double, budget bigint, passes bigint, rest bigint")

    same = counts["source"].eqNullSafe(plan["source"])
    blocks = counts.groupBy("source", _block(F.col("h")).alias("block")).agg(F.sum("n_tokens").alias("t"))
    upto = blocks.withColumn("upto", F.sum("t").over(Window.partitionBy("source").orderBy("block")))
    upto = upto.join(plan.select(F.col("source").alias("s"), "rest"), upto["source"].eqNullSafe(F.col("s"))).drop("s")
    # Blocks that fit as a whole, and the one in which the budget ends.
    ends = upto.groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("block"))).alias("last_whole"),
        F.min(F.when(F.col("upto") > F.col("rest"), F.struct("block", (F.col("upto") - F.col("t")).alias("before"), "rest"))).alias("end"),
    ).select(F.col("source").alias("s"), "last_whole", "end")
    inside = counts.join(ends, counts["source"].eqNullSafe(F.col("s")))
    at = inside.where(_block(F.col("h")) == F.col("end.block")).withColumn("sum", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    in_end = at.where(F.col("end.before") + F.col("sum") <= F.col("end.rest")).groupBy("source").agg(F.max("h").alias("cut_in"))
    whole_to = F.shiftleft(F.col("last_whole") + 1, 64 - int(math.log2(BLOCKS))) - 1  # the last hash of a block
    cuts = ends.join(in_end.select(F.col("source").alias("s2"), "cut_in"), F.col("s").eqNullSafe(F.col("s2")), "left")
    cuts = cuts.select("s", F.coalesce("cut_in", whole_to).alias("cut"))
    return plan.join(cuts, plan["source"].eqNullSafe(cuts["s"]), "left").select(plan["source"], "weight", "budget", "passes", F.when(F.col("rest") > 0, F.col("cut")).alias("cut"))


def mix_sources(
    docs: DataFrame, *, entropy_share: float = 0.9, max_repeats: float = 4.0, budget: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """``docs`` as mixed: each row as often as its source's plan says, with n_tokens, weight, epoch, block, place.

    ``epoch`` counts the passes from 0. ``block`` and ``place`` order the mix:
    blocks hold a random share of all sources, anew in every epoch; sort by
    (epoch, block, place) to read it. The budget is all tokens of ``docs`` if
    not given.
    """
    h = shuffle_hash(F.col(id_col), seed)
    n_tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    counts = stored(docs.select(F.col(source_col).alias("source"), h.alias("h"), n_tokens.alias("n_tokens")), "counts")
    plan = stored(mixing_plan(counts, entropy_share=entropy_share, max_repeats=max_repeats, budget=budget), "plan")
    plan = plan.select(F.col("source").alias("of"), "weight", "passes", "cut")
    added = ("n_tokens", "weight", "epoch", "block", "place")
    # The row travels as one column, so that no name of its own meets one of the plan's.
    row = F.struct(*[c for c in docs.columns if c not in added])
    rows = docs.select(row.alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"), h.alias("h"), n_tokens.alias("n_tokens"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    times = (F.col("passes") + F.coalesce((F.col("h") <= F.col("cut")).cast("int"), F.lit(0))).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    order = shuffle_hash(F.col("id"), seed + 1, F.col("epoch"))
    new = F.struct("n_tokens", "weight", "epoch", (_block(order) + BLOCKS // 2).cast("int").alias("block"), order.alias("place"))
    return rows.select("row", new.alias("new")).select("row.*", "new.*")
