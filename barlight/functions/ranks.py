"""Exact ranks and quantiles of any size of group, without sorting a group in one task.

Equal values collapse to counts first (map-side), the distinct values are range-partitioned, and each slice adds the
totals of the slices before it. A value shared by a third of the rows is one counted row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.session import durable


def cumulative_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per distinct (keys, value): n, rows *below*, and the group *total*. Null values are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    # The partition number is data from here on, so the sliced rows are materialised before they are read twice.
    sliced = durable(counts.repartitionByRange(*[F.col(k) for k in keys], F.col(value)).withColumn("_slice", F.spark_partition_id()))
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("n").alias("_n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(group).alias("total")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = ranked.join(offsets, [*keys, "_slice"])
    return joined.select(*keys, value, "n", (F.col("_offset") + F.col("_inside")).alias("below"), "total")


def add_average_rank(df: DataFrame, value: str, name: str, keys: tuple = ()) -> DataFrame:
    """Average-tie rank (1-based) of *value* and the group size as <name>_n.

    Ranks of one group are joined back in two parts: values that hold more than a thousandth of the rows, of which there are fewer than a
    thousand, are broadcast, so their rows stay where they are; the others meet their ranks by value.
    """
    ranks = durable(cumulative_counts(df, list(keys), value).select(
        *keys, value, (F.col("below") + (F.col("n") + 1) / 2).alias(name), F.col("total").alias(f"{name}_n"), (F.col("n") * 1000 > F.col("total")).alias("_hot")
    ))
    if keys:
        return df.join(ranks.drop("_hot"), [*keys, value], "left")
    hot, cold = (ranks.filter(x).drop("_hot") for x in (F.col("_hot"), ~F.col("_hot")))
    rest = df.join(F.broadcast(hot.select(value)), value, "left_anti").join(cold, value, "left")
    return df.join(F.broadcast(hot), value).unionByName(rest)


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group: one column per entry of *probs*, plus n and the distinct count."""
    cum = cumulative_counts(df, keys, value)

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("below") <= index) & (index < F.col("below") + F.col("n")), F.col(value)))

    aggs, final = [F.max("total").alias("n"), F.count("*").alias("distinct_n")], []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("total") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}"), F.max(pos - F.floor(pos)).alias(f"_t_{name}")]
        lo, hi, t = (F.col(f"_{k}_{name}") for k in ("lo", "hi", "t"))
        final.append((lo + (hi - lo) * t).alias(name))
    return cum.groupBy(*keys).agg(*aggs).select(*keys, "n", "distinct_n", *final)


def spearman(df: DataFrame, left: str, right: str, keys: tuple = ()) -> DataFrame:
    """Rank correlation with average ties over rows where both sides are known: columns keys, rank_corr, n."""
    both = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*keys, left, right)
    pairs = both.groupBy(*keys, left, right).agg(F.count("*").alias("_w"))
    for side, name in ((left, "_rl"), (right, "_rr")):
        ranks = cumulative_counts(both, list(keys), side).select(*keys, side, (F.col("below") + (F.col("n") + 1) / 2).alias(name), F.col("total").alias(f"{name}_n"))
        pairs = pairs.join(ranks, [*keys, side])
    w, x, y = F.col("_w"), F.col("_rl") / F.col("_rl_n"), F.col("_rr") / F.col("_rr_n")
    s = pairs.groupBy(*keys).agg(
        F.sum("_w").alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * y).alias("sxy"),
        F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"),
    )
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    spread = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy")))
    return s.select(*keys, (cov / F.nullif(spread, F.lit(0.0))).alias("rank_corr"), "n")


def rank_auc(df: DataFrame, score: str, label: str, keys: tuple = ()) -> DataFrame:
    """Mann-Whitney AUC from average ranks: columns keys, auc, positives, negatives."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isin(0, 1)).select(*keys, score, label)
    ranks = cumulative_counts(known, list(keys), score)
    hits = known.groupBy(*keys, score).agg(F.sum(label).alias("_pos"))
    agg = ranks.join(hits, [*keys, score]).groupBy(*keys).agg(
        F.sum(F.col("_pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r"), F.sum("_pos").alias("p"), F.sum(F.col("n") - F.col("_pos")).alias("q")
    )
    p, q = F.col("p"), F.col("q")
    return agg.select(*keys, ((F.col("r") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0))).alias("auc"), p.alias("positives"), q.alias("negatives"))
