"""Fundamental selection: filters, min-max factors, composite rank, budget allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.functions.columns import rounded

c = F.col


def basic_filter(df: DataFrame, min_price: float = 50.0, min_cap: float = 500.0, min_volume: float = 50_000.0) -> DataFrame:
    out = df.withColumns({x: c(x).try_cast("double") for x in ("price", "market_cap", "avg_volume")})
    return out.filter((c("price") >= min_price) & (c("market_cap") >= min_cap) & (c("avg_volume") >= min_volume))


def min_max(df: DataFrame, factors: dict[str, tuple[Column, bool]]) -> DataFrame:
    """score_<name> in 0..1 per factor; a constant or unknown factor scores 1. All bounds come from one aggregation."""
    signed = df.withColumns({f"_f_{k}": (v if up else -v) for k, (v, up) in factors.items()})
    bounds = signed.agg(F.struct(*[f(f"_f_{k}").alias(f"{n}_{k}") for k in factors for n, f in (("lo", F.min), ("hi", F.max))]).alias("b")).scalar()
    out = signed.withColumn("_b", bounds)

    def scaled(k: str) -> Column:
        lo, hi = c(f"_b.lo_{k}"), c(f"_b.hi_{k}")
        same = lo.isNull() | (F.abs(hi - lo) <= 1e-8 + 1e-5 * F.abs(lo))
        return F.when(same, F.lit(1.0)).otherwise((c(f"_f_{k}") - lo) / (hi - lo))

    return out.withColumns({f"score_{k}": scaled(k) for k in factors}).drop("_b", *[f"_f_{k}" for k in factors])


def composite(df: DataFrame) -> DataFrame:
    """35 % momentum, 25 % profitability, 20 % valuation, 20 % volatility; an unknown factor leaves no composite."""
    number = lambda x: c(x).try_cast("double") if x in df.columns else F.lit(None).cast("double")
    out = df.withColumns(
        {
            "momentum": 0.5 * number("return_6m") + 0.5 * number("return_12m"),
            "pe_clean": F.nullif(number("pe"), F.lit(0.0)),
            "pb_clean": F.nullif(number("pb"), F.lit(0.0)),
            "roe_clean": number("roe"),
            "vol_clean": number("volatility_1y"),
        }
    )
    factors = {"momentum": (c("momentum"), True), "profit": (c("roe_clean"), True), "valuation": (c("pe_clean"), False), "vol": (c("vol_clean"), False)}
    out = min_max(out, factors)
    score = 0.35 * c("score_momentum") + 0.25 * c("score_profit") + 0.20 * c("score_valuation") + 0.20 * c("score_vol")
    return out.withColumn("composite_score", score)


def allocate(df: DataFrame, budget: float = 50_000.0, top_n: int = 10, ticker: str = "ticker") -> DataFrame:
    """The best *top_n* (a top-k report) share the budget by score."""
    best = df.orderBy(F.desc_nulls_last("composite_score"), ticker).limit(top_n)
    total = F.sum("composite_score").over(Window.partitionBy(F.lit(1)))
    share = F.when(total > 0, budget * c("composite_score") / total).otherwise(F.lit(0.0))
    out = best.withColumn("allocation", rounded(share, 2))
    return out.withColumn("expected_return_amount", rounded(c("allocation") * c("return_12m").try_cast("double") / 100.0, 2))
