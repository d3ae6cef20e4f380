"""Recursive exponential averages as window expressions.

e_t = a*x_t + (1-a)*e_{t-1} is a running sum inside a block of bars plus the decayed value of the block before.
Block-end values further back than the float precision of the decay cannot change the result, so each block
folds a short list of earlier block ends. Everything stays in the JVM and reuses the per-ticker shuffle. Histories known
to be short need no blocks: their weights fit into one running sum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.functions.columns import frame

BLOCK = 64


@dataclass(frozen=True)
class Ewm:
    """Average of *source* with smoothing *alpha*; *start* is the first bar that has a value."""

    name: str
    source: str
    alpha: float
    start: int = 1

    @property
    def decay(self) -> float:
        return 1.0 - self.alpha

    @property
    def longest(self) -> int:
        """Bars over which the weights of a plain running sum stay far within the range of a double."""
        return math.floor(math.log(1e280) / -math.log(self.decay))

    @property
    def history_blocks(self) -> int:
        return max(2, math.ceil(math.log(1e-18) / (BLOCK * math.log(self.decay))))


def running_average(s: Ewm, over=None, ago: int = 0) -> Column:
    """The average as one running sum over the time order of a ticker, which every other indicator uses too: no sort of its own.

    The value *ago* bars earlier is the same over a frame that ends there.
    """
    age = (F.col("bar_no") - 1).cast("double")
    weight = F.when(F.col("bar_no") == s.start, F.lit(1.0)).otherwise(F.lit(s.alpha))
    term = F.coalesce(F.col(s.source), F.lit(0.0)) * weight * F.pow(F.lit(1.0 / s.decay), age)
    total = F.sum(term).over(over or frame(Window.unboundedPreceding, 0))
    return F.when(F.col("bar_no") >= s.start + ago, total * F.pow(F.lit(s.decay), age - ago))


def fit_running(longest: int | None, specs: Sequence[Ewm]) -> bool:
    """Whether a history of *longest* bars, if known, is short enough for plain running sums."""
    return longest is not None and longest <= min(s.longest for s in specs)


def add_ewm(df: DataFrame, specs: list[Ewm], longest: int | None = None) -> DataFrame:
    """Add one column per spec. Needs ticker, bar_no (1, 2, ...) and gap-free sources.

    With *longest*, the bars of the longest history, known and short enough for plain running sums, blocks and the sorts by them are spared.
    """
    if fit_running(longest, specs):
        return df.withColumns({s.name: running_average(s) for s in specs})
    block = F.floor((F.col("bar_no") - 1) / BLOCK).cast("int")
    offset = ((F.col("bar_no") - 1) % BLOCK).cast("double")
    in_block = Window.partitionBy("ticker", "_block").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"_block": block, "_offset": offset})

    def term(s: Ewm):
        weight = F.when(F.col("bar_no") == s.start, F.lit(1.0)).otherwise(F.lit(s.alpha))
        return F.coalesce(F.col(s.source), F.lit(0.0)) * weight * F.pow(F.lit(1.0 / s.decay), F.col("_offset"))

    out = out.withColumns({f"_t_{s.name}": term(s) for s in specs})
    out = out.withColumns(
        {f"_l_{s.name}": F.sum(f"_t_{s.name}").over(in_block) * F.pow(F.lit(s.decay), F.col("_offset")) for s in specs}
    )

    def carried(s: Ewm):
        ends = F.when(F.col("_offset") == BLOCK - 1, F.col(f"_l_{s.name}"))
        earlier = Window.partitionBy("ticker").orderBy("_block").rangeBetween(-s.history_blocks, -1)
        fold = lambda acc, x: acc * F.lit(s.decay**BLOCK) + x
        return F.aggregate(F.collect_list(ends).over(earlier), F.lit(0.0), fold)

    out = out.withColumns({f"_c_{s.name}": carried(s) for s in specs})
    out = out.withColumns(
        {
            s.name: F.when(
                F.col("bar_no") >= s.start,
                F.col(f"_l_{s.name}") + F.col(f"_c_{s.name}") * F.pow(F.lit(s.decay), F.col("_offset") + 1),
            )
            for s in specs
        }
    )
    return out.drop("_block", "_offset", *[f"_{k}_{s.name}" for s in specs for k in "tlc"])
