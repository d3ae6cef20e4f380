"""Plug-ins of the scan: detectors, candle checks and RSI variants from outside, evaluated in the same pass over the feature table.

A plug-in is a fixed signature and the features it needs. Needs are column expressions over the time order of a ticker (``functions.columns``), by which the
feature table is partitioned already, so they add window columns and no shuffle. A registry is a value: adding a plug-in gives a new one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from barlight.config import Detection
from barlight.functions.columns import as_flag, frame, rounded
from barlight.operators import patterns
from barlight.operators.scoring import apply_family_bonus

Needs = dict[str, Column]


@dataclass(frozen=True)
class Detector:
    """*build* turns the scan's parameters into a hit over the feature table's columns and those of *needs*."""

    family: str
    build: Callable[[Detection], patterns.Hit]
    needs: Callable[[Detection], Needs] = lambda cfg: {}


@dataclass(frozen=True)
class CandleCheck:
    """A shape of single bars; a signal bears its flag if one of the last *lookback* bars has it."""

    name: str
    shape: Callable[[], Column]
    lookback: int = 2
    needs: Callable[[], Needs] = dict


@dataclass(frozen=True)
class RsiVariant:
    name: str
    value: Callable[[], Column]
    needs: Callable[[], Needs] = dict


BUILT_IN_RSI = (
    RsiVariant("coverage", lambda: F.coalesce("rsi", rounded(F.col("rsi_full"), 2))),
    RsiVariant("simple", lambda: F.col("rsi")),
    RsiVariant("wilder", lambda: F.col("rsi_full")),
)


def _added(known: dict, key: str, value) -> dict:
    if key in known:
        raise ValueError(f"{key} is registered already")
    return {**known, key: value}


@dataclass(frozen=True)
class Registry:
    """What a scan runs. Detectors emit in order of their families' registration."""

    detectors: dict[str, Detector] = field(default_factory=lambda: {f: Detector(f, build) for f, build in patterns.DETECTORS.items()})
    candles: dict[str, CandleCheck] = field(default_factory=dict)
    rsi: dict[str, RsiVariant] = field(default_factory=lambda: {v.name: v for v in BUILT_IN_RSI})

    def with_detector(self, plugin: Detector) -> Registry:
        return replace(self, detectors=_added(self.detectors, plugin.family, plugin))

    def with_candle(self, plugin: CandleCheck) -> Registry:
        return replace(self, candles=_added(self.candles, plugin.name, plugin))

    def with_rsi(self, plugin: RsiVariant) -> Registry:
        return replace(self, rsi=_added(self.rsi, plugin.name, plugin))

    def prepared(self, features: DataFrame, cfg: Detection, families: tuple, rsi: str | None) -> DataFrame:
        """The feature table with all that the chosen plug-ins need; a need that is a column already stays as it is."""
        needs: Needs = {}
        for part in (*(self.detectors[f].needs(cfg) for f in families), *(x.needs() for x in self.candles.values()), self.rsi[rsi].needs() if rsi else {}):
            needs |= {k: v for k, v in part.items() if k not in features.columns}
        out = features.withColumns(needs) if needs else features
        shapes = {f"_on_{x.name}": as_flag(x.shape()) for x in self.candles.values()}
        out = out.withColumns(shapes) if shapes else out
        flags = {x.name: F.max(f"_on_{x.name}").over(frame(1 - x.lookback, 0)) for x in self.candles.values()}
        return out.withColumns(flags) if flags else out

    def scan(self, features: DataFrame, cfg: Detection = Detection(), families: tuple | None = None, context: tuple = patterns.CONTEXT, rsi: str | None = None,
             weights: DataFrame | None = None, from_date: str | None = None) -> DataFrame:
        """As ``patterns.scan``, with all registered detectors unless *families* names some, a column per candle check, and the RSI variant in the scores."""
        families = tuple(self.detectors) if families is None else families
        if unknown := [f for f in families if f not in self.detectors] + ([rsi] if rsi and rsi not in self.rsi else []):
            raise ValueError(f"not registered: {unknown}")
        hits = {f: self.detectors[f].build for f in families}
        if rsi:
            variant = self.rsi[rsi].value
            hits = {f: lambda cfg, build=build: replace(build(cfg), rsi=variant()) for f, build in hits.items()}
        source = self.prepared(features, cfg, families, rsi)
        out = patterns.detect(source, families, cfg, (*context, *self.candles), hits)
        if from_date is not None:
            out = out.filter(F.col("signal_date") >= F.lit(from_date).cast("date"))
        out = patterns.add_consensus(out, cfg.consensus_bonus)
        return apply_family_bonus(out, weights) if weights is not None else out


REGISTERED = [Registry()]
"""The registry that the stored signal history is scanned with; plug-ins of a deployment are put here before its first scan."""


def register(plugin: Detector | CandleCheck | RsiVariant) -> None:
    add = {Detector: Registry.with_detector, CandleCheck: Registry.with_candle, RsiVariant: Registry.with_rsi}[type(plugin)]
    REGISTERED[0] = add(REGISTERED[0], plugin)


def unregister_all() -> None:
    REGISTERED[0] = Registry()
