"""Open positions as keyed state over a stream of bars and signals.

One state row per ticker holds its open positions and nothing else. New bars close positions or leave them; an event-time timer expires those of
instruments that get no bars any more. State lies in a store with change-log checkpoints, so a batch costs its own rows, whatever came before.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barlight.config import Backtest

c = F.col
EVENT = "ticker string, ts timestamp, kind string, high double, close double, pattern string, entry_price double, stop_price double, hold_to_target_only boolean"
OUTPUT = (
    "ticker string, signal_date date, pattern string, entry_price double, stop_price double, hold_to_target_only boolean, status string, exit_date date, exit_price double"
)
STATE = "signal_date array<date>, pattern array<string>, entry_price array<double>, stop_price array<double>, hold_to_target_only array<boolean>"
FIELDS = ("signal_date", "pattern", "entry_price", "stop_price", "hold_to_target_only")
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
DAY_MS = 86_400_000


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state on disk, with change logs as checkpoints."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bar_events(bars: DataFrame) -> DataFrame:
    return _events(bars.select("ticker", c("date").cast("timestamp").alias("ts"), F.lit("bar").alias("kind"), "high", "close"))


def signal_events(signals: DataFrame) -> DataFrame:
    return _events(signals.select("ticker", c("signal_date").cast("timestamp").alias("ts"), F.lit("signal").alias("kind"), "pattern", "entry_price", "stop_price", "hold_to_target_only"))


def _events(rows: DataFrame) -> DataFrame:
    names = [part.split() for part in EVENT.split(", ")]
    return rows.select(*[(c(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in names])


def _day(ms: int) -> datetime.date:
    return datetime.date(1970, 1, 1) + datetime.timedelta(days=ms // DAY_MS)


def _ms(day: datetime.date) -> int:
    return (day - datetime.date(1970, 1, 1)).days * DAY_MS


def track_events(events: DataFrame, cfg: Backtest = Backtest(), expire_days: int | None = None, lateness: str = "30 days") -> DataFrame:
    """Rows of positions that opened and stayed open (holding) and of those that closed (target, stop, expired), as they do.

    A bar closes the positions of earlier signals: target by its high, stop by its close once the lockout is over, the target first. A signal that comes late meets the
    bars that come with it and after it; one that repeats an open position is ignored. With *expire_days* a position that is older than that at its
    ticker's last bar, or at the watermark, which trails the stream by *lateness*, expires, and events older than the watermark are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        watermark = state.getCurrentWatermarkMs() if expire_days is not None else 0
        if state.hasTimedOut:
            old = [(_day(watermark) - p[0]).days > expire_days for p in held]
            out = [(*p, "expired", _day(watermark), None) for p, gone in zip(held, old) if gone]
            held = [p for p, gone in zip(held, old) if not gone]
        else:
            parts = list(batches)
            rows = parts[0] if len(parts) == 1 else pd.concat(parts)
            stored = {(p[0], p[1]) for p in held}
            positions = {(p[0], p[1]): p for p in _signals(rows, cfg)[::-1]} | {(p[0], p[1]): p for p in held}  # the first signal counts, a stored position before any
            bars = _bars(rows)
            done = [(p, _close(p, *bars, cfg, expire_days)) for p in positions.values()]
            out = [(*p, *end) for p, end in done if end[0] != "holding" or (p[0], p[1]) not in stored]
            held = [p for p, end in done if end[0] == "holding"]
        if held:
            state.update(tuple(map(list, zip(*held))))
            if expire_days is not None:
                due = _ms(min(p[0] for p in held)) + (expire_days + 1) * DAY_MS
                state.setTimeoutTimestamp(max(due, watermark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=[part.split()[0] for part in OUTPUT.split(", ")], dtype=object)

    timeout = GroupStateTimeout.EventTimeTimeout if expire_days is not None else GroupStateTimeout.NoTimeout
    timed = events.withWatermark("ts", lateness) if expire_days is not None else events
    return timed.groupBy("ticker").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


def _known(x) -> float | None:
    return None if x is None or x != x else float(x)


def _signals(rows: pd.DataFrame, cfg: Backtest) -> list[tuple]:
    """Positions that the signals among *rows* ask for, as FIELDS; a missing stop is the fixed one."""
    new = rows[(rows["kind"] == "signal").to_numpy()]
    out = []
    for day, pattern, entry, stop, hold in zip(_days(new).tolist(), *(new[f].tolist() for f in FIELDS[1:])):
        entry, stop = _known(entry), _known(stop)
        if stop is None and entry is not None:
            stop = entry * (1.0 - cfg.stop_pct / 100.0)
        out.append((day, pattern if isinstance(pattern, str) else None, entry, stop, hold))
    return out


def _bars(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Days, highs and closes of the bars among *rows*, ascending by day."""
    bars = rows[((rows["kind"] == "bar") & rows["ts"].notna()).to_numpy()]
    days = _days(bars)
    order = np.argsort(days, kind="stable")
    return days[order], bars["high"].to_numpy(float)[order], bars["close"].to_numpy(float)[order]


def _days(rows: pd.DataFrame) -> np.ndarray:
    return rows["ts"].to_numpy().astype("datetime64[D]")


def _close(position: tuple, days: np.ndarray, highs: np.ndarray, closes: np.ndarray, cfg: Backtest, expire_days: int | None) -> tuple:
    """Status, exit date and exit price of a position after the bars."""
    signal_date, _, entry, stop, hold = position
    first = int(np.searchsorted(days, np.datetime64(signal_date, "D"), side="right"))
    if first == len(days):
        return "holding", None, None
    target = None if entry is None else entry * (1.0 + cfg.target_pct / 100.0)
    hit = highs[first:] >= (np.nan if target is None else target)
    if not hold and stop is not None:
        free = int(np.searchsorted(days, np.datetime64(signal_date, "D") + cfg.lockout_days, side="right")) - first
        hit[max(free, 0) :] |= closes[first + max(free, 0) :] <= stop
    if hit.any():
        at = first + int(hit.argmax())
        day = days[at].item()
        return ("target", day, target) if target is not None and highs[at] >= target else ("stop", day, stop)
    if expire_days is not None and (days[-1].item() - signal_date).days > expire_days:
        return "expired", days[-1].item(), None
    return "holding", None, None


def run_tracking(events: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, **options) -> None:
    """Process what is available of an event stream and hand each batch's position rows to *body*."""
    with state_settings(events.sparkSession):
        query = track_events(events, **options).writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
