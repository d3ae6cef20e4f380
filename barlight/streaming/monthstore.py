"""Bars by month, compacted with every batch, and read back no further than a scan looks.

A batch rewrites the months it touches, each as one folder without repeated bars; other months stay as they are. What a batch replaces is kept until the next one
touches it, so a retried batch starts from what it found. Besides the bars there is one row per ticker, its first day, which says whether looking further back can find anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barlight.sources.upserts import keep_last

c = F.col
DAYS_A_MONTH = 18
"""Bars that a month holds at least where an instrument trades every weekday, holidays left out."""


def month_of(date) -> str:
    return F.date_format(date, "yyyy-MM")


def earlier(month: str, months: int) -> str:
    year, number = map(int, month.split("-"))
    at = 12 * year + number - 1 - months
    return f"{at // 12:04d}-{at % 12 + 1:02d}"


@dataclass(frozen=True)
class MonthStore:
    """Bars (date, ticker, ...) below *path*, one live folder per month."""

    spark: SparkSession
    path: str

    def _folders(self, path: str) -> list[str]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().toString() for s in system.listStatus(at) if s.isDirectory()] if system.exists(at) else []

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def versions(self) -> dict[str, dict[int, str]]:
        """Folders of each month by batch: one or two of each, whatever the number of batches."""
        out: dict[str, dict[int, str]] = {}
        for batch in self._folders(f"{self.path}/bars"):
            for folder in self._folders(batch):
                out.setdefault(folder.rpartition("month=")[2], {})[int(batch.rpartition("batch=")[2])] = folder
        return out

    def live(self, upto: int) -> dict[str, str]:
        out = {}
        for month, known in self.versions().items():
            if usable := [b for b in known if b <= upto]:
                out[month] = known[max(usable)]
        return out

    def _read(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def put(self, bars: DataFrame, batch: int) -> None:
        """Merge the bars of *batch* into their months; of several bars of a day the last delivered stays, of one delivery any."""
        before, versions = self.live(batch - 1), self.versions()
        months = [r[0] for r in bars.select(month_of("date").alias("m")).distinct().collect()]  # as many as the calendar has
        old = self._read([before[m] for m in months if m in before], bars.schema).withColumn("_order", F.lit(0))
        merged = keep_last(old.unionByName(bars.withColumn("_order", F.lit(1))), ["ticker", "date"], "_order").drop("_order").withColumn("month", month_of("date"))
        merged.hint("rebalance", c("month")).write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/bars/batch={batch}")
        self._put_firsts(bars, batch)
        for month in months:
            for version, folder in versions.get(month, {}).items():
                if version < batch and folder != before.get(month):
                    self._delete(folder)

    def _put_firsts(self, bars: DataFrame, batch: int) -> None:
        known = {int(f.rpartition("batch=")[2]): f for f in self._folders(f"{self.path}/firsts")}
        schema = "ticker string, first date"
        latest = max((b for b in known if b < batch), default=None)
        rows = self._read([known[latest]] if latest is not None else [], schema).unionByName(bars.select("ticker", c("date").alias("first")))
        rows.groupBy("ticker").agg(F.min("first").alias("first")).write.mode("overwrite").parquet(f"{self.path}/firsts/batch={batch}")
        for version, folder in known.items():
            if latest is not None and version < latest:
                self._delete(folder)

    def history(self, fresh: DataFrame, bars: int, upto: int) -> DataFrame:
        """All bars from each moved ticker's first new one on, and the *bars* before it.

        Only months that can matter are opened: as many as hold that many bars of daily trade, and more of them while a ticker that trades less has older bars.
        """
        moved = fresh.groupBy("ticker").agg(F.min("date").alias("_first"))
        start = moved.agg(F.min(month_of("_first"))).first()[0]
        live = self.live(upto)
        firsts = self._read([f"{self.path}/firsts/batch={upto}"], "ticker string, first date")
        span = -(-bars // DAYS_A_MONTH) + 1
        while True:
            least = earlier(start, span)
            window = self._read([live[m] for m in sorted(live) if m >= least], fresh.schema).join(moved, "ticker")
            if min(live) >= least:
                break
            held = window.filter(c("date") < c("_first")).groupBy("ticker").agg(F.count("*").alias("n"))
            short = firsts.join(moved, "ticker").join(held, "ticker", "left").filter((F.coalesce("n", F.lit(0)) < bars) & (month_of("first") < least))
            if short.isEmpty():
                break
            span *= 2
        back = F.count_if(c("date") < c("_first")).over(Window.partitionBy("ticker").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0))
        return window.withColumn("_back", back).filter(c("_back") <= bars).select(*fresh.columns)
