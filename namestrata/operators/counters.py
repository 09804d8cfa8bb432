"""Named counters of a plan, observed while its rows flow and merged over several jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Counters:
    """Counts rows by condition at any number of stages without a pass of their own.

    Each stage is observed in the job that reads it first, whatever job that is. Stages may use
    one name, whose values add up. Totals are complete once every observed stage has run in some
    action; asking before that waits for it.
    """

    def __init__(self):
        self.watches: list[Observation] = []
        self.known: dict[str, int] = {}

    def watch(self, df: DataFrame, **conditions: Column) -> DataFrame:
        """The same rows; of each condition the rows that meet it are counted under its name."""
        watch = Observation()
        self.watches.append(watch)
        for name in conditions:
            self.known.setdefault(name, 0)
        return df.observe(watch, *[F.count_if(c).alias(n) for n, c in conditions.items()])

    def add(self, **values: int) -> None:
        for name, value in values.items():
            self.known[name] = self.known.get(name, 0) + value

    def totals(self) -> dict[str, int]:
        """All counters by name."""
        out = dict(self.known)
        for watch in self.watches:
            for name, value in watch.get.items():
                out[name] = out.get(name, 0) + int(value or 0)
        return dict(sorted(out.items()))

    def row(self, spark: SparkSession) -> DataFrame:
        """One row with a column per counter."""
        totals = self.totals()
        return spark.createDataFrame([tuple(totals.values())], ", ".join(f"{n} BIGINT" for n in totals))


def watched(counters: Counters | None, df: DataFrame, **conditions: Column) -> DataFrame:
    """``df``, observed where there are counters to observe it."""
    return counters.watch(df, **conditions) if counters else df
