"""Comparing results and timing queries."""

from __future__ import annotations

import csv
import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that the two results hold in different numbers, with both numbers.

    A multiset comparison by one aggregation, columns taken by name; empty: equal."""
    names = sorted(left.columns)
    if names != sorted(right.columns):
        raise ValueError(f"columns differ: {names}, {sorted(right.columns)}")
    side = lambda df, a, b: df.select(*[F.col(f"`{c}`") for c in names], F.lit(a).alias("n_left"), F.lit(b).alias("n_right"))
    both = side(left, 1, 0).union(side(right, 0, 1)).groupBy(*[F.col(f"`{c}`") for c in names])
    return both.agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right")).where("n_left <> n_right")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    return difference(left, right).isEmpty()


@dataclass(frozen=True)
class Timing:
    name: str
    seconds: tuple[float, ...]
    error: str = ""

    @property
    def mean(self) -> float | None:
        return statistics.fmean(self.seconds) if self.seconds else None

    @property
    def median(self) -> float | None:
        return statistics.median(self.seconds) if self.seconds else None

    @property
    def stdev(self) -> float | None:
        return statistics.stdev(self.seconds) if len(self.seconds) > 1 else None


def time_query(spark: SparkSession, name: str, query: Callable[[], DataFrame], warm_ups: int = 3, runs: int = 5) -> Timing:
    """Times full evaluations: every row is made and none is kept.  A query that fails is
    recorded with its error."""
    took = []
    try:
        for k in range(warm_ups + runs):
            began = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            if k >= warm_ups:
                took.append(time.perf_counter() - began)
    except Exception as e:  # noqa: BLE001 - the report lists what failed
        return Timing(name, tuple(took), f"{type(e).__name__}: {(str(e).strip() or 'no message').splitlines()[0][:200]}")
    return Timing(name, tuple(took))


def write_report(timings: list[Timing], folder: str, log: DataFrame | None = None) -> None:
    """report.csv and report.html in a folder of the driver: average and deviation."""
    rows = [(t.name, len(t.seconds), t.mean, t.median, t.stdev, t.error) for t in timings]
    head = ("query", "runs", "mean_s", "median_s", "stdev_s", "error")
    Path(folder).mkdir(parents=True, exist_ok=True)
    with open(Path(folder, "report.csv"), "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([head, *rows])
    cells = lambda row, tag: "<tr>" + "".join(f"<{tag}>{escape('' if x is None else f'{x:.4f}' if isinstance(x, float) else str(x))}</{tag}>" for x in row) + "</tr>"
    Path(folder, "report.html").write_text(f"<table>{cells(head, 'th')}{''.join(cells(r, 'td') for r in rows)}</table>", encoding="utf-8")


def log_timings(spark: SparkSession, timings: list[Timing], path: str) -> None:
    """Appends the timings to a Parquet log."""
    rows = [(t.name, [float(s) for s in t.seconds], t.mean, t.stdev, t.error) for t in timings]
    spark.createDataFrame(rows, "query string, seconds array<double>, mean double, stdev double, error string").coalesce(1).write.mode("append").parquet(path)
