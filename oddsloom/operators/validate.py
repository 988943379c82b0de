"""Validation of feed batches: what is dropped from a fetch, and when a fetch is rejected as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import has_line, is_selection_of, quarter_line

LEAST_ODDS, MOST_ODDS = 1.01, 1000.0
FUTURE_MS = 5_000


def judge_selections(feed: DataFrame, batch: tuple[str, ...] = ("bk", "fetch"), pos: str = "pos") -> DataFrame:
    """Adds ``verdict``: ``ok`` or why a selection is dropped. Of repeated ones the first by position stays."""
    line = F.when(has_line(F.col("mtype")), F.col("line"))
    first = F.row_number().over(Window.partitionBy(*batch, "event_id", "mtype", line, "sel").orderBy(pos))
    verdict = (
        F.when(has_line(F.col("mtype")) & quarter_line(F.col("line")), "quarter_line")
        .when(~is_selection_of(F.col("mtype"), F.col("sel")), "foreign_selection")
        .when(F.col("_first") > 1, "duplicate")
        .when(~F.col("odds").between(LEAST_ODDS, MOST_ODDS), "price")
        .otherwise("ok"))
    return feed.withColumn("_first", first).withColumn("verdict", verdict).drop("_first")


def gate_batches(judged: DataFrame, batch: list[str], min_events: int, most_dropped: float) -> DataFrame:
    """Counts of each batch, and whether enough events came and not too much was dropped."""
    dropped = F.count(F.when(F.col("verdict") != "ok", 1))
    out = judged.groupBy(*batch).agg(F.countDistinct("event_id").alias("events"), F.count(F.lit(1)).alias("odds"), dropped.alias("dropped"))
    return out.withColumn("accepted", (F.col("events") >= min_events) & (F.col("dropped") <= most_dropped * F.col("odds")))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key: duplicate events and markets of a fetch."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def freshness(fetched_at: F.Column, now: F.Column, max_age_ms: int) -> F.Column:
    """``stale``, ``future`` or ``ok``."""
    return F.when(now - fetched_at > max_age_ms, "stale").when(fetched_at - now > FUTURE_MS, "future").otherwise("ok")


def consensus_gate(compared: DataFrame, batch: list[str], least: int = 30, most_share: float = 0.3) -> DataFrame:
    """Batches with enough compared quotes of which too many are outliers are rejected; ``compared`` has ``outlier``."""
    out = compared.groupBy(*batch).agg(F.count(F.lit(1)).alias("compared"), F.count(F.when(F.col("outlier"), 1)).alias("outliers"))
    return out.withColumn("accepted", ~((F.col("compared") >= least) & (F.col("outliers") > most_share * F.col("compared"))))
