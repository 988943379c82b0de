"""Health of sources from a log of outcomes.

What steers live fetching (stepping down, probing, retrying) is scheduling and left out; the log's analysis is here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import fold, running

FAILURES = 3
HOUR = 3_600_000


def failure_runs(log: DataFrame, keys: list[str], at: str, ties: list[str], width: int = HOUR) -> DataFrame:
    """Length of the run of failures up to each outcome, and whether it makes the source step down.

    The run is the count of failures so far less what it was at the last success.
    """
    counted = running(log, keys, at, ties, width, total={"_failed": F.col("ok").isin(False).cast("long")})
    out = running(counted, keys, at, ties, width, latest={"_then": F.when(F.col("ok"), F.col("_failed"))})
    run = F.when(F.col("ok"), 0).otherwise(F.col("_failed") - F.coalesce("_then", F.lit(0))).cast("long")
    return out.withColumn("run", run).withColumn("trips", (F.col("run") > 0) & (F.col("run") % FAILURES == 0)).drop("_failed", "_then")


def throttled(ticks: DataFrame, keys: list[str], at: str, least_ms: int = 200, ties: list[str] | None = None) -> DataFrame:
    """Ticks at least so long after the last one kept: a rule on its own past. Of ticks of one time the first by ``ties`` (else by all other columns) counts."""
    ties = [c for c in ticks.columns if c not in (*keys, at)] if ties is None else ties

    def step(last: int | None, row: dict) -> tuple[int, list[dict]]:
        return (row[at], [row]) if last is None or row[at] - last >= least_ms else (last, [])

    return fold(ticks, keys, [at, *ties], lambda: None, step, ticks.schema)
