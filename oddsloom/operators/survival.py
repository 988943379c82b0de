"""Lifetimes of opportunities: Kaplan-Meier curves over a hierarchy of segments, summaries and predictions.

Observations have ``duration_ms`` and ``event`` (false: censored). Curves are rows (keys, t, at_risk, d, s).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import segment_key
from .series import running

#: From the finest segment to all observations, as prefixes of these columns.
HIERARCHY = ("mode", "sport", "mtype", "pair", "band")
LEAST_SAMPLES = 30
POINTS_SEC = (5, 10, 30, 60)


def deaths(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Events and censored observations at each time."""
    return obs.groupBy(*keys, F.col("duration_ms").alias("t")).agg(F.sum(F.col("event").cast("long")).alias("d"), F.count(F.lit(1)).alias("m"))


def curve(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Product-limit estimate at event times; censored observations of the same time are still at risk.

    The product is the exponential of a running sum of logarithms; from the first time at which all at risk end, S is 0.
    """
    back = Window.partitionBy(*keys).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = counted.withColumn("at_risk", F.sum("m").over(back)).where("d > 0")
    ends = F.max(F.when(F.col("d") == F.col("at_risk"), 1).otherwise(0)).over(on) == 1
    logs = F.sum(F.when(F.col("d") < F.col("at_risk"), F.log(F.lit(1.0) - F.col("d") / F.col("at_risk"))).otherwise(0.0)).over(on)
    return out.withColumn("s", F.when(ends, F.lit(0.0)).otherwise(F.exp(logs)))


def kaplan_meier(obs: DataFrame, keys: list[str]) -> DataFrame:
    return curve(deaths(obs, keys), keys)


def hierarchy(obs: DataFrame) -> DataFrame:
    """Counts by time for every level of the hierarchy: observations are counted once at the finest level, then rolled up."""
    columns = list(HIERARCHY)
    fine = deaths(obs, columns)
    sets = [[*[F.col(c) for c in columns[:n]], F.col("t")] for n in range(len(columns), -1, -1)]
    out = fine.groupingSets(sets, *columns, "t").agg(F.sum("d").alias("d"), F.sum("m").alias("m"), F.grouping_id(*columns, "t").alias("_g"))
    level = F.when(F.col("_g") == 0, 0)
    for n in range(1, len(columns) + 1):
        level = level.when(F.col("_g") == (2**n - 1) * 2, n)
    kept = [F.when(level <= len(columns) - 1 - i, F.col(c)) for i, c in enumerate(columns)]
    return out.select(level.alias("level"), segment_key(dict(zip(columns, kept, strict=True))).alias("segment"), "t", "d", "m")


def summaries(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Size, events, quartiles of the lifetime and survival beyond the stated seconds, per segment."""
    size = counted.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum("d").alias("n_events"))
    at = lambda q: F.min(F.when(F.col("s") <= 1 - q + 1e-12, F.col("t")))
    over = lambda sec: F.coalesce(F.min(F.when(F.col("t") <= sec * 1000, F.col("s"))), F.lit(1.0))
    aggs = [at(0.25).alias("p25_ms"), at(0.5).alias("median_ms"), at(0.75).alias("p75_ms"), *[over(s).alias(f"over_{s}") for s in POINTS_SEC]]
    points = curve(counted, keys).groupBy(*keys).agg(*aggs)
    out = size.join(points, keys, "left")
    return out.fillna(1.0, [f"over_{s}" for s in POINTS_SEC])


def predict(rows: DataFrame, model: DataFrame, key: str, least: int = LEAST_SAMPLES) -> DataFrame:
    """Summary of the finest segment with enough samples.

    The different finest segments of the rows, few beside the rows, ask their six levels; the rows then meet one summary each.
    """
    columns = list(HIERARCHY)
    asked = [F.struct(F.lit(lv).alias("level"), segment_key({c: F.col(c) for c in columns[: len(columns) - lv]} or {"none": F.lit(None)}).alias("segment")) for lv in range(len(columns) + 1)]
    known = model.where(F.col("n") >= least)
    wide = rows.select(*columns).distinct().select(*columns, F.explode(F.array(*asked)).alias("a")).select(*columns, "a.level", "a.segment")
    values = [c for c in known.columns if c not in ("level", "segment")]
    joined = wide.join(known.drop("level"), "segment")
    best = joined.groupBy(*columns).agg(F.min(F.struct("level", "segment", *values)).alias("b")).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)], "b")
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(best[f"_k{i}"]) for i, c in enumerate(columns)])
    return rows.join(best, same).select(rows[key], "b.*")


def survival_at(points: DataFrame, asked: DataFrame, keys: list[str], t: str, width: int = 1_000) -> DataFrame:
    """As-of lookup: S at the last event time not after ``t`` (1 before the first), by a union along time cut into seconds."""
    both = points.select(*keys, F.col("t").alias("_at"), F.lit(0).alias("_side"), F.col("s").alias("_s"), F.lit(None).cast(asked.schema["id"].dataType).alias("id")).unionByName(
        asked.select(*keys, F.col(t).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_s"), "id"))
    found = running(both, keys, "_at", ["_side"], width, latest={"s": F.col("_s")})
    return found.where("_side = 1").select("id", *keys, F.col("_at").alias(t), F.coalesce("s", F.lit(1.0)).alias("s"))


def flags(predicted: DataFrame, needed_ms: Column, p_needed: Column) -> DataFrame:
    """Muted if it likely ends before a bet is placed; risky if a break likely ends first."""
    muted = p_needed < 0.5
    risky = (F.col("mode") == "PAUSED") & (F.col("median_ms") > F.col("pause_left_ms"))
    return predicted.withColumn("needed_ms", needed_ms).withColumn("muted", F.coalesce(muted, F.lit(False))).withColumn("risky", F.coalesce(risky, F.lit(False)))
