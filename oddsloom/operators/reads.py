"""Reads of logs and state: what a page, a subscription, a health report or a change of settings asks for.

Each is an ordered limit, a ranked window with a group limit, or one aggregate by book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import Settings
from ..functions.scalars import lookup
from . import detect

STATES = {"OK": 0, "DEGRADED": 1, "BLOCKED": 2}
TICKS = 5_000
#: A new combination must beat what runs in its group by more than this.
LEAD = 0.05


def health_log(log: DataFrame, limit: int) -> DataFrame:
    """The newest entries of the log (``id, ts, event``), probes left out."""
    return log.where("event <> 'probe'").orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def tick_pages(ticks: DataFrame, keys: list[str], at: str, ties: list[str], most: int = TICKS) -> DataFrame:
    """The first ``most`` ticks of each key in order of time, numbered by ``place`` from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(at, *ties))
    return ticks.withColumn("place", place).where(F.col("place") <= most)


def subscriptions(matches: DataFrame, sports: list[str], primary: list[str], limit: int) -> DataFrame:
    """Matches to subscribe to in full (``match_id, sport, start, has_markets, skipped``): primary sports first, then by start."""
    able = matches.where(F.col("sport").isin(*sports) & (F.coalesce("has_markets", F.lit(True))) & ~F.coalesce("skipped", F.lit(False)))
    return able.withColumn("tier", F.when(F.col("sport").isin(*primary), 0).otherwise(1)).orderBy("tier", "start", "match_id").limit(limit)


def health_snapshot(books: DataFrame, states: DataFrame, entries: DataFrame, disabled: list[int]) -> DataFrame:
    """One row for each of ``books`` (``bk``): the worst of its scopes' newest states (``bk, scope, state, at, uid``), ``BLOCKED``
    if it has none, whether it is enabled, and its entries (``bk, matched``) with and without an event."""
    newest = states.groupBy("bk", "scope").agg(F.max_by("state", F.struct("at", "uid")).alias("state"))
    worst = newest.groupBy("bk").agg(F.max_by("state", lookup(F.col("state"), STATES)).alias("state"), F.count(F.lit(1)).alias("scopes"))
    counts = entries.groupBy("bk").agg(F.count(F.when(F.col("matched"), 1)).alias("matched"), F.count(F.when(~F.col("matched"), 1)).alias("unmatched"))
    out = books.join(worst, "bk", "left").join(counts, "bk", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    off = F.col("bk").isin(*disabled) if disabled else F.lit(False)
    return out.select("bk", F.coalesce("state", F.lit("BLOCKED")).alias("state"), (~off).alias("enabled"), zero("scopes"), zero("matched"), zero("unmatched"))


def reevaluated(active: DataFrame, quotes: DataFrame, groups: DataFrame, settings: Settings, disabled: list[int]) -> DataFrame:
    """Running opportunities (``event_id, group_key, mode, margin, leg_list``) after a change of settings.

    ``ended`` (reason ``threshold_changed``) where the margin is below the new limit or a leg's book is off, else ``kept``;
    then everything is evaluated anew, and what is found in a group where nothing kept comes near it is ``new``.
    """
    off = F.exists("leg_list", lambda x: x["bk"].isin(*disabled)) if disabled else F.lit(False)
    lost = (F.col("margin") < detect.mode_value(settings, "min_margin")) | off
    columns = ["event_id", "group_key", "margin", "leg_list"]
    judged = active.select(*columns, F.when(lost, "ended").otherwise("kept").alias("status"))
    own = quotes.where(~F.col("bk").isin(*disabled)) if disabled else quotes
    found = detect.arbs(own, groups, settings, check_consensus=False).select(*columns)
    kept = judged.where("status = 'kept'").select(F.col("event_id").alias("_e"), F.col("group_key").alias("_g"), F.col("margin").alias("_m"))
    near: Column = (F.col("event_id") == F.col("_e")) & (F.col("group_key") == F.col("_g")) & (F.col("_m") >= F.col("margin") - LEAD)
    fresh = found.join(kept, near, "left_anti").withColumn("status", F.lit("new"))
    combo = F.array_join(F.transform("leg_list", lambda x: F.concat_ws(":", x["leg"], x["bk"])), ",")
    return judged.unionByName(fresh).select("event_id", "group_key", "status", F.when(F.col("status") == "ended", "threshold_changed").alias("end_reason"), "margin", combo.alias("combo"))


HOUR = 3_600_000

# Classes of matches fetched in detail, each with its sports' horizons in hours and how many at most.
MAIN = ({"football": 12, "tennis": 12, "basketball": 12, "hockey": 24}, 150)
OTHERS = ({"handball": 24, "baseball": 24, "american_football": 24, "volleyball": 24, "snooker": 24, "darts": 24}, 40)


def detail_targets(matches: DataFrame, start: str, key: str, now: int, main: tuple[dict[str, int], int] = MAIN, others: tuple[dict[str, int], int] = OTHERS) -> DataFrame:
    """Matches to fetch in detail: of each class those that start after ``now`` and within their sport's horizon, nearest first (ties by ``key``), at most so many.

    Adds ``place`` from 1: the first class's matches, then the other's. An ordered limit for each class, so the table is never sorted;
    null starts and sports of neither class are left out.
    """
    away = F.col(start) - F.lit(now)
    parts = []
    for n, (hours, most) in enumerate((main, others)):
        own = matches.where((away > 0) & (away < lookup(F.col("sport"), hours) * F.lit(HOUR)))
        parts.append(own.orderBy(start, key).limit(most).withColumn("_class", F.lit(n)))
    # the quotas bound what is numbered here
    return parts[0].unionByName(parts[1]).withColumn("place", F.row_number().over(Window.orderBy("_class", start, key)).cast("long")).drop("_class")


def nearest_details(matches: DataFrame, start: str, key: str, now: int, hours: int = 36, most: int = 150) -> DataFrame:
    """The nearest matches up to a horizon, which is included, for feeds with one quota; a match that should have started already comes first."""
    return matches.where(F.col(start) <= now + hours * HOUR).orderBy(start, key).limit(most)
