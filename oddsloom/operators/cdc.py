"""Change capture over keyed quote state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(feed: DataFrame, keys: list[str], at: str, values: list[str], ties: list[str]) -> DataFrame:
    """Each row of a keyed history with the values before, its kind (added, changed, seen) and when the values last changed."""
    w = Window.partitionBy(*keys).orderBy(at, *ties)
    out = feed.withColumns({f"previous_{v}": F.lag(v).over(w) for v in values}).withColumn("_first", F.row_number().over(w) == 1)
    same = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"previous_{v}")) for v in values])
    out = out.withColumn("kind", F.when(F.col("_first"), "added").when(same, "seen").otherwise("changed"))
    return out.withColumn("changed_at", F.last(F.when(F.col("kind") != "seen", F.col(at)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")


def without_late(feed: DataFrame, keys: list[str], at: str, arrival: list[str]) -> DataFrame:
    """Drops rows older than one of the same key that arrived before; rows as old as it stay."""
    w = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return feed.withColumn("_top", F.max(at).over(w)).where(F.col("_top").isNull() | (F.col(at) >= F.col("_top"))).drop("_top")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison of two states: added, changed, seen or removed, with the values before."""
    old = before.select(*keys, *[F.col(v).alias(f"previous_{v}") for v in values], F.lit(True).alias("_old"))
    out = after.withColumn("_new", F.lit(True)).join(old, keys, "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"previous_{v}")) for v in values])
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "seen").otherwise("changed")
    return out.withColumn("kind", kind).drop("_old", "_new")


def removed(state: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """State entries that a fetch of their scope no longer lists."""
    return state.join(present.select(*keys).distinct(), keys, "left_anti")


def detail_over_listing(listing: DataFrame, detail: DataFrame, event: list[str], keys: list[str], order: list[Column]) -> DataFrame:
    """The detail decides alone for its events; other events come from the listing. Of repeated keys the first stays."""
    rest = listing.join(detail.select(*event).distinct(), event, "left_anti").withColumn("origin", F.lit("listing"))
    both = detail.withColumn("origin", F.lit("detail")).unionByName(rest)
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def merge_timelines(stored: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two series; where both have a moment, the live one counts."""
    both = stored.withColumn("_side", F.lit(0)).unionByName(live.withColumn("_side", F.lit(1)))
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_side").desc()))).where("_rn = 1").drop("_rn", "_side")
