"""Detection: from quotes to the best price of each leg, to combinations whose inverse prices sum to less than one.

Quotes have ``event_id, sport, mode, bk, market, sel, odds, is_open, changed_at, seen_at`` (bk: place of the book in the
order that decides ties; times in epoch milliseconds). The group dimension is small (see operators.groups) and broadcast.
All steps keep to the event: windows and aggregates share one shuffle key prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import Settings


def latest(quotes: DataFrame, ties: list[Column], keys: tuple[str, ...] = ("event_id", "bk", "market", "sel")) -> DataFrame:
    """The last quote of each key by ``changed_at``, then by ``ties`` (a total order makes the result deterministic)."""
    w = Window.partitionBy(*keys).orderBy(F.col("changed_at").desc(), *ties)
    return quotes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_consensus(quotes: DataFrame) -> DataFrame:
    """Adds ``others`` (open books of the same market and outcome but the own one) and ``consensus``: the median of
    their inverse prices. One window over the outcome's quotes instead of a self-join; a book has one quote a key."""
    w = Window.partitionBy("event_id", "market", "sel")
    inverse = F.when(F.col("is_open"), F.struct("bk", (F.lit(1.0) / F.col("odds")).alias("inv")))
    out = quotes.withColumn("_all", F.collect_list(inverse).over(w)).withColumn("_bk", F.col("bk"))
    own = F.array_sort(F.transform(F.filter("_all", lambda x: x["bk"] != F.col("_bk")), lambda x: x["inv"]))
    out = out.withColumn("_inv", own)
    n = F.size("_inv")
    middle = (F.element_at("_inv", F.floor((n + 1) / 2).cast("int")) + F.element_at("_inv", F.floor(n / 2).cast("int") + 1)) / 2
    return out.withColumn("others", n.cast("long")).withColumn("consensus", F.when(n > 0, middle)).drop("_all", "_inv", "_bk")


def is_outlier(settings: Settings) -> Column:
    """Far from what at least so many other open books say."""
    far = F.abs(F.lit(1.0) / F.col("odds") - F.col("consensus")) / F.col("consensus") > settings.consensus_deviation
    return F.coalesce((F.col("others") >= settings.consensus_books) & far, F.lit(False))


def mode_value(settings: Settings, name: str) -> Column:
    chain = F.when(F.lit(False), F.lit(0.0))
    for mode, own in settings.modes.items():
        chain = chain.when(F.col("mode") == mode, F.lit(float(getattr(own, name))))
    return chain


def eligible(quotes: DataFrame, settings: Settings, now: Column) -> DataFrame:
    """Open quotes of enabled books, confirmed recently enough for the event's mode."""
    fresh = now - F.col("seen_at") <= mode_value(settings, "max_leg_age_ms") * settings.leg_age_share
    on = ~F.col("bk").isin(*settings.disabled) if settings.disabled else F.lit(True)
    return quotes.where(F.col("is_open") & fresh & on)


def leg_quotes(quotes: DataFrame, groups: DataFrame) -> DataFrame:
    """Every quote as a source of the legs it can serve."""
    return quotes.join(F.broadcast(groups), ["sport", "market", "sel"])


def best_legs(sources: DataFrame, odds: Column | None = None) -> DataFrame:
    """Best quote of each leg: highest effective price, then the earlier book, then the better source."""
    price = F.col("odds") if odds is None else odds
    best = F.min(F.struct((-price).alias("neg"), "bk", "src", "market", "sel", "odds", "changed_at", "seen_at"))
    out = sources.groupBy("event_id", "sport", "mode", "group_key", "legs", "leg", "leg_sel").agg(best.alias("b"))
    return out.select("event_id", "sport", "mode", "group_key", "legs", "leg", "leg_sel", (-F.col("b.neg")).alias("eff"), "b.bk", "b.src", "b.market", "b.sel", "b.odds", "b.changed_at", "b.seen_at")


def combinations(best: DataFrame) -> DataFrame:
    """One row for each group that has all its legs: inverse sum, margin in percent, books, synchronicity, legs."""
    out = best.groupBy("event_id", "sport", "mode", "group_key", "legs").agg(
        F.count(F.lit(1)).alias("found"), F.array_sort(F.collect_list(F.struct("leg", "leg_sel", "market", "sel", "bk", "odds", "eff"))).alias("leg_list"),
        F.countDistinct("bk").alias("books"), (F.min("seen_at") >= F.max("changed_at")).alias("in_sync"))
    inverse = F.aggregate("leg_list", F.lit(0.0), lambda s, x: s + F.lit(1.0) / x["eff"])
    out = out.where(F.col("found") == F.col("legs")).withColumn("inverse_sum", inverse)
    return out.withColumn("margin", (F.lit(1.0) / F.col("inverse_sum") - 1) * 100)


def arbs(quotes: DataFrame, groups: DataFrame, settings: Settings, now: Column | None = None, check_consensus: bool = True) -> DataFrame:
    """Combinations over the mode's margin with at least two books; in play, all legs confirmed after the last change.

    ``now`` None skips the age limit. Only the best quote of a leg is tried, as a rule of the domain.
    """
    own = with_consensus(quotes).where(~is_outlier(settings)) if check_consensus else quotes
    own = eligible(own, settings, now) if now is not None else own.where("is_open")
    found = combinations(best_legs(leg_quotes(own, groups)))
    keep = (F.col("books") >= 2) & (F.col("margin") >= mode_value(settings, "min_margin"))
    if now is not None:
        keep = keep & ((F.col("mode") == "PREMATCH") | F.col("in_sync"))
    return found.where(keep)


def closest_to_dead(best: DataFrame) -> DataFrame:
    """Leg whose inverse price rose most against the price it was opened with (``opened``): the one to blame when a
    margin is lost; ties to the earlier leg."""
    rise = F.lit(1.0) / F.col("odds") - F.lit(1.0) / F.col("opened")
    return best.groupBy("event_id", "group_key").agg(F.max_by("bk", F.struct(rise, -F.col("leg"))).alias("worst_bk"), F.max(rise).alias("rise"))
