"""Statistics over opportunities, actions and bets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..domain import HISTOGRAM_EDGES_SEC
from ..functions.scalars import epoch, half_up, is_censored, nearest_rank, prague, prague_hour
from .series import running


def by_group(arbs: DataFrame, key: Column, limit: int = 40) -> DataFrame:
    """Count, mean and greatest margin, median lifetime of the ended; the most frequent groups."""
    ended = F.col("end_reason").isNotNull() & ~is_censored(F.col("end_reason"))
    out = arbs.groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("n"), half_up(F.avg("margin"), 3).alias("avg_margin"), F.max("margin").alias("max_margin"),
        F.percentile(F.when(ended, F.col("duration_ms")), F.lit(0.5)).alias("median_ms"))
    return out.orderBy(F.col("n").desc(), "key").limit(limit)


def hour_of(arbs: DataFrame) -> Column:
    return prague_hour(F.col("first_seen"))


def end_reasons(arbs: DataFrame) -> DataFrame:
    return arbs.where("end_reason IS NOT NULL").groupBy(F.split_part("end_reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def lifetime_histogram(spark: SparkSession, arbs: DataFrame) -> DataFrame:
    """Ended and censored lifetimes by bin, empty bins kept. Rows are counted by bin before they meet the bins."""
    edges = [*HISTOGRAM_EDGES_SEC, None]
    bins = spark.createDataFrame([(i, float(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lo double, hi double")
    sec = F.col("duration_ms") / 1000
    place = sum((F.when(sec >= e, 1).otherwise(0) for e in HISTOGRAM_EDGES_SEC[1:]), F.lit(0))
    counted = arbs.where("end_reason IS NOT NULL").groupBy(place.alias("bin")).agg(
        F.count(F.when(~is_censored(F.col("end_reason")), 1)).alias("ended"), F.count(F.when(is_censored(F.col("end_reason")), 1)).alias("censored"))
    return F.broadcast(bins).join(counted, "bin", "left").select(F.col("bin").cast("long").alias("bin"), "lo", "hi", F.coalesce("ended", F.lit(0)).alias("ended"), F.coalesce("censored", F.lit(0)).alias("censored"))


def action_summary(actions: DataFrame) -> DataFrame:
    """Per action: count, mean reaction in whole milliseconds, and its share of all."""
    per = actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("reaction_ms")).cast("long").alias("avg_reaction"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


def slippage(actions: DataFrame, legs: DataFrame) -> DataFrame:
    """Mean difference in percent between placed and detected price, by book."""
    placed = actions.where("action = 'placed'")
    joined = placed.join(legs.select("arb_id", "bk", F.col("odds").alias("leg_odds")), ["arb_id", "bk"])
    return joined.groupBy("bk").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg((F.col("actual") - F.col("leg_odds")) / F.col("leg_odds") * 100), 3).alias("slippage"))


def rejections(actions: DataFrame) -> DataFrame:
    return actions.where("action = 'rejected'").groupBy("bk").agg(F.count(F.lit(1)).alias("n"))


def daily_profit(actions: DataFrame, arbs: DataFrame) -> DataFrame:
    """Stakes and expected profit of placed bets by Prague day, with the running profit. Days are rounded before they add up."""
    m = F.coalesce(F.col("click_margin"), F.col("margin"))
    joined = actions.where("action = 'placed'").join(arbs.select("arb_id", "margin"), "arb_id")
    days = joined.groupBy(F.date_format(prague(F.col("ts")), "yyyy-MM-dd").alias("day")).agg(
        half_up(F.sum("stake"), 2).alias("staked"), half_up(F.sum((F.col("stake") * m / (100 + m)).cast("decimal(30,12)")).cast("double"), 2).alias("profit"))
    running = F.sum("profit").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))  # one row a day
    return days.withColumn("cumulative", half_up(running, 2))


def totals(arbs: DataFrame) -> DataFrame:
    ended = F.col("end_reason").isNotNull()
    return arbs.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~ended, 1)).alias("active"), F.count(F.when(ended & is_censored(F.col("end_reason")), 1)).alias("censored"),
        half_up(F.avg("margin"), 3).alias("avg_margin"), F.max("margin").alias("max_margin"))


def recent_median(actions: DataFrame, last: int = 200, least: int = 5, value: str = "reaction_ms", default: float = 8000.0) -> DataFrame:
    """Median of the latest placed actions; the default where there are too few."""
    top = actions.where("action = 'placed'").where(F.col(value).isNotNull()).orderBy(F.col("ts").desc(), F.col("uid").desc()).limit(last)
    return top.agg(F.count(F.lit(1)).alias("n"), F.percentile(value, F.lit(0.5)).alias("m")).select("n", F.when(F.col("n") >= least, F.col("m")).otherwise(F.lit(default)).alias("needed_ms"))


def acceptance(actions: DataFrame, arbs: DataFrame, least: int = 3) -> DataFrame:
    """Median reaction by book and whether the event is in play; groups with too few actions give none."""
    joined = actions.where("action = 'placed'").join(arbs.select("arb_id", (F.col("mode") != "PREMATCH").alias("live")), "arb_id")
    out = joined.groupBy("bk", "live").agg(F.count(F.lit(1)).alias("n"), F.percentile("reaction_ms", F.lit(0.5)).alias("m"))
    return out.where(F.col("n") >= least).select("bk", "live", "n", F.col("m").alias("median_ms"))


def settle(bets: DataFrame, arbs: DataFrame) -> DataFrame:
    """Expected and settled profit of each bet; a bet keeps a missing opportunity."""
    m = F.coalesce(F.col("click_margin"), F.col("margin"))
    out = bets.join(arbs.select("arb_id", "margin"), "arb_id", "left").withColumn("expected", half_up(F.col("stake") * m / (100 + m), 2))
    real = F.when(F.col("settled") == "won", half_up(F.col("stake") * (F.col("actual") - 1), 2)).when(F.col("settled") == "void", F.lit(0.0)).when(F.col("settled") == "lost", -F.col("stake"))
    return out.withColumn("profit", real)


def bet_totals(settled: DataFrame) -> DataFrame:
    return settled.agg(
        F.count(F.lit(1)).alias("n"), half_up(F.sum("stake"), 2).alias("staked"), F.round(F.sum("expected"), 4).alias("expected"), F.round(F.sum("profit"), 4).alias("real"),
        F.count(F.when(F.col("settled").isNotNull(), 1)).alias("settled"), F.count(F.when(F.col("settled").isNull(), 1)).alias("open"))


def profit_curve(settled: DataFrame, by: list[str], width: int = 86_400_000) -> DataFrame:
    """Running effective profit (real, else expected, else 0) along each series, cut into days."""
    return running(settled, by, "ts", ["uid"], width, total={"curve": F.coalesce("profit", "expected", F.lit(0.0))})


def latency(samples: DataFrame, key: str, value: str, at: list[Column], last: int = 200) -> DataFrame:
    """Nearest-rank 50th and 95th percentile of each key's latest samples."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*at))
    kept = samples.withColumn("_rn", rn).where(F.col("_rn") <= last).groupBy(key).agg(F.collect_list(value).alias("_v"))
    return kept.select(key, F.size("_v").cast("long").alias("n"), nearest_rank(F.col("_v"), 0.5).alias("p50"), nearest_rank(F.col("_v"), 0.95).alias("p95"))


def worst_state(states: DataFrame, keys: list[str], order: tuple[str, ...] = ("OK", "DEGRADED", "BLOCKED")) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("state"))
    return states.groupBy(*keys).agg(F.max_by("state", rank).alias("state"))


def capture_actions(actions: DataFrame, arbs: DataFrame) -> DataFrame:
    """What is stored with an action: reaction since shown (else since first seen), age, margin, in play or not."""
    j = actions.join(arbs.select("arb_id", "first_seen", "margin", "mode"), "arb_id")
    reaction = F.greatest(F.lit(0), F.coalesce(F.col("ts") - F.col("shown_at"), F.col("ts") - F.col("first_seen")))
    return j.withColumn("reaction", reaction).withColumn("age", F.col("ts") - F.col("first_seen")).withColumn("at_margin", F.coalesce("click_margin", "margin")).withColumn("live", F.col("mode") != "PREMATCH")


def timeline(arbs: DataFrame, ticks: DataFrame, actions: DataFrame) -> DataFrame:
    """An opportunity's beginning, ticks, actions and end in one series (columns ``arb_id, at, kind, value``)."""
    start = arbs.select("arb_id", F.col("first_seen").alias("at"), F.lit("start").alias("kind"), F.col("margin").alias("value"))
    end = arbs.where("end_reason IS NOT NULL").select("arb_id", F.col("last_seen").alias("at"), F.lit("end").alias("kind"), F.lit(None).cast("double").alias("value"))
    tick = ticks.select("arb_id", "at", F.lit("tick").alias("kind"), "value")
    act = actions.select("arb_id", F.col("ts").alias("at"), F.col("action").alias("kind"), F.col("stake").alias("value"))
    return start.unionByName(tick).unionByName(act).unionByName(end)


def day_of(ms: Column) -> Column:
    return F.date_format(epoch(ms), "yyyy-MM-dd")
