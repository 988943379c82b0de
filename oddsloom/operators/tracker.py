"""What the books report of a match, merged: in play or not, finished, paused, and by whom the state is told.

Reports have ``event_id, bk, live, seen_at, finished, authoritative, pause_type, pause_started`` and state columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import BREAK_SECONDS, STANDSTILL_SECONDS
from ..functions.scalars import fold, lookup, says_break

FRESH_MS = 20_000


def merged_view(reports: DataFrame, now: Column) -> DataFrame:
    """One row an event: votes over the fresh reports of play."""
    fresh = reports.where(now - F.col("seen_at") < FRESH_MS)
    live, paused = F.col("live"), F.col("live") & F.col("pause_type").isNotNull()
    auth = live & F.col("authoritative")
    n = lambda c: F.count(F.when(c, 1))
    earliest = lambda c: F.min(F.when(c, F.struct("pause_started", "pause_type")))
    out = fresh.groupBy("event_id").agg(
        n(live).alias("live_reports"), n(live & F.col("finished")).alias("_done"), n(auth).alias("_auth"), n(auth & paused).alias("_auth_paused"),
        earliest(auth & paused).alias("_p1"), earliest(paused).alias("_p2"),
        F.max(F.when(live, F.struct("authoritative", "seen_at", -F.col("bk").cast("long"), "bk"))).alias("_primary"), F.count(F.lit(1)).alias("reports"))
    finished = F.col("_done") * 2 > F.col("live_reports")
    pause = F.when(F.col("_auth") > 0, F.when(F.col("_auth_paused") * 2 > F.col("_auth"), F.col("_p1"))).otherwise(F.col("_p2"))
    out = out.withColumn("finished", finished).withColumn("_pause", F.when((F.col("live_reports") > 0) & ~finished, pause))
    mode = F.when(F.col("live_reports") == 0, "PREMATCH").when(F.col("_pause").isNotNull(), "PAUSED").otherwise("LIVE")
    return out.select("event_id", "reports", "live_reports", "finished", mode.alias("mode"), F.col("_pause.pause_type").alias("pause_type"), F.col("_pause.pause_started").alias("pause_started"), F.col("_primary.bk").alias("state_from"))


def demand(views: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """How closely a book must be followed: LIVE, PAUSED or IDLE, by its events in play."""
    own = reports.where(F.col("live") & (now - F.col("seen_at") < FRESH_MS)).select("bk", "event_id").distinct()
    rank = F.when(F.col("finished"), 0).when(F.col("mode") == "LIVE", 2).when(F.col("mode") == "PAUSED", 1).otherwise(0)
    out = own.join(views.select("event_id", "mode", "finished"), "event_id").groupBy("bk").agg(F.max(rank).alias("r"))
    return out.select("bk", lookup(F.col("r"), {2: "LIVE", 1: "PAUSED", 0: "IDLE"}).alias("demand"))


def transition_reason(before: Column, after: Column, finished_before: Column, finished: Column) -> Column:
    """Why opportunities end when an event changes its mode; null if they go on."""
    return (
        F.when(finished & ~finished_before, "event_finished").when(before == after, F.lit(None)).when(before == "PREMATCH", "event_started")
        .when((before == "PAUSED") & (after == "LIVE"), "pause_ended").when((before == "LIVE") & (after == "PAUSED"), "pause_started").when(after == "PREMATCH", "event_finished"))


def transitions(views: DataFrame, at: str = "at") -> DataFrame:
    """Changes of mode along a history of views, with the reason they give."""
    w = Window.partitionBy("event_id").orderBy(at)
    out = views.withColumn("mode_before", F.lag("mode").over(w)).withColumn("_fb", F.coalesce(F.lag("finished").over(w), F.lit(False)))
    out = out.where("mode_before IS NOT NULL").withColumn("reason", transition_reason(F.col("mode_before"), F.col("mode"), F.col("_fb"), F.col("finished")))
    return out.where("reason IS NOT NULL").drop("_fb")


def pause_type(sport: Column, status: Column, period: Column, clock: Column, competition: Column) -> Column:
    """Which break it is."""
    half = F.coalesce(fold(status).rlike("polocas|half"), F.lit(False))
    quarter = F.when(F.coalesce(competition.rlike(r"(?i)\bnba\b"), F.lit(False)), 720).otherwise(600)
    q = F.coalesce(period, F.greatest(F.lit(1), F.floor(clock / quarter + 0.5)))
    fixed = {"football": "football_ht", "hockey": "hockey_intermission", "tennis": "tennis_set_break", "handball": "handball_ht", "volleyball": "volleyball_set_break"}
    return (
        F.when(sport == "basketball", F.when(half | F.coalesce(q == 2, F.lit(False)), "basketball_ht").otherwise("basketball_quarter"))
        .when(sport == "american_football", F.when(half | F.coalesce(period == 2, F.lit(False)), "american_football_ht").otherwise("american_football_quarter"))
        .otherwise(lookup(sport, fixed, F.lit("other_break"))))


def at_boundary(sport: Column, period: Column, clock: Column, remaining: Column, competition: Column) -> Column:
    """Whether the clock stands where a period ends."""
    near = lambda unit, last, slack, strict: (clock >= unit - 5) & ((clock < last) if strict else (clock <= last)) & ((clock % unit <= slack) | (clock % unit >= unit - slack))
    quarter = F.when(F.coalesce(competition.rlike(r"(?i)\bnba\b"), F.lit(False)), 720).otherwise(600)
    first = period.isNull() | (period <= 1)
    by_sport = (
        F.when(sport == "football", clock.between(2670, 3600) & first).when(sport == "hockey", near(F.lit(1200), F.lit(3600), 3, False))
        .when(sport == "basketball", near(quarter, 4 * quarter, 3, True)).when(sport == "handball", clock.between(1770, 2400) & first)
        .when(sport == "american_football", near(F.lit(900), F.lit(3600), 3, True)).otherwise(False))
    return F.coalesce(remaining <= 1, F.lit(False)) | F.coalesce(by_sport, F.lit(False))


def expected_seconds(kind: Column) -> Column:
    return lookup(kind, BREAK_SECONDS)


SET_BREAK_MS = 600_000


def breaks(history: DataFrame) -> DataFrame:
    """``history`` with ``pause_source`` (feed, clock, null), ``pause_started`` and ``pause_type`` of the break that holds at each report.

    Reports: ``event_id, bk, at, uid`` (orders reports of one time), ``sport, competition, period, clock, remaining, score_key, progress_key,
    games`` (both sides together), ``status, flag, clock_running, market_open, finished``.

    A break told by the feed lasts while it tells so; the report after it is none. A break seen from the clock is a latch. It is set where
    the clock has stood for the sport's time at a period's end and the score has not moved since (tennis: a set after the first began
    less than ten minutes ago without a game and nothing moved), the market is open and nothing reports play; it is reset by the first report of
    play, or by one after which clock, score or (tennis) games have moved, whatever the market and the time do. Reports of a feed's break leave the latch as
    it is, but what moves meanwhile counts at the next report. A tennis break that was set although something had moved after the set began ends with the next report and may
    be set by the one after. A finished event, or one without a state, ends any break and moves nothing. So the state of the latch is that of the last set or reset, turned over by
    the reports since that would do both; its start is the first report at which it stands.
    """
    w = Window.partitionBy("event_id", "bk").orderBy("at", "uid")
    earlier, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda c, frame=upto: F.last(c, ignorenulls=True).over(frame)
    on = lambda c: F.coalesce(c, F.lit(False))
    text = says_break(F.col("status"))
    out = history.withColumns({"_ended": on(F.col("finished")), "_feed": ~on(F.col("finished")) & (on(F.col("flag")) | on(text))})
    out = out.withColumn("_plays", (F.col("flag") == F.lit(False)) | (text == F.lit(False)) | F.col("clock_running")).withColumn("_plays", on(F.col("_plays")) & ~F.col("_feed"))
    # what moved, against the report before that stated it; keys that a report lacks are a value of their own
    stated = {"clock": F.coalesce(F.col("clock"), -F.col("remaining")), "period": F.col("period"), "score": F.coalesce("score_key", F.lit("")), "progress": F.coalesce("progress_key", F.lit(""))}
    for name, c in stated.items():
        own = F.when(~F.col("_ended"), c)
        before = latest(own, earlier)
        out = out.withColumn(f"_{name}_new", own.isNotNull() & (before.isNull() | (before != own))).withColumn(f"_{name}_at", latest(F.when(F.col(f"_{name}_new"), F.col("at"))))
    tennis = F.col("sport") == "tennis"
    moved_at = F.greatest("_clock_at", "_score_at", F.when(tennis, F.col("_progress_at")))
    out = out.withColumn("_moved", (F.col("_clock_new") | F.col("_score_new") | (tennis & F.col("_progress_new"))).cast("int")).withColumn("_moves", F.sum("_moved").over(upto))
    plain = ~F.col("_feed") & ~F.col("_ended")
    # of the plain report before: how much had moved, and (tennis) whether anything had since the set began
    out = out.withColumn("_before", latest(F.when(plain, F.struct("_moves", on(tennis & (moved_at > F.col("_period_at"))).alias("late"))), earlier))
    patience = lookup(F.col("sport"), STANDSTILL_SECONDS) * 1000
    fresh = (F.coalesce("games", F.lit(0)) == 0) & (F.col("period") > 1) & (F.col("at") - F.greatest("_period_at", "_progress_at") >= patience) & (F.col("at") - F.col("_period_at") < SET_BREAK_MS)
    stood = (F.col("at") - F.col("_clock_at") >= patience) & (F.col("_score_at") <= F.col("_clock_at")) & at_boundary(F.col("sport"), F.col("period"), F.col("clock"), F.col("remaining"), F.col("competition"))
    sets = plain & F.col("market_open") & ~F.col("_plays") & ~on(F.lag("_feed").over(w)) & on(F.when(tennis, fresh).otherwise(stood))
    resets = F.col("_ended") | (plain & (F.col("_plays") | on(F.col("_moves") > F.col("_before._moves")) | on(F.col("_before.late"))))
    out = out.withColumns({"_set": sets, "_reset": resets}).withColumn("_turns", F.sum((F.col("_set") & F.col("_reset")).cast("int")).over(upto))
    known = latest(F.when(F.col("_set") != F.col("_reset"), F.struct("_set", "_turns")))
    out = out.withColumn("_known", known).withColumn("_stands", (on(F.col("_known._set")).cast("int") + F.col("_turns") - F.coalesce(F.col("_known._turns"), F.lit(0))) % 2 == 1)
    kind = pause_type(F.col("sport"), F.col("status"), F.col("period"), F.col("clock"), F.col("competition"))
    begins = F.when(F.col("_stands") & ~on(F.lag("_stands").over(w)), F.struct(F.when(tennis, F.col("_period_at")).otherwise(F.col("_clock_at")).alias("at"), kind.alias("kind")))
    told = F.when(F.col("_feed") & ~on(F.lag("_feed").over(w)), F.struct("at", kind.alias("kind")))
    out = out.withColumns({"_clock_break": latest(begins), "_feed_break": latest(told)})
    source = F.when(F.col("_stands"), "clock").when(F.col("_feed"), "feed")
    held = F.when(source == "clock", F.col("_clock_break")).when(source == "feed", F.col("_feed_break"))
    return out.select(*history.columns, source.alias("pause_source"), held["at"].alias("pause_started"), held["kind"].alias("pause_type"))


def swap_score(score: Column) -> Column:
    """A pair of home and away values in the other order."""
    return F.struct(score["a"].alias("h"), score["h"].alias("a"))
