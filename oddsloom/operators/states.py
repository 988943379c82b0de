"""State of play from what feeds state: texts, clocks, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_up, lookup

# Words of a status text that say the play is stopped or over, and sports whose feeds state no game time.
BREAK_TEXT = r"(?iu)^poločas$|přestávk|pauza|^konec \d|po \d\. (třetin|čtvrtin|set)|break|half ?time|intermission"
OVER_TEXT = r"(?iu)konec zápasu|ukončen|skončen|^konec$|finished|ended"
PERIOD_TEXT = r"(?iu)(\d+)\.\s*(poločas|třetin|čtvrtin|set|perioda|prodl|směn)"
ORDINAL_TEXT = r"(?iu)^(první|druhá|třetí)\s+přestávka"
ORDINALS = {
    "první": 1,
    "druhá": 2,
    "třetí": 3,
}
UNTIMED = ("tennis", "table_tennis", "volleyball", "darts", "snooker", "baseball", "american_football", "mma", "boxing")
LONGEST_CLOCK, LONGEST_PERIOD = 14_400, 3_600


def text_period(text: Column) -> Column:
    """Number of the period that a status text names."""
    named = F.regexp_extract(text, PERIOD_TEXT, 1).try_cast("int")
    return F.coalesce(named, lookup(F.lower(F.regexp_extract(text, ORDINAL_TEXT, 1)), ORDINALS))


def text_states(rows: DataFrame) -> DataFrame:
    """Adds ``period, break_flag, finished, clock_s, remaining_s, clock_running`` from ``sport, status, live_time, playtime_ms,
    timer_at, timer_paused, counts_down, now``.

    A running timer is carried on to ``now``; without a timer the minute of ``live_time`` counts, in sports that have one.
    """
    status = F.trim(F.coalesce(F.when(F.col("status") != "", F.col("status")), F.col("live_time"), F.lit("")))
    stopped = status.rlike(BREAK_TEXT)
    timed = F.col("playtime_ms").isNotNull()
    running = timed & (F.col("timer_paused") == F.lit(False))
    drift = F.when(F.coalesce(running, F.lit(False)) & (F.col("now") > F.col("timer_at")), F.col("now") - F.col("timer_at")).otherwise(0)
    down = F.coalesce(F.col("counts_down"), F.lit(False))
    clamp = lambda ms, most: F.least(F.lit(most), F.greatest(F.lit(0), half_up(ms / 1000).cast("long")))
    minute = F.regexp_extract(F.coalesce(F.col("live_time"), F.lit("")), r"^(\d+)'", 1).try_cast("long")
    by_text = F.when(~F.col("sport").isin(*UNTIMED), F.least(F.lit(LONGEST_CLOCK), minute * 60))
    return rows.withColumns({
        "period": text_period(status),
        "break_flag": stopped,
        "finished": status.rlike(OVER_TEXT),
        "clock_s": F.when(timed & ~down, clamp(F.col("playtime_ms") + drift, LONGEST_CLOCK)).when(~timed, by_text),
        "remaining_s": F.when(timed & down, clamp(F.col("playtime_ms") - drift, LONGEST_PERIOD)),
        "clock_running": F.when(stopped, False).when(timed, F.coalesce(running, F.lit(False))),
    })


def swapped_state(state: Column) -> Column:
    """A state with home and away changed: ``score`` and ``games`` (arrays of two), ``points`` (``a:b``), ``periods`` (array of both)."""
    turn = lambda pair: F.when(F.size(pair) == 2, F.array(F.element_at(pair, 2), F.element_at(pair, 1))).otherwise(pair)
    points = F.regexp_replace(state["points"], "^([^:]*):([^:]*)$", "$2:$1")
    return F.struct(turn(state["score"]).alias("score"), turn(state["games"]).alias("games"), points.alias("points"), F.transform(state["periods"], turn).alias("periods"))


def set_complete(home: Column, away: Column) -> Column:
    """Whether the games of a set decide it: two ahead with six, or seven to at least five."""
    high, low = F.greatest(home, away), F.least(home, away)
    return ((high >= 6) & (high - low >= 2)) | ((high == 7) & (low >= 5))


# Where periods of a clock that counts up begin, in seconds from the start of the match.
PERIOD_BASES = {
    "football": {"SECOND_HALF": 2700, "FIRST_HALF_EXTRA_TIME": 5400, "FIRST_OVERTIME": 5400, "SECOND_HALF_EXTRA_TIME": 6300, "SECOND_OVERTIME": 6300},
    "handball": {"SECOND_HALF": 1800, "FIRST_OVERTIME": 3600, "SECOND_OVERTIME": 3900},
}
COUNT_DOWN = ("hockey", "basketball", "american_football")
RUNNING = ("RUNNING", "COUNTING_DOWN", "COUNTING_UP")


def clock_seconds(sport: Column, period: Column, offset_s: Column, clock_state: Column, updated_at: Column, now: Column) -> dict[str, Column]:
    """``clock_s`` or ``remaining_s`` of a clock stated as an offset in its period, carried on since its last update if it runs."""
    since = F.when(clock_state.isin(*RUNNING) & (now > updated_at), (now - updated_at) / 1000.0).otherwise(0.0)
    base = F.coalesce(lookup(F.concat_ws(":", sport, period), {f"{s}:{p}": v for s, own in PERIOD_BASES.items() for p, v in own.items()}), F.lit(0))
    down = sport.isin(*COUNT_DOWN)
    return {
        "clock_s": F.when(~down & sport.isin(*PERIOD_BASES), half_up(base + offset_s + since).cast("long")),
        "remaining_s": F.when(down, F.greatest(F.lit(0), half_up(offset_s - since).cast("long"))),
    }


def period_number(kind: Column, index: Column) -> Column:
    """Ordinal of a period: from a type like ``INNINGS_3``, else as stated."""
    return F.coalesce(F.regexp_extract(kind, r"^INNINGS?_(\d+)$", 1).try_cast("int"), index)
