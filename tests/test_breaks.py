"""Breaks that hold: reports in a row, and the break at each."""

from oddsloom.domain import BREAK_SECONDS
from oddsloom.operators import tracker

SCHEMA = "event_id long, bk int, uid long, at long, sport string, competition string, period int, clock int, remaining int, score_key string, progress_key string, games int, status string, flag boolean, clock_running boolean, market_open boolean, finished boolean"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def breaks(spark, sport, *reports):
    """(source, start, type) at each report, given as its time and what differs from a plain one."""
    plain = {"event_id": 1, "bk": 0, "sport": sport, "market_open": True, "finished": False}
    rows = [tuple((plain | {"uid": i, "at": at} | own).get(n) for n in NAMES) for i, (at, own) in enumerate(reports)]
    got = tracker.breaks(spark.createDataFrame(rows, SCHEMA)).orderBy("uid").collect()
    return [r.pause_source and (r.pause_source, r.pause_started, r.pause_type) for r in got]


def test_a_feed_tells_its_break(spark):
    told, plays = {"flag": True, "period": 1}, {"flag": False, "period": 2}
    kind = ("feed", 1_000, "hockey_intermission")
    assert breaks(spark, "hockey", (1_000, told), (3_000, told), (5_000, plays)) == [kind, kind, None]  # its start stays
    assert BREAK_SECONDS["hockey_intermission"] == 17 * 60
    pause = {"status": "Přestávka"}
    assert [breaks(spark, "basketball", (0, pause | {"period": p}))[0][2] for p in (2, 1)] == ["basketball_ht", "basketball_quarter"]


def test_a_clock_that_stands_at_a_periods_end(spark):
    st = {"clock": 2_700, "score_key": "1-0"}
    kind = ("clock", 0, "football_ht")
    # it holds until the clock moves, also while the market is closed
    assert breaks(spark, "football", (0, st), (20_000, st), (50_000, st), (800_000, st | {"market_open": False}), (900_000, st | {"clock": 2_705})) == [None, None, kind, kind, None]
    st = {"clock": 23 * 60 + 12, "score_key": "0-0"}
    assert breaks(spark, "hockey", (0, st), (120_000, st)) == [None, None]  # within a period


def test_a_clock_that_runs_down(spark):
    st = {"remaining": 0, "period": 1, "score_key": "22-18"}
    got = breaks(spark, "basketball", (0, {"remaining": 12, "period": 1, "score_key": "20-18"}), (12_000, st), (40_000, st), (60_000, st), (200_000, st | {"remaining": 598, "period": 2}))
    assert got == [None, None, None, ("clock", 12_000, "basketball_quarter"), None]


def test_a_running_clock_is_play(spark):
    st = {"clock": 2_700, "score_key": "1-0"}
    assert breaks(spark, "football", (0, st), (50_000, st | {"clock_running": True})) == [None, None]
    assert breaks(spark, "football", (0, st), (50_000, st), (60_000, st | {"clock_running": True}), (70_000, st)) == [None, ("clock", 0, "football_ht"), None, ("clock", 0, "football_ht")]


def test_a_feeds_break_over_the_clocks(spark):
    st = {"clock": 2_700, "score_key": "1-0"}
    kind = ("clock", 0, "football_ht")
    assert breaks(spark, "football", (0, st), (50_000, st), (60_000, st | {"flag": True}), (70_000, st)) == [None, kind, kind, kind]
    # what moved meanwhile counts at the next report
    assert breaks(spark, "football", (0, st), (50_000, st), (60_000, st | {"flag": True, "clock": 2_701}), (70_000, st | {"clock": 2_701})) == [None, kind, kind, None]
    assert breaks(spark, "football", (0, st), (50_000, st), (60_000, st | {"finished": True}), (70_000, st)) == [None, kind, None, kind]


def test_a_new_set_without_a_game(spark):
    new = {"period": 2, "games": 0, "score_key": "0", "progress_key": "0-0"}
    got = breaks(spark, "tennis", (0, {"period": 1, "games": 9, "score_key": "9", "progress_key": "40-15"}), (10_000, new), (45_000, new), (700_000, new), (760_000, new | {"progress_key": "15-0"}))
    kind = ("clock", 10_000, "tennis_set_break")
    assert got == [None, None, kind, kind, None]  # it outlasts ten minutes


def test_a_set_in_which_something_moved_late(spark):
    new = {"period": 2, "games": 0, "score_key": "0"}
    got = breaks(spark, "tennis", (0, {"period": 1, "games": 9, "score_key": "0"}), (10_000, new), (12_000, new | {"progress_key": "x"}), *[(t * 1_000, new | {"progress_key": "x"}) for t in (50, 60, 70, 80)])
    kind = ("clock", 10_000, "tennis_set_break")
    assert got == [None, None, None, kind, None, kind, None]
