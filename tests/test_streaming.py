import json
import random

import pytest

from oddsloom.domain import Settings
from oddsloom.plans import catalog
from oddsloom.streaming import book_state, lifecycle

NOW = 1_000_000


def machine(mode="PREMATCH", sport="football", **settings):
    m = lifecycle.EventMachine(Settings(consensus_books=5, **settings))
    m.handle("event", {"sport": sport, "mode": mode, "start": NOW * 10, "finished": False}, NOW)
    return m


def quotes(bk, at, *rows, seen=None):
    return "quotes", {"bk": bk, "seen_at": seen or at, "quotes": [[m, s, o, True, at] for m, s, o in rows]}, at


DNB = "DNB|REG"


def test_new_update_end():
    m = machine()
    assert m.handle(*quotes(0, NOW, (DNB, "HOME", 2.2), (DNB, "AWAY", 1.7))) == []
    (new,) = m.handle(*quotes(1, NOW, (DNB, "HOME", 1.7), (DNB, "AWAY", 2.2)))
    assert new["change"] == "new" and new["margin"] == pytest.approx(10) and new["group_key"] == DNB
    assert m.handle(*quotes(1, NOW + 500, (DNB, "HOME", 1.7), (DNB, "AWAY", 2.3)))[0]["change"] == "update"
    (end,) = m.handle(*quotes(1, NOW + 900, (DNB, "HOME", 1.7), (DNB, "AWAY", 1.6)))
    assert end["end_reason"] == "leg_odds_changed:fortuna" and end["max_margin"] > 10


def test_suspended_and_removed():
    for message in (("removed", {"bk": 1}, NOW + 5), ("quotes", {"bk": 1, "seen_at": NOW + 5, "quotes": [[DNB, "AWAY", 2.2, False, NOW]]}, NOW + 5)):
        m = machine()
        m.handle(*quotes(0, NOW, (DNB, "HOME", 2.2)))
        m.handle(*quotes(1, NOW, (DNB, "AWAY", 2.2)))
        assert [r["end_reason"] for r in m.handle(*message)] == ["suspended"]


def test_one_book_makes_no_arb_and_second_best_is_not_tried():
    m = machine()
    assert m.handle(*quotes(0, NOW, (DNB, "HOME", 2.2), (DNB, "AWAY", 2.2))) == []
    assert m.handle(*quotes(1, NOW, (DNB, "HOME", 2.1), (DNB, "AWAY", 2.1))) == []


def test_across_markets():
    m = machine()
    m.handle(*quotes(0, NOW, ("1X2|REG", "HOME", 2.6), ("1X2|REG", "DRAW", 3.0), ("1X2|REG", "AWAY", 2.0)))
    (new,) = m.handle(*quotes(1, NOW, ("DC|REG", "DRAW_AWAY", 1.75)))
    assert new["group_key"] == "H_DA|REG" and new["margin"] == pytest.approx((1 / (1 / 2.6 + 1 / 1.75) - 1) * 100)
    m = machine()
    m.handle(*quotes(0, NOW, (DNB, "HOME", 2.2)))
    (new,) = m.handle(*quotes(1, NOW, ("AH|REG|0", "AWAY", 2.1)))
    assert new["group_key"] == DNB and "AH|REG|0" in new["combo"]


def test_confirmation_counts_from_first_sight():
    m = machine("LIVE")
    m.handle(*quotes(0, NOW, (DNB, "HOME", 2.2)))
    assert m.handle(*quotes(1, NOW, (DNB, "AWAY", 2.2))) == []
    assert m.handle("sweep", {}, NOW + 1000) == []
    (new,) = m.handle("sweep", {}, NOW + 1600)
    assert new["first_seen"] == NOW and new["at"] == NOW + 1600
    short = machine("LIVE")
    short.handle(*quotes(0, NOW, (DNB, "HOME", 2.2)))
    short.handle(*quotes(1, NOW, (DNB, "AWAY", 2.2)))
    short.handle(*quotes(1, NOW + 500, (DNB, "AWAY", 1.5)))
    assert short.handle("sweep", {}, NOW + 1600) == []


def test_in_play_legs_must_be_confirmed_after_the_last_change():
    m = machine("LIVE", modes=Settings().merged({"modes": {"LIVE": {"confirm_ms": 0}}}).modes)
    m.handle(*quotes(0, NOW - 1000, (DNB, "HOME", 2.2)))
    assert m.handle(*quotes(1, NOW, (DNB, "AWAY", 2.2))) == []
    assert [r["change"] for r in m.handle("seen", {"bk": 0, "seen_at": NOW + 100}, NOW + 100)] == ["new"]


def test_stale_started_and_mode_changes():
    m = machine("LIVE", modes=Settings().merged({"modes": {"LIVE": {"confirm_ms": 0}}}).modes)
    m.handle(*quotes(0, NOW, (DNB, "HOME", 2.2)))
    m.handle(*quotes(1, NOW, (DNB, "AWAY", 2.2)))
    m.handle("seen", {"bk": 1, "seen_at": NOW + 4000}, NOW + 4000)
    assert [r["end_reason"] for r in m.handle("sweep", {}, NOW + 6000)] == ["stale:tipsport"]
    for before, after, reason in (("PREMATCH", "LIVE", "event_started"), ("LIVE", "PAUSED", "pause_started"), ("PAUSED", "LIVE", "pause_ended"), ("LIVE", "PREMATCH", "event_finished")):
        free = Settings().merged({"modes": {k: {"confirm_ms": 0} for k in ("LIVE", "PAUSED")}}).modes
        m = machine(before, modes=free)
        m.handle(*quotes(0, NOW, (DNB, "HOME", 2.2)))
        m.handle(*quotes(1, NOW, (DNB, "AWAY", 2.2)))
        out = m.handle("event", {"sport": "football", "mode": after, "start": NOW * 10, "finished": False}, NOW + 10)
        assert out[0]["end_reason"] == reason


def test_outliers_are_left_out():
    m = lifecycle.EventMachine(Settings())
    m.handle("event", {"sport": "football", "mode": "PREMATCH", "start": NOW * 10, "finished": False}, NOW)
    for bk in (1, 2, 3):
        m.handle(*quotes(bk, NOW, (DNB, "HOME", 1.8), (DNB, "AWAY", 1.9)))
    assert m.handle(*quotes(0, NOW, (DNB, "HOME", 5.0))) == []


def test_similar_combination_is_not_new():
    m = machine()
    m.handle(*quotes(0, NOW, (DNB, "HOME", 2.2)))
    m.handle(*quotes(1, NOW, (DNB, "AWAY", 2.2)))
    assert m.handle(*quotes(2, NOW, (DNB, "AWAY", 2.2))) == []
    assert [r["change"] for r in m.handle(*quotes(2, NOW + 1, (DNB, "AWAY", 2.4)))] == ["new"]


MESSAGES = [
    (1, NOW, 0, "event", {"sport": "football", "mode": "PREMATCH", "start": NOW * 10, "finished": False}), (1, NOW, 1, *quotes(0, NOW, (DNB, "HOME", 2.2))[:2]), (1, NOW + 1, 2, *quotes(1, NOW, (DNB, "AWAY", 2.2))[:2]),
    (2, NOW, 3, "event", {"sport": "tennis", "mode": "PREMATCH", "start": NOW * 10, "finished": False}), (1, NOW + 9, 4, "removed", {"bk": 0})]
SCHEMA = "event_id long, at long, seq long, kind string, body string"


def replay(spark, rows, tmp_path, run, schema):
    """Feed rows as two files to a stream and give what it wrote."""
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = run(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_stream_equals_recorded(spark, tmp_path):
    rows = [(*r[:4], json.dumps(r[4])) for r in MESSAGES]
    want = sorted(map(str, lifecycle.recorded_opportunities(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert len(want) == 2 and replay(spark, rows, tmp_path, lifecycle.stream_opportunities, SCHEMA) == want


FETCH = "bk int, event_id long, scope string, fetched_at long, seq long, source_id string, quotes array<struct<market:string,sel:string,odds:double,is_open:boolean>>"


def fetch(seq, scope, at, *qs, source="a"):
    return (1, 7, scope, at, seq, source, [("ML|MATCH", s, o, True) for s, o in qs])


def test_book_state_rules():
    state, kinds = None, []
    for f in (
        fetch(0, "prematch", 100, ("HOME", 2.0), ("AWAY", 1.8)), fetch(1, "prematch", 200, ("HOME", 2.0), ("AWAY", 1.8)), fetch(2, "prematch", 300, ("HOME", 2.1)),
        fetch(3, "prematch", 250, ("HOME", 9.0)), fetch(4, "live", 400, ("HOME", 3.0)), fetch(5, "prematch", 500, ("HOME", 1.1)), fetch(6, "prematch", 70_000, ("HOME", 1.2))):
        row = dict(zip(("bk", "event_id", "scope", "fetched_at", "seq", "source_id"), f[:6], strict=True), quotes=[dict(zip(("market", "sel", "odds", "is_open"), q, strict=True)) for q in f[6]])
        state, rows = book_state.apply_fetch(state, row)
        kinds.append([r["kind"] for r in rows])
    assert kinds == [["added", "added"], [], ["changed", "removed"], [], ["changed"], [], ["changed"]]


def test_book_state_stream(spark, tmp_path):
    rows = [fetch(0, "prematch", 100, ("HOME", 2.0), ("AWAY", 1.8)), fetch(1, "prematch", 200, ("HOME", 2.1)), fetch(2, "live", 300, ("HOME", 2.1)), fetch(3, "live", 400)]
    want = sorted(map(str, book_state.recorded_changes(spark.createDataFrame(rows, FETCH)).collect()))
    assert len(want) == 5 and replay(spark, rows, tmp_path, book_state.stream_changes, FETCH) == want


def folded(rows):
    """Changes by ``apply_fetch``, fetch after fetch."""
    states, out = {}, []
    names = ("bk", "event_id", "scope", "fetched_at", "seq", "source_id")
    for f in sorted(rows, key=lambda f: f[4]):
        row = dict(zip(names, f[:6], strict=True), quotes=[dict(zip(("market", "sel", "odds", "is_open"), q, strict=True)) for q in f[6]])
        states[f[:2]], made = book_state.apply_fetch(states.get(f[:2]), row)
        out += [(*f[:2], *(r[c] for c in ("market", "sel", "kind", "odds", "is_open", "previous_odds", "at"))) for r in made]
    return out


def test_recorded_changes_equal_the_fold(spark):
    rng, rows = random.Random(5), []
    for seq in range(4000):
        at = seq // 40 * 20_000 + rng.randrange(-3, 4) * 20_000  # many of one time, many late
        quotes = [(rng.choice("MN"), rng.choice("HDA"), rng.choice((1.5, 2.0)), rng.choice((True, True, False, None))) for _ in range(rng.choice((0, 1, 3, 6)))]
        rows.append((rng.randrange(2), rng.randrange(4), rng.choice(("live", "prematch", "prematch", "other", None)), at, seq, rng.choice(("a", "a", "b", None)), quotes))
    want = sorted(map(str, folded(rows)))
    got = book_state.recorded_changes(spark.createDataFrame(rows, FETCH).repartition(5))
    assert sorted(str(tuple(r)) for r in got.collect()) == want and {w.split(", ")[4] for w in want} == {"'added'", "'changed'", "'removed'"}
    once = [r for i, r in enumerate(rows) if i % 9 == 0]
    timeless = [(*r[:3], None, *r[4:]) for r in rows if r[4] % 9 == 1]
    assert sorted(str(tuple(r)) for r in book_state.recorded_changes(spark.createDataFrame(once + timeless, FETCH)).collect()) == sorted(map(str, folded(once)))


def test_book_changes_is_one_shuffle_without_python(spark, sf):
    plan = catalog.queries()["book_changes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("Exchange") == 1
