"""Whole fetches: which issue is told where, and that one issue rejects all."""

import json

import pytest

from oddsloom.operators import structure
from oddsloom.sources import feeds

GOOD = {"bookmaker": "fortuna", "strategy": "t", "scope": "prematch", "fetchedAt": 1_000_000, "events": [
    {"sourceId": "1", "sport": "football", "competition": "", "home": "A", "away": "B", "startTime": 2_000_000.0, "live": False, "state": {"period": 1, "score": [0, 2], "periodScores": [[0, 1], [0, 1]]},
     "markets": [{"key": "OU|REG|2.5", "open": True, "selections": [{"key": "OVER", "odds": 1.9, "open": True}]}], "more": 1}]}


def changed(event=None, **fetch):
    own = json.loads(json.dumps(GOOD)) | fetch
    if event:
        own["events"][0] |= event
    return json.dumps(own)


SELECTION = "events.0.markets.0.selections.0"
CASES = [
    (json.dumps(GOOD), None),
    (None, ": no JSON"),
    ("", ": no JSON"),
    ("[]", ": Invalid input: expected object, received array"),
    ("null", ": Invalid input: expected object, received null"),
    (changed(scope="x", fetchedAt=0, events={}), 'scope: Invalid option: expected one of "prematch"|"live"; fetchedAt: Too small: expected number to be >0; events: Invalid input: expected array, received object'),
    (changed({"sourceId": "", "home": None, "startTime": 1.5, "url": 3}), "events.0.sourceId: Too small: expected string to have >=1 characters; events.0.home: Invalid input: expected string, received null; events.0.startTime: Invalid input: expected int, received number; events.0.url: Invalid input: expected string, received number"),
    (changed({"state": {"period": 21, "score": [1, 2, 3], "games": 4, "z": 1}}), 'events.0.state.period: Too big: expected number to be <=20; events.0.state.score: Too big: expected array to have <=2 items; events.0.state.games: Invalid input: expected tuple, received number; events.0.state: Unrecognized key: "z"'),
    (changed({"markets": [{"key": "OU|REG", "open": True, "selections": []}]}), "events.0.markets.0.key: invalid canonical market key; events.0.markets.0.selections: Too small: expected array to have >=1 items"),
    (changed({"markets": [{"key": "1X2|REG", "open": True, "selections": [{"key": "HOME", "odds": "2", "rawName": None}]}]}), f"{SELECTION}.odds: Invalid input: expected number, received string; {SELECTION}.rawName: Invalid input: expected string, received null"),
    (changed(events=[3] * 7), "; ".join(f"events.{i}: Invalid input: expected object, received number" for i in range(5))),
]


@pytest.fixture(scope="module")
def fetches(spark):
    rows = [(i, t, "kept") for i, (t, _) in enumerate([*CASES, CASES[0]])]
    return spark.createDataFrame(rows, "n long, payload string, _k string")


def test_first_five_issues_by_place(fetches):
    got = {r.n: r for r in structure.judged(fetches, "payload").collect()}
    for n, (_, wanted) in enumerate(CASES):
        assert got[n].error == (wanted and f"schema: {wanted}"), n
        assert got[n].ok is (wanted is None) and got[n]["_k"] == "kept"
    assert got[len(CASES)].ok and structure.judged(fetches.limit(0), "payload").count() == 0


def test_one_issue_rejects_the_whole_fetch(fetches):
    rows = structure.whole(fetches, "payload", feeds.FETCH).select("n", "fetch.*").drop("_corrupt_record")
    assert sorted(r.n for r in rows.select("n").collect()) == [0, len(CASES)]
    assert [(r.sel, r.odds, r.is_open) for r in feeds.flat_quotes(rows).collect()] == [("OVER", 1.9, True)] * 2


def test_plain_values_have_no_issue(spark):
    """Every event is judged alike with and without the cheap condition, whatever is changed, missing or added anywhere in it."""
    good = GOOD["events"][0] | {"country": "C", "url": "u", "state": {"statusText": "s", "period": 1, "score": [0, 2], "periodScores": [[0, 1], [1, 2.0]]}}
    good.pop("more")
    market = good["markets"][0]
    values = [None, 3, 1.5, -1, "", "x", True, [], {}, ["x"], [None], [[1]], "1.9", "OVER", 1e300]
    events = [good, {k: v for k, v in good.items() if k != "state"}]
    events += [good | {k: v} for k in [*good, "other"] for v in values] + [{k: v for k, v in good.items() if k != gone} for gone in good]
    events += [good | {"markets": [market, market | {k: v}]} for k in [*market, "rawName", "other"] for v in values]
    selection = market["selections"][0]
    events += [good | {"markets": [market, market | {"selections": [selection, own]}]} for own in [*({**selection, k: v} for k in [*selection, "rawName"] for v in values), *({k: v for k, v in selection.items() if k != gone} for gone in selection)]]
    events += [good | {"state": good["state"] | {k: v}} for k in ("period", "score", "periodScores", "z") for v in values]
    event = structure.event_rule()
    rows = spark.createDataFrame([(json.dumps(e),) for e in events], "payload string").repartition(4).selectExpr("payload", "try_parse_json(payload) AS v")
    rows = rows.withColumn("t", structure.F.when(~rows.payload.contains("null"), structure.F.from_json("payload", event.ddl)))
    got = rows.select("payload", event(rows.v).alias("walked"), event.plain(rows.v, structure.F.col("t")).alias("plain")).collect()
    assert len(got) == len(events) and not [r.payload for r in got if r.plain and r.walked]
    assert sum(r.plain for r in got) > 30 and all(r.plain for r in got if r.payload == json.dumps(good))
