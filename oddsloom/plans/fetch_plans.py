"""Whole fetches made from ``orders`` and ``lineitem`` with planted faults: an order is an event, a line a market, a customer a fetch.

The SQL never sees a payload: it tells each planted fault from the rows, in order of place.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure
from ..sources import feeds
from . import bindings as B

# fault: when it is planted. The texts below and the SQL both go by these.
_E = {"id": "o_orderkey % 291 = 0", "sport": "o_orderkey % 267 = 1", "away": "o_orderkey % 249 = 2", "start": "(o_orderkey % 237 = 3 OR o_custkey % 17 = 5)", "part": "o_orderkey % 237 = 4",
      "live": "o_orderkey % 219 = 5", "period": "o_orderkey % 213 = 6", "score": "o_orderkey % 213 = 7", "other": "o_orderkey % 213 = 8"}
_M = {"key": "l_partkey % 335 = 9", "open": "l_partkey % 305 = 10", "none": "l_partkey % 295 = 11", "odds": "l_partkey % 265 = 12", "sel": "l_partkey % 235 = 13"}
_F = {"book": "o_custkey % 29 = 1", "text": "o_custkey % 31 = 3", "events": "o_custkey % 37 = 4"}

_MARKET = f"""concat('{{"key":"OU|REG', CASE WHEN {_M["key"]} THEN '' ELSE '|2.5' END, '","open":', CASE WHEN {_M["open"]} THEN '1' ELSE 'true' END, ',"selections":[',
  CASE WHEN {_M["none"]} THEN '' ELSE concat('{{"key":"OVER","open":true,"odds":', CASE WHEN {_M["odds"]} THEN '"1.9"' ELSE '1.9' END, '}},{{"odds":2,"open":false,"key":"', CASE WHEN {_M["sel"]} THEN 'MAYBE' ELSE 'UNDER' END, '"}}') END, ']}}')"""
_EVENT = f"""concat('{{"sourceId":"', CASE WHEN {_E["id"]} THEN '' ELSE CAST(o_orderkey AS STRING) END, '","sport":"', CASE WHEN {_E["sport"]} THEN 'chess' ELSE 'football' END, '","competition":"L","home":"A",', CASE WHEN {_E["away"]} THEN '' ELSE '"away":"B",' END,
  '"startTime":', CASE WHEN {_E["start"]} THEN '0' WHEN {_E["part"]} THEN '1.5' ELSE '1000' END, ',"live":', CASE WHEN {_E["live"]} THEN 'null' ELSE 'false' END,
  CASE WHEN {_E["period"]} THEN ',"state":{{"period":30}}' WHEN {_E["score"]} THEN ',"state":{{"score":[1]}}' WHEN {_E["other"]} THEN ',"state":{{"b":1,"a":2}}' ELSE '' END, ',"markets":[', markets, ']}}')"""


def _fetches(spark, d):
    """(key, text): the payload of each customer, events by order number, markets by line."""
    lines = B.read(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr(_MARKET).alias("text")).alias("m"))
    joined = lambda rows, name: F.array_join(F.transform(F.array_sort(F.collect_list(name)), lambda x: x["text"]), ",")
    markets = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(joined(lines, "m").alias("markets"))
    events = B.read(spark, d, "orders").select("o_orderkey", "o_custkey").join(markets, "o_orderkey").withColumn("e", F.struct("o_orderkey", F.expr(_EVENT).alias("text")))
    packed = events.groupBy("o_custkey").agg(joined(events, "e").alias("events"))
    head = F.concat(F.lit('{"bookmaker":"'), F.expr(f"CASE WHEN {_F['book']} THEN 'nobody' ELSE 'fortuna' END"), F.lit('","strategy":"t","scope":"live","fetchedAt":5'))
    own = F.expr(f"CASE WHEN {_F['events']} THEN '' ELSE concat(',\"events\":[', events, ']') END")
    return packed.select(F.col("o_custkey").alias("key"), F.concat(head, own, F.expr(f"CASE WHEN {_F['text']} THEN '' ELSE '}}' END")).alias("text"))


def fetch_issues(spark, d):
    """Each fetch, whether it is whole, and its first five issues."""
    return structure.judged(_fetches(spark, d), "text").select("key", "ok", "error")


def whole_fetches(spark, d):
    """The selections of fetches without any issue."""
    fetches = structure.whole(_fetches(spark, d), "text", feeds.FETCH.replace(", _corrupt_record string", ""))
    rows = feeds.flat_quotes(fetches.select("fetch.*"))
    return rows.select("sourceId", "market", "sel", "odds", "is_open")


def _issues() -> str:
    option = lambda values: "Invalid option: expected one of " + "|".join(f'"{x}"' for x in values)
    event = [
        ("id", 0, "sourceId", "Too small: expected string to have >=1 characters"), ("sport", 1, "sport", option(structure.SPORTS)), ("away", 5, "away", "Invalid input: expected string, received undefined"),
        ("start", 6, "startTime", "Too small: expected number to be >0"), ("part", 6, "startTime", "Invalid input: expected int, received number"), ("live", 7, "live", "Invalid input: expected boolean, received null"),
        ("period", 8, "state.period", "Too big: expected number to be <=20"), ("score", 8, "state.score", "Too small: expected array to have >=2 items"), ("other", 8, "state", 'Unrecognized keys: "a", "b"')]
    market = [
        ("key", 0, 0, "key", "invalid canonical market key"), ("open", 1, 0, "open", "Invalid input: expected boolean, received number"), ("none", 2, 0, "selections", "Too small: expected array to have >=1 items"),
        ("odds", 2, 0, "selections.0.odds", "Invalid input: expected number, received string"), ("sel", 2, 1, "selections.1.key", option(structure.SELECTIONS))]
    seen = f"{_F['text']} OR {_F['events']}"
    parts = [f"SELECT o_custkey AS key, -2 AS e, 0 AS f, 0 AS m, 0 AS g, 0 AS s, ': no JSON' AS told FROM k WHERE {_F['text']}"]
    parts += [f"SELECT o_custkey, -1, 0, 0, 0, 0, 'bookmaker: {option(structure.BOOKS)}' FROM k WHERE {_F['book']} AND NOT ({_F['text']})"]
    parts += [f"SELECT o_custkey, 0, 0, 0, 0, 0, 'events: Invalid input: expected array, received undefined' FROM k WHERE {_F['events']} AND NOT ({_F['text']})"]
    parts += [f"SELECT o_custkey, e, {f}, 0, 0, 0, 'events.' || e || '.{name}: {message}' FROM ev WHERE {_E[fault]} AND NOT ({seen})" + (f" AND NOT {_E['start']}" if fault == "part" else "") for fault, f, name, message in event]
    none = f" AND NOT ({_M['none']})"
    parts += [f"SELECT o_custkey, e, 9, m, {g}, {s}, 'events.' || e || '.markets.' || m || '.{name}: {message}' FROM li WHERE {_M[fault]} AND NOT ({seen})" + (none if name.startswith("selections.") else "") for fault, g, s, name, message in market]
    return " UNION ALL ".join(parts)


_BASE = f"""WITH ev AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS e FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
k AS (SELECT DISTINCT o_custkey FROM ev),
li AS (SELECT o_custkey, o_orderkey, e, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS m FROM lineitem JOIN ev ON l_orderkey = o_orderkey),
i AS ({_issues()})"""
_SQL_ISSUES = f"""{_BASE},
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY e, f, m, g, s) AS n FROM i),
t AS (SELECT key, 'schema: ' || string_agg(told, '; ' ORDER BY n) AS error FROM n WHERE n <= 5 GROUP BY key)
SELECT o_custkey AS key, error IS NULL AS ok, error FROM k LEFT JOIN t ON key = o_custkey"""
_SQL_WHOLE = f"""{_BASE}
SELECT CAST(o_orderkey AS VARCHAR) AS "sourceId", 'OU|REG|2.5' AS market, sel, CAST(odds AS DOUBLE) AS odds, is_open
FROM li CROSS JOIN (VALUES ('OVER', 1.9, true), ('UNDER', 2, false)) AS v(sel, odds, is_open) WHERE o_custkey NOT IN (SELECT key FROM i)"""

QUERIES = {"fetch_issues": (fetch_issues, _SQL_ISSUES), "whole_fetches": (whole_fetches, _SQL_WHOLE)}
