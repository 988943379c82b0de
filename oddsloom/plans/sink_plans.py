"""Tables that batches wrote, some of them twice and some out of order, read back: over ``lineitem`` and ``orders``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..stored import shared_dir
from ..streaming import sinks
from . import bindings as B

_CHANGES = {**{c: B.QUOTES[1][c] for c in ("event_id", "bk", "market", "sel", "odds")}, "at": "(l_partkey % 12) * 86400000 + l_orderkey * 7919 % 86400000", "line": "l_orderkey * 10 + l_linenumber"}
_BATCHES = (0, 1, 3, 1, 2, 3)  # as they come: two of them again
_TODAY, _KEEP, _SINCE = "1970-01-12", 8, "1970-01-06"


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def sunk_changes(spark, d):
    """Changes of the last days, out of a table by day from which old days are dropped."""
    rows = B.relation(spark, d, ("lineitem", _CHANGES))
    path = _place(spark, "changes")
    for n in _BATCHES:
        sinks.append(rows.where(F.col("line") % 4 == n), n, path, "at")
    sinks.drop_old(spark, path, _TODAY, _KEEP)
    return sinks.days(spark, path, rows.schema, since=_SINCE).drop("event_id", "sel")


def kept_days(spark, d):
    """Rows of each day that retention left."""
    rows = B.relation(spark, d, ("lineitem", _CHANGES)).select("at", "line")
    path = _place(spark, "changes")
    for n in _BATCHES:
        sinks.append(rows.where(F.col("line") % 4 == n), n, path, "at")
    sinks.drop_old(spark, path, _TODAY, _KEEP)
    return sinks.days(spark, path, rows.schema).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def sunk_arbs(spark, d):
    """Opportunities as their inserts, heartbeats and ends leave them: an end or heartbeat may be written before the insert, a second insert changes nothing."""
    a = B.relation(spark, d, B.ARBS)
    columns = "arb_id", "kind", "at", "first_seen", "last_seen", "sport", "end_reason", "n"
    row = lambda df, **own: df.select(*[F.expr(own[c]).alias(c) for c in columns])
    inserts = row(a.where("arb_id % 19 <> 0"), arb_id="arb_id", kind="'insert'", at="first_seen", first_seen="first_seen", last_seen="first_seen", sport="sport", end_reason="CAST(NULL AS STRING)", n="arb_id % 3")
    again = row(a.where("arb_id % 13 = 0 AND arb_id % 19 <> 0"), arb_id="arb_id", kind="'insert'", at="first_seen", first_seen="first_seen + 1", last_seen="first_seen", sport="'again'", end_reason="'again'", n="CAST(5 AS BIGINT)")
    none = {"first_seen": "CAST(NULL AS BIGINT)", "sport": "CAST(NULL AS STRING)"}
    ends = row(a.where("end_reason IS NOT NULL"), arb_id="arb_id", kind="'update'", at="last_seen", last_seen="CAST(NULL AS BIGINT)", end_reason="end_reason", n="CAST(1 AS BIGINT)", **none)
    beats = row(B.relation(spark, d, B.ACTIONS), arb_id="arb_id", kind="'update'", at="ts", last_seen="ts", end_reason="CAST(NULL AS STRING)", n="uid % 4", **none)
    rows = inserts.unionByName(again).unionByName(ends).unionByName(beats)
    path = _place(spark, "arbs")
    for n in (3, 0, 5, 1, 2, 1):
        sinks.log(rows.where(F.col("n") == n), n, path)
    return sinks.current(sinks.logged(spark, path, rows.schema), ["arb_id"], "at", ["first_seen", "last_seen", "sport", "end_reason"], ["last_seen", "end_reason"])


_DAY = "strftime(make_timestamp(\"at\" * 1000), '%Y-%m-%d')"
_OLD = "1970-01-04"  # the first day that is not more than 8 days before
_SQL_CHANGES = f"""WITH c AS ({B.sql(("lineitem", _CHANGES))})
SELECT bk, market, odds, "at", line, {_DAY} AS day FROM c WHERE {_DAY} >= '{_SINCE}'"""
_SQL_DAYS = f"""WITH c AS ({B.sql(("lineitem", _CHANGES))}) SELECT {_DAY} AS day, count(*) AS n FROM c WHERE {_DAY} >= '{_OLD}' GROUP BY 1"""
_SQL_ARBS = f"""WITH a AS ({B.sql(B.ARBS)}), b AS ({B.sql(B.ACTIONS)}),
r AS (SELECT arb_id, ts, row_number() OVER (PARTITION BY arb_id ORDER BY uid % 4 DESC, ts DESC) AS n FROM b)
SELECT a.arb_id, first_seen, coalesce(ts, first_seen) AS last_seen, sport, end_reason FROM a LEFT JOIN r ON r.arb_id = a.arb_id AND n = 1 WHERE a.arb_id % 19 <> 0"""

QUERIES = {"sunk_changes": (sunk_changes, _SQL_CHANGES), "kept_days": (kept_days, _SQL_DAYS), "sunk_arbs": (sunk_arbs, _SQL_ARBS)}
