"""Queries on reads of logs and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, reads
from . import bindings as B
from .quote_plans import BEST, LIMIT, SETTINGS, SPORTS, Q, _groups, _quotes
from .stat_plans import A

#: Settings as a user may change them, and the book turned off with them.
STRICTER = SETTINGS.merged({"modes": {"PREMATCH": {"min_margin": 20.0}, "PAUSED": {"min_margin": 30.0}, "LIVE": {"min_margin": 40.0}}})
STRICT_LIMIT = "CASE mode WHEN 'PREMATCH' THEN 20.0 WHEN 'PAUSED' THEN 30.0 ELSE 40.0 END"
OFF = 3
LOG_ROWS, SUBSCRIBED = 200, 150

_EVENT = "CASE uid % 5 WHEN 0 THEN 'probe' WHEN 1 THEN 'step_down' WHEN 2 THEN 'recovered' ELSE 'state' END"
_STATE = "CASE WHEN odds > 3.8 THEN 'BLOCKED' WHEN odds > 2.5 THEN 'DEGRADED' ELSE 'OK' END"


def health_log(spark, d):
    log = B.relation(spark, d, B.FEED).selectExpr("uid AS id", "fetched_at AS ts", "bk", f"{_EVENT} AS event", f"{_STATE} AS state")
    return reads.health_log(log, LOG_ROWS).select("id", "ts", F.col("bk").cast("long").alias("bk"), "event", "state")


def tick_pages(spark, d):
    f = B.relation(spark, d, B.FEED).select("market", "fetched_at", "uid", "odds")
    return reads.tick_pages(f, ["market"], "fetched_at", ["uid"]).withColumn("place", F.col("place").cast("long"))


def subscribed_matches(spark, d):
    m = B.relation(spark, d, B.ARBS).selectExpr("arb_id AS match_id", "sport", "first_seen AS start", "CASE WHEN arb_id % 7 > 1 THEN true WHEN arb_id % 7 = 1 THEN false END AS has_markets", "pair = 'betx|chance' AS skipped")
    return reads.subscriptions(m, ["football", "hockey", "tennis"], ["football", "hockey"], SUBSCRIBED).select("match_id", "sport", "start", F.col("tier").cast("long").alias("tier"))


def health_snapshot(spark, d):
    """Book 9 is known but sends nothing."""
    f = B.relation(spark, d, B.FEED)
    states = f.where("bk <> 9").selectExpr("bk", "CASE WHEN live THEN 'live' ELSE 'prematch' END AS scope", f"{_STATE} AS state", "fetched_at AS at", "uid")
    books = spark.range(10).select(F.col("id").cast("int").alias("bk"))
    out = reads.health_snapshot(books, states, f.selectExpr("bk", "NOT finished AS matched"), [OFF])
    return out.withColumn("bk", F.col("bk").cast("long"))


SNAPSHOT = f"""WITH f AS ({B.sql(B.FEED)}), n AS (SELECT *, row_number() OVER (PARTITION BY bk, live ORDER BY fetched_at DESC, uid DESC) AS rn FROM f),
w AS (SELECT bk, count(*) AS scopes, max(CASE {_STATE} WHEN 'BLOCKED' THEN 2 WHEN 'DEGRADED' THEN 1 ELSE 0 END) AS s FROM n WHERE rn = 1 GROUP BY bk),
c AS (SELECT bk, count(*) FILTER (NOT finished) AS matched, count(*) FILTER (finished) AS unmatched FROM f GROUP BY bk)
SELECT b.bk, CASE coalesce(s, 2) WHEN 2 THEN 'BLOCKED' WHEN 1 THEN 'DEGRADED' ELSE 'OK' END AS state, b.bk <> {OFF} AS enabled, coalesce(scopes, 0) AS scopes, coalesce(matched, 0) AS matched, coalesce(unmatched, 0) AS unmatched
FROM range(10) b(bk) LEFT JOIN w ON w.bk = b.bk LEFT JOIN c ON c.bk = b.bk"""


def settings_change(spark, d):
    """What runs under the usual settings, after the limits were raised and a book turned off."""
    q, groups = _quotes(spark, d), _groups(spark)
    active = detect.arbs(q, groups, SETTINGS, check_consensus=False)
    return reads.reevaluated(active, q, groups, STRICTER, [OFF]).withColumn("margin", F.round("margin", 6))


_FOUND = """WITH {best} SELECT c.event_id, c.group_key, c.mode, (1 / c.inv - 1) * 100 AS margin, string_agg(b.leg || ':' || b.bk, ',' ORDER BY b.leg) AS combo, bool_or(b.bk = {off}) AS off
FROM (SELECT * FROM comb WHERE found = legs AND books >= 2 AND (1 / inv - 1) * 100 >= {limit}) c JOIN best b ON c.event_id = b.event_id AND c.group_key = b.group_key GROUP BY c.event_id, c.group_key, c.mode, c.inv"""
CHANGE = f"""WITH {Q}, running AS ({_FOUND.format(best=BEST.format(quotes='(SELECT * FROM latest WHERE is_open)'), off=OFF, limit=LIMIT)}),
found AS ({_FOUND.format(best=BEST.format(quotes=f'(SELECT * FROM latest WHERE is_open AND bk <> {OFF})'), off=OFF, limit=STRICT_LIMIT)}),
judged AS (SELECT *, CASE WHEN margin < {STRICT_LIMIT} OR off THEN 'ended' ELSE 'kept' END AS status FROM running)
SELECT event_id, group_key, status, CASE WHEN status = 'ended' THEN 'threshold_changed' END AS end_reason, round(margin, 6) AS margin, combo FROM judged
UNION ALL SELECT event_id, group_key, 'new', NULL, round(margin, 6), combo FROM found f WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.status = 'kept' AND j.event_id = f.event_id AND j.group_key = f.group_key AND j.margin >= f.margin - 0.05)"""

NOW = 852_076_800_000
_SPORT = "CASE WHEN sport = 'tennis' THEN 'handball' WHEN sport = 'basketball' AND arb_id % 2 = 0 THEN 'boxing' ELSE sport END"


def _matches(spark, d):
    return B.relation(spark, d, B.ARBS).selectExpr("arb_id", f"{_SPORT} AS sport", "first_seen AS start")


def detail_targets(spark, d):
    """Matches to fetch in detail by two quotas, each sport within its horizon."""
    return reads.detail_targets(_matches(spark, d), "start", "arb_id", NOW)


def nearest_details(spark, d):
    """The nearest matches of the coming 36 hours, for feeds with one quota."""
    return reads.nearest_details(_matches(spark, d).where(F.col("start") > NOW), "start", "arb_id", NOW)


_HOURS = "CASE WHEN sport IN ('football', 'tennis', 'basketball') THEN 12 WHEN sport IN ('hockey', 'handball') THEN 24 ELSE 0 END"
TARGETS = f"""WITH {A}, m AS (SELECT arb_id, {_SPORT} AS sport, first_seen AS start FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY sport = 'handball' ORDER BY start, arb_id) AS n FROM m WHERE start > {NOW} AND start - {NOW} < {_HOURS} * 3600000)
SELECT arb_id, sport, start, row_number() OVER (ORDER BY sport = 'handball', start, arb_id) AS place FROM r WHERE n <= CASE WHEN sport = 'handball' THEN 40 ELSE 150 END"""

QUERIES = {
    "detail_targets": (detail_targets, TARGETS),
    "nearest_details": (nearest_details, f"WITH {A} SELECT arb_id, {_SPORT} AS sport, first_seen AS start FROM a WHERE first_seen > {NOW} AND first_seen <= {NOW} + 36 * 3600000 ORDER BY first_seen, arb_id LIMIT 150"),
    "health_log": (health_log, f"WITH f AS ({B.sql(B.FEED)}), g AS (SELECT uid AS id, fetched_at AS ts, CAST(bk AS BIGINT) AS bk, {_EVENT} AS event, {_STATE} AS state FROM f) SELECT * FROM g WHERE event <> 'probe' ORDER BY ts DESC, id DESC LIMIT {LOG_ROWS}"),
    "tick_pages": (tick_pages, f"WITH f AS ({B.sql(B.FEED)}), r AS (SELECT market, fetched_at, uid, odds, row_number() OVER (PARTITION BY market ORDER BY fetched_at, uid) AS place FROM f) SELECT * FROM r WHERE place <= {reads.TICKS}"),
    "subscribed_matches": (subscribed_matches, f"WITH {A} SELECT arb_id AS match_id, sport, first_seen AS start, CASE WHEN sport = 'tennis' THEN 1 ELSE 0 END::BIGINT AS tier FROM a WHERE sport <> 'basketball' AND arb_id % 7 <> 1 AND pair <> 'betx|chance' ORDER BY tier, start, match_id LIMIT {SUBSCRIBED}"),
    "health_snapshot": (health_snapshot, SNAPSHOT),
    "settings_change": (settings_change, CHANGE),
}
