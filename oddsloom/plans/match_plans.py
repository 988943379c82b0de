"""Queries on matching, event state and lifecycle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions import scalars as S
from ..operators import detect, lifecycle, matching, tracker
from ..operators.groups import group_rows
from . import bindings as B
from .quote_plans import LIMIT, SETTINGS, SPORTS, _groups
from .stat_plans import A

HOUR = 3_600_000


def _sides(spark, d):
    a = B.relation(spark, d, B.ARBS).select("arb_id", "sport", F.col("first_seen").alias("start"))
    entries = a.where("arb_id % 2 = 0").select(F.col("arb_id").alias("entry_id"), "sport", "start")
    events = a.where("arb_id % 2 = 1").select(F.col("arb_id").alias("event_id"), "sport", F.col("start").alias("ev_start"))
    return entries, events


SIDES = f"{A}, e AS (SELECT arb_id AS entry_id, sport, first_seen AS start FROM a WHERE arb_id % 2 = 0), v AS (SELECT arb_id AS event_id, sport, first_seen AS ev_start FROM a WHERE arb_id % 2 = 1)"


def time_candidates(spark, d):
    e, v = _sides(spark, d)
    return matching.near_in_time(e, v, ["sport"], "start", "ev_start", 15 * matching.MINUTE).select("entry_id", "event_id", (F.col("start") - F.col("ev_start")).alias("gap"))


def wide_candidates(spark, d):
    e, v = _sides(spark, d)
    return matching.near_in_time(e, v, ["sport"], "start", "ev_start", 3 * HOUR).groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def nearest_candidates(spark, d):
    e, v = _sides(spark, d)
    return matching.nearest(e, v, ["sport"], "entry_id", "start", "ev_start", "event_id", 3 * HOUR, 3).select("entry_id", "event_id", "gap", F.col("rank").cast("long").alias("rank"))


def review_candidates(spark, d):
    """All that the reference offers a reviewer: the 50 nearest events within 3 hours."""
    e, v = _sides(spark, d)
    return matching.nearest(e, v, ["sport"], "entry_id", "start", "ev_start", "event_id", 3 * HOUR, 50).select("entry_id", "event_id", "gap", F.col("rank").cast("long").alias("rank"))


def same_participants(spark, d):
    o = B.read(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey % 60 AS home", "CAST(floor(o_totalprice) AS BIGINT) % 60 AS away")
    return matching.exact_counts(o.where("id % 2 = 0"), o.where("id % 2 = 1"), "id", "home", "away")


def folded_texts(spark, d):
    return B.read(spark, d, "documents").select("doc_id", F.md5(S.fold(F.col("text")).cast("binary")).alias("folded"), F.length(S.fold(F.col("text"))).cast("long").alias("chars"))


def folded_names(spark, d):
    return B.read(spark, d, "part").select(S.fold(F.col("p_name")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def similar_parts(spark, d):
    """Similarity, by the team rules, of the distinct pairs of part names that follow each other in an order."""
    li = B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(B.read(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    before = F.lag("p_name").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    pairs = li.select("p_name", before.alias("other")).where("other IS NOT NULL").select(F.least("p_name", "other").alias("p_name"), F.greatest("p_name", "other").alias("other")).distinct()
    return pairs.withColumn("score", F.round(names.similarity_column(F.col("p_name"), F.col("other"), F.lit("football")), 6))


def _reports(spark, d):
    f = B.relation(spark, d, B.FEED)
    latest = detect.latest(f.withColumn("changed_at", F.col("fetched_at")), [F.col("uid").desc()], ("event_id", "bk"))
    pause = F.when(F.col("has_break"), F.when(F.col("odds") > 2, "football_ht").otherwise("hockey_intermission"))
    return latest.select("event_id", F.col("bk").cast("long").alias("bk"), (F.col("live") | (F.col("uid") % 3 == 0)).alias("live"), F.col("fetched_at").alias("seen_at"), "finished", (F.col("uid") % 2 == 0).alias("authoritative"), pause.alias("pause_type"), F.when(F.col("has_break"), F.col("fetched_at") - 1000 * F.col("uid") % 600000).alias("pause_started"))


NOW = 1_706_700_000_000
SPAN = 20_000 * 43_200


def _view(spark, d):
    """The reports' ages are divided so that ten days count as fresh."""
    r = _reports(spark, d).withColumn("seen_at", F.lit(NOW) - F.floor((F.lit(NOW) - F.col("seen_at")) / 43_200).cast("long"))
    return r, tracker.merged_view(r, F.lit(NOW))


REPORTS = f"""f AS ({B.sql(B.FEED)}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, bk ORDER BY fetched_at DESC, uid DESC) AS rn FROM f) WHERE rn = 1),
r AS (SELECT event_id, CAST(bk AS BIGINT) AS bk, live OR uid % 3 = 0 AS live, {NOW} - CAST(floor(CAST({NOW} - fetched_at AS DOUBLE) / 43200) AS BIGINT) AS seen_at, finished, uid % 2 = 0 AS authoritative, CASE WHEN has_break THEN CASE WHEN odds > 2 THEN 'football_ht' ELSE 'hockey_intermission' END END AS pause_type, CASE WHEN has_break THEN fetched_at - 1000 * uid % 600000 END AS pause_started FROM l),
fr AS (SELECT * FROM r WHERE {NOW} - seen_at < 20000),
g AS (SELECT event_id, count(*) AS reports, count(*) FILTER (live) AS live_reports, count(*) FILTER (live AND finished) AS done, count(*) FILTER (live AND authoritative) AS auth, count(*) FILTER (live AND authoritative AND pause_type IS NOT NULL) AS ap,
min(CASE WHEN live AND authoritative AND pause_type IS NOT NULL THEN {{'s': pause_started, 't': pause_type}} END) AS p1, min(CASE WHEN live AND pause_type IS NOT NULL THEN {{'s': pause_started, 't': pause_type}} END) AS p2,
max(CASE WHEN live THEN {{'a': authoritative, 's': seen_at, 'n': -bk}} END) AS pr FROM fr GROUP BY event_id),
h AS (SELECT *, done * 2 > live_reports AS finished, CASE WHEN auth > 0 THEN CASE WHEN ap * 2 > auth THEN p1 END ELSE p2 END AS p FROM g),
v AS (SELECT event_id, reports, live_reports, finished, CASE WHEN live_reports = 0 THEN 'PREMATCH' WHEN p IS NOT NULL AND NOT finished THEN 'PAUSED' ELSE 'LIVE' END AS mode, CASE WHEN NOT finished AND live_reports > 0 THEN p.t END AS pause_type, CASE WHEN NOT finished AND live_reports > 0 THEN p.s END AS pause_started, -pr.n AS state_from FROM h)"""


def event_views(spark, d):
    return _view(spark, d)[1]


def book_demand(spark, d):
    r, v = _view(spark, d)
    return tracker.demand(v, r, F.lit(NOW))


def mode_transitions(spark, d):
    f = B.relation(spark, d, B.FEED)
    mode = F.when(F.col("odds") < 2, "PREMATCH").when(F.col("odds") < 3, "LIVE").otherwise("PAUSED")
    views = f.select("event_id", F.struct("fetched_at", "uid").alias("at"), mode.alias("mode"), "finished")
    return tracker.transitions(views).groupBy("mode_before", "mode", "reason").agg(F.count(F.lit(1)).alias("n"))


def pause_states(spark, d):
    e = B.read(spark, d, "events").selectExpr(
        "event_id", "CASE user_id % 6 WHEN 0 THEN 'football' WHEN 1 THEN 'hockey' WHEN 2 THEN 'basketball' WHEN 3 THEN 'handball' WHEN 4 THEN 'american_football' ELSE 'snooker' END AS sport",
        "CASE event_id % 5 WHEN 0 THEN 'Halftime' WHEN 1 THEN '2. poločas' WHEN 2 THEN 'Konec 1. třetiny' WHEN 3 THEN 'end of the 2nd quarter' ELSE 'Running' END AS status",
        "CAST(event_id % 4 AS INT) AS period", "CAST(floor(value * 37) AS BIGINT) % 3700 AS clock", "CASE WHEN event_id % 50 = 0 THEN 'NBA' ELSE 'Liga' END AS competition")
    q = e.withColumn("says", S.says_break(F.col("status"))).withColumn("edge", tracker.at_boundary(F.col("sport"), F.col("period"), F.col("clock"), F.lit(None).cast("int"), F.col("competition")))
    kind = tracker.pause_type(F.col("sport"), F.col("status"), F.col("period"), F.col("clock"), F.col("competition"))
    return q.withColumn("kind", kind).withColumn("expected", tracker.expected_seconds(F.col("kind")).cast("long")).groupBy("sport", "status", "says", "edge", "kind", "expected").agg(F.count(F.lit(1)).alias("n"))


PAUSES = """WITH e AS (SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'football' WHEN 1 THEN 'hockey' WHEN 2 THEN 'basketball' WHEN 3 THEN 'handball' WHEN 4 THEN 'american_football' ELSE 'snooker' END AS sport,
CASE event_id % 5 WHEN 0 THEN 'Halftime' WHEN 1 THEN '2. poločas' WHEN 2 THEN 'Konec 1. třetiny' WHEN 3 THEN 'end of the 2nd quarter' ELSE 'Running' END AS status, event_id % 4 AS period, CAST(floor(value * 37) AS BIGINT) % 3700 AS clock, CASE WHEN event_id % 50 = 0 THEN 720 ELSE 600 END AS q FROM events),
k AS (SELECT *, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true END AS says, event_id % 5 IN (0, 1) AS half,
CASE sport WHEN 'football' THEN clock BETWEEN 2670 AND 3600 AND period <= 1 WHEN 'hockey' THEN clock >= 1195 AND clock <= 3600 AND (clock % 1200 <= 3 OR clock % 1200 >= 1197) WHEN 'basketball' THEN clock >= q - 5 AND clock < 4 * q AND (clock % q <= 3 OR clock % q >= q - 3) WHEN 'handball' THEN clock BETWEEN 1770 AND 2400 AND period <= 1 WHEN 'american_football' THEN clock >= 895 AND clock < 3600 AND (clock % 900 <= 3 OR clock % 900 >= 897) ELSE false END AS edge FROM e),
t AS (SELECT *, CASE sport WHEN 'football' THEN 'football_ht' WHEN 'hockey' THEN 'hockey_intermission' WHEN 'handball' THEN 'handball_ht' WHEN 'basketball' THEN CASE WHEN half OR period = 2 THEN 'basketball_ht' ELSE 'basketball_quarter' END WHEN 'american_football' THEN CASE WHEN half OR period = 2 THEN 'american_football_ht' ELSE 'american_football_quarter' END ELSE 'other_break' END AS kind FROM k)
SELECT sport, status, says, edge, kind, CAST(CASE kind WHEN 'football_ht' THEN 900 WHEN 'hockey_intermission' THEN 1020 WHEN 'handball_ht' THEN 600 WHEN 'basketball_ht' THEN 900 WHEN 'american_football_ht' THEN 780 ELSE 120 END AS BIGINT) AS expected, count(*) AS n FROM t GROUP BY ALL"""


def _history(spark, d):
    return B.relation(spark, d, B.QUOTES)


def arb_lifecycle(spark, d):
    order = [F.col(c) for c in ("u1", "u2", "u3", "u4", "odds", "is_open", "seen_at")]
    versions = lifecycle.intervals(_history(spark, d), order).drop("u1", "u2", "u3", "u4")
    found = lifecycle.opportunities(lifecycle.instants(versions, _groups(spark)), SETTINGS)
    return found.select("event_id", "group_key", "combo", "first_seen", "ended_at", "end_reason", "instants", F.round("margin", 6).alias("margin"), F.round("max_margin", 6).alias("max_margin"))


LIFE = f"""WITH q AS ({B.sql(B.QUOTES)}), dim(sport, group_key, legs, leg, leg_sel, src, market, sel) AS ({B.group_values(group_rows(list(SPORTS), list(B.MARKETS)))}),
i AS (SELECT * FROM (SELECT *, lead(changed_at) OVER (PARTITION BY event_id, bk, market, sel ORDER BY changed_at, u1, u2, u3, u4, odds, is_open, seen_at) AS until FROM q) WHERE until IS NULL OR until > changed_at),
s AS (SELECT i.event_id, i.mode, i.bk, i.odds, i.is_open, i.changed_at, i.until, d.* FROM i JOIN dim d USING (sport, market, sel)),
t AS (SELECT DISTINCT event_id, group_key, unnest([changed_at, until]) AS t FROM s),
o AS (SELECT * FROM t WHERE t IS NOT NULL),
b AS (SELECT o.event_id, o.group_key, o.t, s.mode, s.legs, s.leg, s.bk, s.src, s.odds, row_number() OVER (PARTITION BY o.event_id, o.group_key, o.t, s.leg ORDER BY s.odds DESC, s.bk, s.src) AS r FROM o JOIN s ON o.event_id = s.event_id AND o.group_key = s.group_key AND s.changed_at <= o.t AND (s.until IS NULL OR o.t < s.until) WHERE s.is_open),
c AS (SELECT event_id, group_key, t, mode, CASE WHEN count(DISTINCT bk) >= 2 THEN (1 / sum(1 / odds) - 1) * 100 END AS margin, string_agg(leg || ':' || bk || ':' || src, ',' ORDER BY leg) AS combo FROM b WHERE r = 1 GROUP BY event_id, group_key, t, mode, legs HAVING count(*) = legs),
e AS (SELECT o.*, c.margin, c.combo, coalesce(c.margin >= {LIMIT}, false) AS alive FROM o LEFT JOIN c ON o.event_id = c.event_id AND o.group_key = c.group_key AND o.t = c.t),
n AS (SELECT *, CASE WHEN alive AND (NOT coalesce(lag(alive) OVER w, false) OR lag(combo) OVER w <> combo) THEN 1 ELSE 0 END AS nw, lead(t) OVER w AS nt, lead(margin) OVER w AS nm, lead(alive) OVER w AS na FROM e WINDOW w AS (PARTITION BY event_id, group_key ORDER BY t)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY event_id, group_key ORDER BY t) AS run FROM n),
z AS (SELECT event_id, group_key, combo, min(t) AS first_seen, arg_max({{'t': nt, 'm': nm, 'a': na}}, t) AS n, count(*) AS instants, arg_min(margin, t) AS margin, max(margin) AS max_margin FROM r WHERE alive GROUP BY event_id, group_key, run, combo)
SELECT event_id, group_key, combo, first_seen, n.t AS ended_at, CASE WHEN n.t IS NULL THEN NULL WHEN n.m IS NULL THEN 'suspended' WHEN n.a THEN 'replaced' ELSE 'leg_odds_changed' END AS end_reason, instants, round(margin, 6) AS margin, round(max_margin, 6) AS max_margin FROM z"""

QUERIES = {
    "time_candidates": (time_candidates, f"WITH {SIDES} SELECT entry_id, event_id, start - ev_start AS gap FROM e JOIN v USING (sport) WHERE abs(start - ev_start) <= 900000"),
    "wide_candidates": (wide_candidates, f"WITH {SIDES} SELECT entry_id, count(*) AS n, min(event_id) AS first_event FROM e JOIN v USING (sport) WHERE abs(start - ev_start) <= 10800000 GROUP BY entry_id"),
    "nearest_candidates": (nearest_candidates, f"WITH {SIDES}, r AS (SELECT entry_id, event_id, abs(start - ev_start) AS gap, row_number() OVER (PARTITION BY entry_id ORDER BY abs(start - ev_start), event_id) AS rank FROM e JOIN v USING (sport) WHERE abs(start - ev_start) <= 10800000) SELECT * FROM r WHERE rank <= 3"),
    "review_candidates": (review_candidates, f"WITH {SIDES}, r AS (SELECT entry_id, event_id, abs(start - ev_start) AS gap, row_number() OVER (PARTITION BY entry_id ORDER BY abs(start - ev_start), event_id) AS rank FROM e JOIN v USING (sport) WHERE abs(start - ev_start) <= 10800000) SELECT * FROM r WHERE rank <= 50"),
    "same_participants": (same_participants, "WITH o AS (SELECT o_orderkey AS id, o_custkey % 60 AS home, CAST(floor(o_totalprice) AS BIGINT) % 60 AS away FROM orders) SELECT a.id, count(*) AS n, count(*) FILTER (a.home <> b.home) AS swapped FROM o a JOIN o b ON least(a.home, a.away) = least(b.home, b.away) AND greatest(a.home, a.away) = greatest(b.home, b.away) WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY a.id"),
    "folded_texts": (folded_texts, r"""WITH f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(regexp_replace(text, '\b([A-Za-z])\.\s?([A-Za-z])\.(\s|$)', '\1\2\3', 'g'), 'ß', 'ss'))), '[’''`´]', '', 'g'), '[^a-z0-9/]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(t) AS folded, length(t) AS chars FROM f"""),
    "folded_names": (folded_names, "SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9/]+', ' ', 'g')) AS name, count(*) AS n FROM part GROUP BY 1"),
    "similar_parts": (similar_parts, None),
    "event_views": (event_views, f"WITH {REPORTS} SELECT * FROM v"),
    "book_demand": (book_demand, f"WITH {REPORTS} SELECT bk, CASE max(CASE WHEN v.finished THEN 0 WHEN mode = 'LIVE' THEN 2 WHEN mode = 'PAUSED' THEN 1 ELSE 0 END) WHEN 2 THEN 'LIVE' WHEN 1 THEN 'PAUSED' ELSE 'IDLE' END AS demand FROM fr JOIN v USING (event_id) WHERE fr.live GROUP BY bk"),
    "mode_transitions": (mode_transitions, f"""WITH f AS ({B.sql(B.FEED)}), m AS (SELECT event_id, CASE WHEN odds < 2 THEN 'PREMATCH' WHEN odds < 3 THEN 'LIVE' ELSE 'PAUSED' END AS mode, finished, lag(CASE WHEN odds < 2 THEN 'PREMATCH' WHEN odds < 3 THEN 'LIVE' ELSE 'PAUSED' END) OVER w AS mode_before, coalesce(lag(finished) OVER w, false) AS fb FROM f WINDOW w AS (PARTITION BY event_id ORDER BY fetched_at, uid)),
x AS (SELECT *, CASE WHEN finished AND NOT fb THEN 'event_finished' WHEN mode = mode_before THEN NULL WHEN mode_before = 'PREMATCH' THEN 'event_started' WHEN mode_before = 'PAUSED' AND mode = 'LIVE' THEN 'pause_ended' WHEN mode_before = 'LIVE' AND mode = 'PAUSED' THEN 'pause_started' ELSE 'event_finished' END AS reason FROM m WHERE mode_before IS NOT NULL)
SELECT mode_before, mode, reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY ALL"""),
    "pause_states": (pause_states, PAUSES),
    "arb_lifecycle": (arb_lifecycle, LIFE),
}
