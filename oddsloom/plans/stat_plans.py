"""Queries on opportunities, actions and bets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import stats
from ..operators.series import running
from . import bindings as B

CENSORED = "split_part(end_reason, ':', 1) IN ('system_restart', 'stale', 'threshold_changed', 'unlinked', 'event_started', 'pause_started', 'pause_ended', 'event_finished')"
A, L, C = (f"{n} AS ({B.sql(r)})" for n, r in (("a", B.ARBS), ("l", B.LEGS), ("c", B.ACTIONS)))
HALF = "floor(({x}) * {p} + 0.5) / {p}"
ZONE = "(to_timestamp({t} / 1000) AT TIME ZONE 'Europe/Prague')"


def _arbs(spark, d):
    return B.relation(spark, d, B.ARBS)


def _legs(spark, d):
    return B.relation(spark, d, B.LEGS)


def _actions(spark, d):
    return B.relation(spark, d, B.ACTIONS)


def _by(column):
    def run(spark, d):
        a = _arbs(spark, d)
        return stats.by_group(a, column(a) if callable(column) else F.col(column))

    return run


def _by_sql(key: str) -> str:
    return f"WITH {A} SELECT {key} AS key, count(*) AS n, {HALF.format(x='avg(margin)', p='1000')} AS avg_margin, max(margin) AS max_margin, percentile_cont(0.5) WITHIN GROUP (ORDER BY duration_ms) FILTER (end_reason IS NOT NULL AND NOT {CENSORED}) AS median_ms FROM a GROUP BY 1 ORDER BY n DESC, key LIMIT 40"


def hourly(spark, d):
    return stats.by_group(_arbs(spark, d), S.prague_hour(F.col("first_seen")).cast("long"))


def weekdays(spark, d):
    return _arbs(spark, d).groupBy(S.prague_weekday(F.col("first_seen")).cast("long").alias("weekday"), S.prague_hour(F.col("first_seen")).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def bands(spark, d):
    a = _arbs(spark, d).withColumn("band", S.margin_band(F.col("margin")))
    key = S.segment_key({"mode": F.col("mode"), "sport": F.when(F.col("sport") != "tennis", F.col("sport")), "band": F.col("band")})
    return a.groupBy(key.alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.max("margin").alias("max_margin"))


def recent_arbs(spark, d):
    a = _arbs(spark, d).where("end_reason IS NOT NULL")
    return a.orderBy(F.col("last_seen").desc(), F.col("arb_id").desc()).limit(500).select("arb_id", "last_seen", "end_reason", "margin")


def last_bets(spark, d):
    c = _actions(spark, d).where("action = 'placed'")
    return c.orderBy(F.col("ts").desc(), F.col("uid").desc(), F.col("stake").desc()).limit(2000).select("arb_id", "ts", "uid", "stake")


def observations(spark, d):
    """Ended opportunities of the last 90 days for the lifetime models, newest first."""
    a = _arbs(spark, d)
    newest = a.agg(F.max("first_seen").alias("top"))
    own = a.join(F.broadcast(newest), F.col("first_seen") >= F.col("top") - 90 * 86_400_000).where("end_reason IS NOT NULL")
    return own.orderBy(F.col("first_seen").desc(), "arb_id").limit(200_000).select("arb_id", "first_seen", "duration_ms", (~S.is_censored(F.col("end_reason"))).alias("event"))


def settled_bets(spark, d):
    bets = _actions(spark, d).where("action = 'placed'")
    return stats.settle(bets, _arbs(spark, d)).select("arb_id", "uid", "stake", "settled", "expected", "profit")


def bet_totals(spark, d):
    return stats.bet_totals(stats.settle(_actions(spark, d).where("action = 'placed'"), _arbs(spark, d)))


SETTLED = f"""WITH {A}, {C}, s AS (SELECT c.*, a.margin, {HALF.format(x='c.stake * coalesce(click_margin, a.margin) / (100 + coalesce(click_margin, a.margin))', p='100')} AS expected,
CASE settled WHEN 'won' THEN {HALF.format(x='c.stake * (c.actual - 1)', p='100')} WHEN 'void' THEN 0.0 WHEN 'lost' THEN -c.stake END AS profit FROM c LEFT JOIN a USING (arb_id) WHERE action = 'placed')"""


def profit_curve(spark, d):
    s = stats.settle(_actions(spark, d).where("action = 'placed'"), _arbs(spark, d))
    curve = stats.profit_curve(s, ["bk"])
    return curve.groupBy("bk").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("curve"), 2).alias("peak"), F.round(F.min("curve"), 2).alias("trough")).withColumn("bk", F.col("bk").cast("long"))


def latencies(spark, d):
    out = stats.latency(_actions(spark, d), "bk", "reaction_ms", [F.col("ts").desc(), F.col("uid").desc(), F.col("reaction_ms")])
    return out.withColumn("bk", F.col("bk").cast("long"))


def worst_states(spark, d):
    e = B.read(spark, d, "events").selectExpr("user_id", "CASE WHEN value > 95 THEN 'BLOCKED' WHEN value > 50 THEN 'DEGRADED' ELSE 'OK' END AS state")
    return stats.worst_state(e, ["user_id"])


def placed_with_arbs(spark, d):
    """Actions with their opportunity and the leg of their book, as the lateral join over legs gives them."""
    legs = _legs(spark, d).groupBy("arb_id").agg(F.array_sort(F.collect_list(F.struct("leg", "bk", "odds", "partkey"))).alias("legs"))
    j = _actions(spark, d).join(_arbs(spark, d).select("arb_id", "mode", "margin"), "arb_id").join(legs, "arb_id")
    j = j.withColumn("x", F.explode("legs")).where(F.col("x.bk") == F.col("bk"))
    return j.groupBy("mode", "action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x.odds"), 6).alias("avg_odds"))


def action_capture(spark, d):
    c = _actions(spark, d).withColumn("shown_at", F.when(F.col("arb_id") % 2 == 0, F.col("ts") - F.col("reaction_ms")))
    out = stats.capture_actions(c.drop("reaction_ms"), _arbs(spark, d))
    return out.groupBy("live", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("reaction").alias("reaction"), F.sum("age").alias("age"), F.round(F.avg("at_margin"), 6).alias("margin"))


def arb_timeline(spark, d):
    ticks = _legs(spark, d).join(_arbs(spark, d).select("arb_id", "first_seen"), "arb_id").select("arb_id", (F.col("first_seen") + F.col("leg") * 200).alias("at"), F.col("odds").alias("value"))
    t = stats.timeline(_arbs(spark, d), ticks, _actions(spark, d))
    return t.groupBy("arb_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"), F.count(F.when(F.col("kind") == "tick", 1)).alias("ticks"))


def dashboard(spark, d):
    """Opportunities whose every leg is at an allowed book, over the least margin, of shown sports, best first."""
    legs = _legs(spark, d).groupBy("arb_id").agg(F.collect_list("bk").alias("books"))
    a = _arbs(spark, d).join(legs, "arb_id").where((F.col("sport") != "tennis") & (F.col("margin") >= 2) & F.forall("books", lambda b: b.isin(0, 1, 2, 3, 4, 5, 6)))
    return a.orderBy(F.col("margin").desc(), "arb_id").limit(300).select("arb_id", "sport", "margin", F.array_join(F.transform(F.array_sort(F.array_distinct("books")), lambda b: b.cast("string")), "|").alias("books"))


def alerts(spark, d):
    return _arbs(spark, d).where("end_reason IS NULL AND margin >= 5 AND NOT muted").groupBy("sport").agg(F.count(F.lit(1)).alias("n"))


DAY = 86_400_000


def margin_history(spark, d):
    """Margins of a pair over time: before, direction, and the greatest so far."""
    a = running(_arbs(spark, d).select("arb_id", "pair", "first_seen", "margin"), ["pair"], "first_seen", ["arb_id"], DAY, before={"before": F.col("margin")}, most={"top": F.col("margin")})
    return a.select("arb_id", "margin", "before", "top", F.when(F.col("margin") > F.col("before"), "up").when(F.col("margin") < F.col("before"), "down").otherwise("same").alias("direction"))


def pairs_of_books(spark, d):
    legs = _legs(spark, d).groupBy("arb_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("bk")), lambda b: b.cast("string")), "|").alias("pair"), F.countDistinct("bk").alias("books"))
    return legs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.max("books").alias("books"))


def event_links(spark, d):
    """Customers as participants, nations as competitions: left joins and the list of linked sources of each event."""
    o = B.read(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS home", "(o_custkey * 7) % 1500 + 1 AS away", "CAST(o_custkey % 30 AS INT) AS comp")
    c = B.read(spark, d, "customer").select("c_custkey", "c_name")
    n = B.read(spark, d, "nation").select("n_nationkey", "n_name")
    li = B.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set((F.col("l_suppkey") % 9).cast("string"))), ",").alias("books"))
    h, a = c.toDF("home", "home_name"), c.toDF("away", "away_name")
    return o.join(h, "home").join(a, "away").join(F.broadcast(n), o["comp"] == n["n_nationkey"], "left").join(li, "id", "left").select("id", "home_name", "away_name", F.col("n_name").alias("competition"), "books")


def detail_quota(spark, d):
    """Next matches to fetch in detail: nearest first, main sports up to 150, others up to 40."""
    a = _arbs(spark, d).withColumn("main", F.col("sport").isin("football", "hockey")).withColumn("away", F.col("first_seen") - F.lit(852_076_800_000)).where("away >= 0")
    # an ordered limit for each class, so that the whole table is never sorted; what is left, 190 rows at most, is numbered
    picked = a.where("main").orderBy("away", "arb_id").limit(150).union(a.where("NOT main").orderBy("away", "arb_id").limit(40))
    rn = F.row_number().over(Window.partitionBy("main").orderBy("away", "arb_id"))
    return picked.select("arb_id", "sport", rn.cast("long").alias("rn"))


def downsampled(spark, d):
    """Every 50th point of each series, and its last."""
    a = running(_arbs(spark, d).select("pair", "arb_id", "first_seen"), ["pair"], "first_seen", ["arb_id"], DAY, number="rn", size="n")
    return a.where("(rn - 1) % 50 = 0 OR rn = n").select("pair", "arb_id", "rn")


def lifetime_histogram(spark, d):
    return stats.lifetime_histogram(spark, _arbs(spark, d))


_EDGES = "(VALUES (0, 0, 1), (1, 1, 2), (2, 2, 5), (3, 5, 10), (4, 10, 20), (5, 20, 30), (6, 30, 60), (7, 60, 120), (8, 120, 300), (9, 300, 600), (10, 600, 1800), (11, 1800, NULL)) b(bin, lo, hi)"

QUERIES = {
    "stats_by_sport": (_by("sport"), _by_sql("sport")),
    "stats_by_mode": (_by("mode"), _by_sql("mode")),
    "stats_by_market": (_by("mtype"), _by_sql("mtype")),
    "stats_by_pair": (_by("pair"), _by_sql("pair")),
    "stats_by_hour": (hourly, _by_sql(f"hour({ZONE.format(t='first_seen')})")),
    "stats_weekday_hour": (weekdays, f"WITH {A} SELECT isodow({ZONE.format(t='first_seen')}) AS weekday, hour({ZONE.format(t='first_seen')}) AS hour, count(*) AS n FROM a GROUP BY 1, 2"),
    "margin_bands": (bands, f"WITH {A} SELECT 'mode=' || mode || CASE WHEN sport <> 'tennis' THEN '|sport=' || sport ELSE '' END || '|band=' || CASE WHEN margin < 1 THEN '0-1' WHEN margin < 2 THEN '1-2' WHEN margin < 3 THEN '2-3' WHEN margin < 5 THEN '3-5' ELSE '5+' END AS segment, count(*) AS n, max(margin) AS max_margin FROM a GROUP BY 1"),
    "end_reasons": (lambda s, d: stats.end_reasons(_arbs(s, d)), f"WITH {A} SELECT split_part(end_reason, ':', 1) AS reason, count(*) AS n FROM a WHERE end_reason IS NOT NULL GROUP BY 1"),
    "lifetime_histogram": (lifetime_histogram, f"WITH {A} SELECT CAST(bin AS BIGINT) AS bin, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, count(a.arb_id) FILTER (NOT {CENSORED}) AS ended, count(a.arb_id) FILTER ({CENSORED}) AS censored FROM {_EDGES} LEFT JOIN a ON a.end_reason IS NOT NULL AND duration_ms >= lo * 1000 AND (hi IS NULL OR duration_ms < hi * 1000) GROUP BY bin, lo, hi"),
    "action_summary": (lambda s, d: stats.action_summary(_actions(s, d)), f"WITH {C} SELECT action, count(*) AS n, CAST(floor(avg(reaction_ms) + 0.5) AS BIGINT) AS avg_reaction, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM c GROUP BY action"),
    "slippage": (lambda s, d: stats.slippage(_actions(s, d), _legs(s, d)).withColumn("bk", F.col("bk").cast("long")), f"WITH {C}, {L} SELECT CAST(c.bk AS BIGINT) AS bk, count(*) AS n, {HALF.format(x='avg((c.actual - l.odds) / l.odds * 100)', p='1000')} AS slippage FROM c JOIN l ON c.arb_id = l.arb_id AND c.bk = l.bk WHERE action = 'placed' GROUP BY c.bk"),
    "rejections": (lambda s, d: stats.rejections(_actions(s, d)).withColumn("bk", F.col("bk").cast("long")), f"WITH {C} SELECT CAST(bk AS BIGINT) AS bk, count(*) AS n FROM c WHERE action = 'rejected' GROUP BY bk"),
    "daily_profit": (lambda s, d: stats.daily_profit(_actions(s, d), _arbs(s, d)), f"WITH {A}, {C}, j AS (SELECT strftime({ZONE.format(t='c.ts')}, '%Y-%m-%d') AS day, stake, coalesce(click_margin, margin) AS m FROM c JOIN a USING (arb_id) WHERE action = 'placed'), g AS (SELECT day, {HALF.format(x='sum(stake)', p='100')} AS staked, {HALF.format(x='CAST(sum(CAST(stake * m / (100 + m) AS DECIMAL(30,12))) AS DOUBLE)', p='100')} AS profit FROM j GROUP BY day) SELECT *, {HALF.format(x='sum(profit) OVER (ORDER BY day)', p='100')} AS cumulative FROM g"),
    "arb_totals": (lambda s, d: stats.totals(_arbs(s, d)), f"WITH {A} SELECT count(*) AS n, count(*) FILTER (end_reason IS NULL) AS active, count(*) FILTER (end_reason IS NOT NULL AND {CENSORED}) AS censored, {HALF.format(x='avg(margin)', p='1000')} AS avg_margin, max(margin) AS max_margin FROM a"),
    "reaction_median": (lambda s, d: stats.recent_median(_actions(s, d)), f"WITH {C}, t AS (SELECT * FROM c WHERE action = 'placed' ORDER BY ts DESC, uid DESC LIMIT 200) SELECT count(*) AS n, CASE WHEN count(*) >= 5 THEN percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(reaction_ms AS DOUBLE)) ELSE 8000 END AS needed_ms FROM t"),
    "acceptance_median": (lambda s, d: stats.acceptance(_actions(s, d), _arbs(s, d)).withColumn("bk", F.col("bk").cast("long")), f"WITH {A}, {C} SELECT CAST(c.bk AS BIGINT) AS bk, a.mode <> 'PREMATCH' AS live, count(*) AS n, percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(c.reaction_ms AS DOUBLE)) AS median_ms FROM c JOIN a USING (arb_id) WHERE action = 'placed' GROUP BY 1, 2 HAVING count(*) >= 3"),
    "recent_arbs": (recent_arbs, f"WITH {A} SELECT arb_id, last_seen, end_reason, margin FROM a WHERE end_reason IS NOT NULL ORDER BY last_seen DESC, arb_id DESC LIMIT 500"),
    "last_bets": (last_bets, f"WITH {C} SELECT arb_id, ts, uid, stake FROM c WHERE action = 'placed' ORDER BY ts DESC, uid DESC, stake DESC LIMIT 2000"),
    "observations": (observations, f"WITH {A} SELECT arb_id, first_seen, duration_ms, NOT {CENSORED} AS event FROM a WHERE end_reason IS NOT NULL AND first_seen >= (SELECT max(first_seen) FROM a) - 7776000000 ORDER BY first_seen DESC, arb_id LIMIT 200000"),
    "settled_bets": (settled_bets, f"{SETTLED} SELECT arb_id, uid, stake, settled, expected, profit FROM s"),
    "bet_totals": (bet_totals, f"{SETTLED} SELECT count(*) AS n, {HALF.format(x='sum(stake)', p='100')} AS staked, round(sum(expected), 4) AS expected, round(sum(profit), 4) AS real, count(settled) AS settled, count(*) - count(settled) AS open FROM s"),
    "profit_curve": (profit_curve, f"{SETTLED}, k AS (SELECT bk, sum(coalesce(profit, expected, 0)) OVER (PARTITION BY bk ORDER BY ts, uid ROWS UNBOUNDED PRECEDING) AS curve FROM s) SELECT CAST(bk AS BIGINT) AS bk, count(*) AS n, round(max(curve), 2) AS peak, round(min(curve), 2) AS trough FROM k GROUP BY bk"),
    "latency_percentiles": (latencies, f"WITH {C}, r AS (SELECT *, row_number() OVER (PARTITION BY bk ORDER BY ts DESC, uid DESC, reaction_ms) AS rn FROM c), k AS (SELECT bk, list_sort(list(reaction_ms)) AS v FROM r WHERE rn <= 200 GROUP BY bk) SELECT CAST(bk AS BIGINT) AS bk, CAST(len(v) AS BIGINT) AS n, v[least(len(v), CAST(floor(len(v) * 0.5) AS BIGINT) + 1)] AS p50, v[least(len(v), CAST(floor(len(v) * 0.95) AS BIGINT) + 1)] AS p95 FROM k"),
    "worst_states": (worst_states, "SELECT user_id, CASE max(CASE WHEN value > 95 THEN 3 WHEN value > 50 THEN 2 ELSE 1 END) WHEN 3 THEN 'BLOCKED' WHEN 2 THEN 'DEGRADED' ELSE 'OK' END AS state FROM events GROUP BY user_id"),
    "placed_with_legs": (placed_with_arbs, f"WITH {A}, {L}, {C} SELECT a.mode, c.action, count(*) AS n, round(avg(l.odds), 6) AS avg_odds FROM c JOIN a USING (arb_id) JOIN l ON l.arb_id = c.arb_id AND l.bk = c.bk GROUP BY a.mode, c.action"),
    "action_capture": (action_capture, f"WITH {A}, {C}, j AS (SELECT a.mode <> 'PREMATCH' AS live, c.action, greatest(0, CASE WHEN c.arb_id % 2 = 0 THEN c.reaction_ms ELSE c.ts - a.first_seen END) AS reaction, c.ts - a.first_seen AS age, coalesce(c.click_margin, a.margin) AS m FROM c JOIN a USING (arb_id)) SELECT live, action, count(*) AS n, CAST(sum(reaction) AS BIGINT) AS reaction, CAST(sum(age) AS BIGINT) AS age, round(avg(m), 6) AS margin FROM j GROUP BY live, action"),
    "arb_timeline": (arb_timeline, f"WITH {A}, {L}, {C}, t AS (SELECT arb_id, first_seen AS moment, 'start' AS kind FROM a UNION ALL SELECT arb_id, last_seen, 'end' FROM a WHERE end_reason IS NOT NULL UNION ALL SELECT arb_id, first_seen + leg * 200, 'tick' FROM l JOIN a USING (arb_id) UNION ALL SELECT arb_id, ts, action FROM c) SELECT arb_id, count(*) AS n, max(moment) AS last, count(*) FILTER (kind = 'tick') AS ticks FROM t GROUP BY arb_id"),
    "dashboard": (dashboard, f"WITH {A}, {L}, g AS (SELECT arb_id, list_sort(list(DISTINCT bk)) AS b FROM l GROUP BY arb_id) SELECT arb_id, sport, margin, array_to_string(b, '|') AS books FROM a JOIN g USING (arb_id) WHERE sport <> 'tennis' AND margin >= 2 AND NOT list_has_any(b, [7, 8]) ORDER BY margin DESC, arb_id LIMIT 300"),
    "alerts": (alerts, f"WITH {A} SELECT sport, count(*) AS n FROM a WHERE end_reason IS NULL AND margin >= 5 AND NOT muted GROUP BY sport"),
    "margin_history": (margin_history, f"WITH {A}, h AS (SELECT arb_id, margin, lag(margin) OVER w AS before, max(margin) OVER (PARTITION BY pair ORDER BY first_seen, arb_id ROWS UNBOUNDED PRECEDING) AS top FROM a WINDOW w AS (PARTITION BY pair ORDER BY first_seen, arb_id)) SELECT *, CASE WHEN margin > before THEN 'up' WHEN margin < before THEN 'down' ELSE 'same' END AS direction FROM h"),
    "pairs_of_books": (pairs_of_books, f"WITH {L}, g AS (SELECT array_to_string(list_sort(list(DISTINCT bk)), '|') AS pair, count(DISTINCT bk) AS books FROM l GROUP BY arb_id) SELECT pair, count(*) AS n, max(books) AS books FROM g GROUP BY pair"),
    "event_links": (event_links, "WITH o AS (SELECT o_orderkey AS id, o_custkey AS home, (o_custkey * 7) % 1500 + 1 AS away, o_custkey % 30 AS comp FROM orders), l AS (SELECT l_orderkey AS id, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey % 9 AS VARCHAR))), ',') AS books FROM lineitem GROUP BY l_orderkey) SELECT o.id, h.c_name AS home_name, a.c_name AS away_name, n_name AS competition, books FROM o JOIN customer h ON o.home = h.c_custkey JOIN customer a ON o.away = a.c_custkey LEFT JOIN nation ON comp = n_nationkey LEFT JOIN l ON l.id = o.id"),
    "detail_quota": (detail_quota, f"WITH {A}, r AS (SELECT arb_id, sport, row_number() OVER (PARTITION BY sport IN ('football', 'hockey') ORDER BY first_seen, arb_id) AS rn FROM a WHERE first_seen >= 852076800000) SELECT arb_id, sport, rn FROM r WHERE rn <= CASE WHEN sport IN ('football', 'hockey') THEN 150 ELSE 40 END"),
    "downsampled": (downsampled, f"WITH {A}, r AS (SELECT pair, arb_id, row_number() OVER (PARTITION BY pair ORDER BY first_seen, arb_id) AS rn, count(*) OVER (PARTITION BY pair) AS n FROM a) SELECT pair, arb_id, rn FROM r WHERE (rn - 1) % 50 = 0 OR rn = n"),
}
