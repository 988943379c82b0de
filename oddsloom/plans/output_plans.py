"""Queries on what is stored and shown: labels, detection columns, stakes with a fixed leg, settlement, flags, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domain import BOOKS
from ..functions import scalars as S
from ..operators import cox, detect, output, stakes, survival
from ..operators.groups import group_rows
from ..sources import feeds
from . import bindings as B
from .model_plans import _H, MODEL
from .quote_plans import BEST, LIMIT, SETTINGS, SPORTS, Q, _groups, _quotes
from .stat_plans import CENSORED, HALF, ZONE, A, C, L


def market_labels(spark, d):
    q = _quotes(spark, d)
    kind = S.market_type(F.col("market"))
    return q.groupBy(output.market_label(F.col("market"), F.col("sport")).alias("label"), output.selection_label(F.col("sel"), kind).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


MARKET_LABELS = f"""WITH {Q} SELECT CASE market WHEN '1X2|REG' THEN '1X2' WHEN 'DC|REG' THEN 'Dvojtip' WHEN 'AH|REG|-0.5' THEN 'Handicap -0.5' WHEN 'AH|REG|0.5' THEN 'Handicap +0.5' WHEN 'DNB|REG' THEN 'Bez remízy' ELSE 'Počet ' || CASE sport WHEN 'basketball' THEN 'bodů' WHEN 'tennis' THEN 'gemů' ELSE 'gólů' END || ' 2.5' END || ' · zákl. doba' AS label,
CASE sel WHEN 'HOME' THEN CASE WHEN market = '1X2|REG' THEN '1' ELSE 'Domácí' END WHEN 'AWAY' THEN CASE WHEN market = '1X2|REG' THEN '2' ELSE 'Hosté' END WHEN 'DRAW' THEN 'X' WHEN 'HOME_DRAW' THEN '1X' WHEN 'HOME_AWAY' THEN '12' WHEN 'DRAW_AWAY' THEN 'X2' WHEN 'OVER' THEN 'Více' ELSE 'Méně' END AS outcome, count(*) AS n FROM latest GROUP BY 1, 2"""


def detection_rows(spark, d):
    """Opportunities with the columns stored at detection; scores, clocks and starts are derived from the order."""
    legs = B.relation(spark, d, B.LEGS).groupBy("arb_id").agg(F.collect_set("bk").alias("books"))
    a = B.relation(spark, d, B.ARBS).join(legs, "arb_id").withColumns({
        "home": F.when(F.col("mode") != "PREMATCH", F.col("arb_id") % 5), "away": F.when(F.col("mode") != "PREMATCH", F.col("duration_ms") % 4), "clock_s": F.when(F.col("mode") != "PREMATCH", F.col("duration_ms") % 5400),
        "start_time": F.col("first_seen") + (F.col("duration_ms") - 450_000) * 10, "pause_started": F.when(F.col("mode") == "PAUSED", F.col("first_seen") - F.col("duration_ms")), "market": F.concat(F.col("mtype"), F.when(F.col("mtype") == "OU", "|REG|2.5").otherwise("|REG"))})
    out = output.detection_columns(a)
    return out.select("arb_id", "score", "minute", "pause_elapsed_s", "time_to_start_s", "hour", "weekday", "pair_key", "market_type", "market_scope", "market_line", "margin_shown")


_NAMES = "[" + ", ".join(f"'{b}'" for b in BOOKS) + "]"
DETECTION = f"""WITH {A}, {L}, b AS (SELECT arb_id, array_to_string(list_sort(list(DISTINCT {_NAMES}[bk + 1])), '|') AS pair_key FROM l GROUP BY arb_id)
SELECT arb_id, CASE WHEN mode <> 'PREMATCH' THEN (arb_id % 5) || ':' || (duration_ms % 4) END AS score, CASE WHEN mode <> 'PREMATCH' THEN duration_ms % 5400 // 60 END AS minute, CASE WHEN mode = 'PAUSED' THEN CAST(floor(CAST(duration_ms AS DOUBLE) / 1000 + 0.5) AS BIGINT) END AS pause_elapsed_s,
CASE WHEN mode = 'PREMATCH' THEN CAST(floor(CAST((duration_ms - 450000) * 10 AS DOUBLE) / 1000 + 0.5) AS BIGINT) END AS time_to_start_s, hour({ZONE.format(t='first_seen')}) AS hour, isodow({ZONE.format(t='first_seen')}) AS weekday, pair_key, mtype AS market_type, 'REG' AS market_scope, CASE WHEN mtype = 'OU' THEN 2.5::DOUBLE END AS market_line, {HALF.format(x='margin', p='1000')} AS margin_shown FROM a JOIN b USING (arb_id)"""


def fixed_stakes(spark, d):
    """The other stakes when the first leg's is given."""
    found = detect.arbs(_quotes(spark, d), _groups(spark), SETTINGS, check_consensus=False)
    found = found.select("event_id", "group_key", F.transform("leg_list", lambda x: x["odds"]).alias("odds"))
    plan = stakes.allocate_fixed(found, ["event_id", "group_key"], F.lit(1), 100 + F.col("event_id") % 50)
    return plan.select("event_id", "group_key", F.array_join(F.transform("stakes", lambda s: s.cast("long").cast("string")), ",").alias("stakes"), F.col("total").cast("long").alias("total"), "min_profit", "positive")


FIXED = f"""WITH {Q}, {BEST.format(quotes="(SELECT * FROM latest WHERE is_open)")},
a AS (SELECT event_id, group_key, legs FROM comb WHERE found = legs AND books >= 2 AND (1 / inv - 1) * 100 >= {LIMIT}),
o AS (SELECT a.event_id, a.group_key, max(CASE WHEN leg = 0 THEN odds END) AS o0, max(CASE WHEN leg = 1 THEN odds END) AS o1, max(CASE WHEN leg = 2 THEN odds END) AS o2, max(a.legs) AS n FROM a JOIN best b ON a.event_id = b.event_id AND a.group_key = b.group_key GROUP BY a.event_id, a.group_key),
i AS (SELECT *, CAST(100 + event_id % 50 AS DOUBLE) AS s0, 1 / o0 + 1 / o1 + CASE WHEN n = 3 THEN 1 / o2 ELSE 0 END AS inv FROM o),
g AS (SELECT *, s0 * o0 * inv AS goal FROM i),
w AS (SELECT g.*, m, floor(goal / o1 / inv) + m % 2 AS s1, CASE WHEN n = 3 THEN floor(goal / o2 / inv) + (m // 2) % 2 END AS s2 FROM g, range(4) r(m) WHERE m < CASE WHEN n = 3 THEN 4 ELSE 2 END),
t AS (SELECT *, s0 + s1 + coalesce(s2, 0) AS total FROM w WHERE s1 > 0 AND coalesce(s2, 1) > 0),
p AS (SELECT *, least(floor((s0 * o0 - total) * 100 + 0.5) / 100, floor((s1 * o1 - total) * 100 + 0.5) / 100, CASE WHEN n = 3 THEN floor((s2 * o2 - total) * 100 + 0.5) / 100 ELSE 1e18 END) AS min_profit FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id, group_key ORDER BY min_profit > 0 DESC, min_profit DESC, abs(total - goal), m) AS r FROM p)
SELECT event_id, group_key, CAST(CAST(s0 AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(s1 AS BIGINT) AS VARCHAR) || CASE WHEN n = 3 THEN ',' || CAST(CAST(s2 AS BIGINT) AS VARCHAR) ELSE '' END AS stakes, CAST(total AS BIGINT) AS total, min_profit, min_profit > 0 AS positive FROM b WHERE r = 1"""


def bet_outcomes(spark, d):
    """Bets of several legs: expected and settled profit. A leg without a price makes the margin count instead."""
    li = B.read(spark, d, "lineitem").selectExpr("l_orderkey AS arb_id", "l_linenumber AS n", "l_partkey AS p", "l_suppkey AS s", "CAST(floor(l_quantity) AS DOUBLE) AS stake", "CASE WHEN l_partkey % 11 > 0 THEN CAST(101 + CAST(floor(l_extendedprice) AS BIGINT) % 240 AS DOUBLE) / 100 END AS odds")
    legs = li.groupBy("arb_id").agg(F.array_sort(F.collect_list(F.struct("n", "p", "s", "stake", "odds"))).alias("legs"))
    a = B.relation(spark, d, B.ARBS).join(legs, "arb_id")
    bets = a.withColumns({
        "stake": F.when(F.col("arb_id") % 4 == 0, F.lit(150.0)), "result": F.expr("CASE arb_id % 5 WHEN 0 THEN 'won' WHEN 1 THEN 'void' WHEN 2 THEN 'manual' END"), "winning_leg": F.col("duration_ms") % 3, "manual_profit": F.col("margin") * 2})
    out = output.bet_outcomes(bets)
    return out.select("arb_id", "total", "expected", "result", "profit")


BETS = f"""WITH {A}, li AS (SELECT l_orderkey AS arb_id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(floor(l_quantity) AS DOUBLE) AS stake, CASE WHEN l_partkey % 11 > 0 THEN CAST(101 + CAST(floor(l_extendedprice) AS BIGINT) % 240 AS DOUBLE) / 100 END AS odds FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY arb_id ORDER BY n, p, s, stake, odds) - 1 AS leg, sum(stake) OVER (PARTITION BY arb_id) AS whole, count(*) OVER (PARTITION BY arb_id) AS legs FROM li),
t AS (SELECT k.*, a.margin, a.duration_ms, CASE WHEN k.arb_id % 4 = 0 THEN CAST(150 AS DOUBLE) ELSE whole END AS total FROM k JOIN a USING (arb_id)),
p AS (SELECT *, {HALF.format(x='stake * odds - total', p='100')} AS profit FROM t),
g AS (SELECT arb_id, max(total) AS total, max(margin) AS margin, max(legs) AS legs, count(profit) AS complete, min(profit) AS worst, max(CASE WHEN leg = duration_ms % 3 THEN profit END) AS won FROM p GROUP BY arb_id)
SELECT arb_id, total, CASE WHEN legs >= 2 AND complete = legs THEN worst WHEN total <> 0 THEN {HALF.format(x='total * margin / (CAST(100 AS DOUBLE) + margin)', p='100')} END AS expected, CASE arb_id % 5 WHEN 0 THEN 'won' WHEN 1 THEN 'void' WHEN 2 THEN 'manual' END AS result, CASE arb_id % 5 WHEN 0 THEN won WHEN 1 THEN 0.0 WHEN 2 THEN margin * 2 END AS profit FROM g"""


def need_flags(spark, d):
    """Whether an opportunity likely ends before a bet is placed, or after its pause. Books accept after a time of their own."""
    slowest = B.relation(spark, d, B.LEGS).groupBy("arb_id").agg(F.max("bk").cast("long").alias("bk"))
    a = B.relation(spark, d, B.ARBS).where("reaction_ms IS NOT NULL").join(slowest, "arb_id").withColumn("pause_left_ms", F.col("duration_ms") % 400_000)
    needed = F.col("reaction_ms") + F.col("bk") * F.when(F.col("mode") == "PREMATCH", 300).otherwise(1500)
    out = MODEL.predict(a.withColumn("_needed", needed.cast("double")), F.col("_needed"))
    out = survival.flags(out, needed, F.round("p_needed", 9))
    return out.select("arb_id", "needed_ms", F.round("p_needed", 9).alias("p_needed"), "muted", "risky")


FLAGS = f"""WITH {A}, {L}, s AS (SELECT arb_id, max(bk) AS bk FROM l GROUP BY arb_id),
n AS (SELECT a.*, CAST(reaction_ms + bk * CASE WHEN mode = 'PREMATCH' THEN 300 ELSE 1500 END AS BIGINT) AS needed_ms, CASE mode WHEN 'PREMATCH' THEN -0.9 WHEN 'PAUSED' THEN -0.4 ELSE 0 END + CASE sport WHEN 'football' THEN 0 WHEN 'hockey' THEN 0.25 ELSE -0.1 END + 0.15 * (margin - 4) / 2 AS lp FROM a JOIN s USING (arb_id) WHERE reaction_ms IS NOT NULL),
h AS (SELECT *, CAST(needed_ms AS DOUBLE) AS x, exp(lp) AS r FROM n),
p AS (SELECT *, round(exp(-r * ({_H})), 9) AS p_needed, CASE WHEN exp(-CAST(0.01 AS DOUBLE) * r) <= 0.5 THEN 1000 WHEN exp(-CAST(0.08 AS DOUBLE) * r) <= 0.5 THEN 10000 WHEN exp(-CAST(0.3 AS DOUBLE) * r) <= 0.5 THEN 60000 WHEN exp(-CAST(0.9 AS DOUBLE) * r) <= 0.5 THEN 300000 WHEN exp(-CAST(2.5 AS DOUBLE) * r) <= 0.5 THEN 800000 END AS median_ms FROM h)
SELECT arb_id, needed_ms, p_needed, p_needed < 0.5 AS muted, coalesce(mode = 'PAUSED' AND median_ms > duration_ms % 400000, false) AS risky FROM p"""


def active_models(spark, d):
    r = B.read(spark, d, "customer").selectExpr("c_mktsegment AS kind", "CAST(floor(c_acctbal) AS BIGINT) AS trained_at", "c_custkey AS version", "c_nationkey < 20 AS active")
    return cox.active_models(r).select("kind", "trained_at", "version")


def restart_marked(spark, d):
    """After a restart, opportunities still open are ended where they were last confirmed: by a heartbeat, else by detection."""
    beats = B.relation(spark, d, B.ACTIONS).groupBy("arb_id").agg(F.max("ts").alias("beat"))
    a = B.relation(spark, d, B.ARBS).where("end_reason IS NULL").join(beats, "arb_id", "left")
    last = F.greatest("first_seen", F.coalesce("beat", "last_seen"))
    return a.select("arb_id", last.alias("last_seen"), F.lit("system_restart").alias("end_reason"), (last - F.col("first_seen")).alias("duration_ms"))


def active_sports(spark, d):
    return B.relation(spark, d, B.ARBS).where("end_reason IS NULL").groupBy("sport", "mode").agg(F.count(F.lit(1)).alias("n"))


def upserted(spark, d):
    """The newest row of each key after an upsert: returned lines over the others."""
    li = B.read(spark, d, "lineitem").selectExpr("l_partkey AS k", "l_returnflag AS flag", "l_orderkey * 100 + l_linenumber AS at", "l_extendedprice AS price")
    newest = F.max_by(F.struct("flag", "at", "price"), F.struct("at", "flag", "price"))
    side = lambda test: li.where(test).groupBy("k").agg(newest.alias("x")).select("k", "x.*")
    return feeds.upsert(side("flag <> 'R'"), side("flag = 'R'"), ["k"], "at")


QUERIES = {
    "market_labels": (market_labels, MARKET_LABELS),
    "detection_rows": (detection_rows, DETECTION),
    "fixed_stakes": (fixed_stakes, FIXED),
    "bet_outcomes": (bet_outcomes, BETS),
    "need_flags": (need_flags, FLAGS),
    "active_models": (active_models, "WITH r AS (SELECT c_mktsegment AS kind, CAST(floor(c_acctbal) AS BIGINT) AS trained_at, c_custkey AS version FROM customer WHERE c_nationkey < 20), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY trained_at DESC, version DESC) AS rn FROM r) SELECT kind, trained_at, version FROM k WHERE rn = 1"),
    "restart_marked": (restart_marked, f"WITH {A}, {C}, b AS (SELECT arb_id, max(ts) AS beat FROM c GROUP BY arb_id), m AS (SELECT a.*, greatest(first_seen, coalesce(beat, last_seen)) AS stop FROM a LEFT JOIN b USING (arb_id) WHERE end_reason IS NULL) SELECT arb_id, stop AS last_seen, 'system_restart' AS end_reason, stop - first_seen AS duration_ms FROM m"),
    "active_sports": (active_sports, f"WITH {A} SELECT sport, mode, count(*) AS n FROM a WHERE end_reason IS NULL GROUP BY sport, mode"),
    "upserted": (upserted, "WITH li AS (SELECT l_partkey AS k, l_returnflag AS flag, l_orderkey * 100 + l_linenumber AS at_ms, l_extendedprice AS price FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY flag = 'R' DESC, at_ms DESC, flag DESC, price DESC) AS rn FROM li) SELECT k, flag, at_ms AS \"at\", price FROM r WHERE rn = 1"),
}
