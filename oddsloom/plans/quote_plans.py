"""Queries on quotes: keys, validation, detection, stakes, change capture."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..domain import Settings
from ..functions import scalars as S
from ..operators import cdc, detect, stakes, validate
from ..operators.groups import SCHEMA, affected_rows, group_rows
from ..stored import shared_dir
from ..streaming import incremental
from . import bindings as B

SPORTS = ("football", "hockey", "basketball", "tennis")
SETTINGS = Settings()
#: "Now" of the batch queries: the start of 1998, with leg ages in days.
NOW = 883_612_800_000
DAYS = SETTINGS.merged({"modes": {"PREMATCH": {"max_leg_age_ms": 86_400_000 * 3000}, "PAUSED": {"max_leg_age_ms": 86_400_000 * 2000}, "LIVE": {"max_leg_age_ms": 86_400_000 * 1500}}})


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = B.relation(spark, sf_dir, B.QUOTES)
    ties = [F.col(c).desc() for c in ("u1", "u2", "u3", "u4", "odds", "is_open", "seen_at")]
    return detect.latest(q, ties).drop("u1", "u2", "u3", "u4")


def _groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(group_rows(list(SPORTS), list(B.MARKETS)), SCHEMA)


Q = f"""q AS ({B.sql(B.QUOTES)}),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, bk, market, sel ORDER BY changed_at DESC, u1 DESC, u2 DESC, u3 DESC, u4 DESC, odds DESC, is_open DESC, seen_at DESC) AS rn FROM q) WHERE rn = 1),
dim(sport, group_key, legs, leg, leg_sel, src, market, sel) AS ({B.group_values(group_rows(list(SPORTS), list(B.MARKETS)))})"""
BEST = """src AS (SELECT l.event_id, l.mode, l.bk, l.odds, l.changed_at, l.seen_at, d.* FROM {quotes} l JOIN dim d USING (sport, market, sel)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, group_key, leg ORDER BY odds DESC, bk, src) AS r FROM src) WHERE r = 1),
comb AS (SELECT event_id, sport, mode, group_key, count(*) AS found, min(legs) AS legs, count(DISTINCT bk) AS books, sum(1.0 / odds) AS inv, min(seen_at) >= max(changed_at) AS in_sync FROM best GROUP BY event_id, sport, mode, group_key)"""
LIMIT = "CASE mode WHEN 'PREMATCH' THEN 0.5 WHEN 'PAUSED' THEN 1.0 ELSE 1.5 END"


def latest_quotes(spark, sf_dir):
    return _quotes(spark, sf_dir).select("event_id", F.col("bk").cast("long").alias("bk"), "market", "sel", "odds", "is_open", "changed_at")


def best_quotes(spark, sf_dir):
    best = detect.best_legs(detect.leg_quotes(_quotes(spark, sf_dir).where("is_open"), _groups(spark)))
    return best.select("event_id", "group_key", F.col("leg").cast("long").alias("leg"), "leg_sel", F.col("bk").cast("long").alias("bk"), "market", "sel", "odds")


def detect_arbs(spark, sf_dir):
    found = detect.arbs(_quotes(spark, sf_dir), _groups(spark), SETTINGS, check_consensus=False)
    return found.select("event_id", "sport", "mode", "group_key", F.col("legs").cast("long").alias("legs"), "books", F.round("margin", 6).alias("margin"))


def incremental_arbs(spark, sf_dir):
    """The opportunities of ``detect_arbs``, found batch by batch: late quotes, a batch that comes twice, only touched groups looked at."""
    q = B.relation(spark, sf_dir, B.QUOTES)
    path = f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex}"
    ties = ["u1", "u2", "u3", "u4", "odds", "is_open", "seen_at"]
    for n in (0, 1, 2, 1, 2):
        incremental.evaluate(q.where(F.col("u3") % 3 == n), n, path, _groups(spark), SETTINGS, ties)
    found = incremental.current(spark, path)
    return found.select("event_id", "sport", "mode", "group_key", F.col("legs").cast("long").alias("legs"), "books", F.round("margin", 6).alias("margin"))


def detect_arbs_checked(spark, sf_dir):
    found = detect.arbs(_quotes(spark, sf_dir), _groups(spark), DAYS, F.lit(NOW))
    return found.select("event_id", "group_key", "mode", F.round("margin", 6).alias("margin"), F.round("inverse_sum", 9).alias("inverse_sum"))


def consensus_outliers(spark, sf_dir):
    q = detect.with_consensus(_quotes(spark, sf_dir))
    return q.where(detect.is_outlier(SETTINGS)).select("event_id", F.col("bk").cast("long").alias("bk"), "market", "sel", "odds", "others", F.round("consensus", 9).alias("consensus"))


CONSENSUS = """o AS (SELECT a.event_id, a.bk, a.market, a.sel, count(b.bk) AS others, percentile_cont(0.5) WITHIN GROUP (ORDER BY 1.0 / b.odds) AS consensus
  FROM latest a JOIN latest b ON a.event_id = b.event_id AND a.market = b.market AND a.sel = b.sel AND a.bk <> b.bk AND b.is_open GROUP BY a.event_id, a.bk, a.market, a.sel)"""
AGE = f"CASE l.mode WHEN 'PREMATCH' THEN {86_400_000 * 3000} WHEN 'PAUSED' THEN {86_400_000 * 2000} ELSE {86_400_000 * 1500} END"


def implied_sums(spark, sf_dir):
    found = detect.combinations(detect.best_legs(detect.leg_quotes(_quotes(spark, sf_dir).where("is_open"), _groups(spark))))
    return found.groupBy("sport", "group_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("inverse_sum"), 6).alias("avg_sum"), F.round(F.min("inverse_sum"), 9).alias("min_sum"))


def affected_groups(spark, sf_dir):
    table = spark.createDataFrame(affected_rows(list(SPORTS), list(B.MARKETS)), "sport string, market string, group_key string")
    changed = _quotes(spark, sf_dir).select("event_id", "sport", "market").distinct()
    return changed.join(F.broadcast(table), ["sport", "market"]).groupBy("sport", "group_key").agg(F.countDistinct("event_id").alias("events"))


def stake_plans(spark, sf_dir):
    found = detect.arbs(_quotes(spark, sf_dir), _groups(spark), SETTINGS, check_consensus=False)
    found = found.select("event_id", "group_key", F.transform("leg_list", lambda x: x["odds"]).alias("odds"))
    plan = stakes.allocate(found, ["event_id", "group_key"], "odds", 1000.0, 1.0)
    return plan.select("event_id", "group_key", F.array_join(F.transform("stakes", lambda s: s.cast("long").cast("string")), ",").alias("stakes"), F.col("total").cast("long").alias("total"), F.col("min_profit").alias("min_profit"), "positive")


STAKES = f"""WITH {Q}, {BEST.format(quotes="(SELECT * FROM latest WHERE is_open)")},
a AS (SELECT event_id, group_key, legs FROM comb WHERE found = legs AND books >= 2 AND (1 / inv - 1) * 100 >= {LIMIT}),
o AS (SELECT a.event_id, a.group_key, max(CASE WHEN leg = 0 THEN odds END) AS o0, max(CASE WHEN leg = 1 THEN odds END) AS o1, max(CASE WHEN leg = 2 THEN odds END) AS o2, max(a.legs) AS n FROM a JOIN best b ON a.event_id = b.event_id AND a.group_key = b.group_key GROUP BY a.event_id, a.group_key),
i AS (SELECT *, 1 / o0 + 1 / o1 + CASE WHEN n = 3 THEN 1 / o2 ELSE 0 END AS inv FROM o),
w AS (SELECT i.*, m, floor(1000 / o0 / inv) + m % 2 AS s0, floor(1000 / o1 / inv) + (m // 2) % 2 AS s1, CASE WHEN n = 3 THEN floor(1000 / o2 / inv) + (m // 4) % 2 END AS s2 FROM i, range(8) r(m) WHERE m < CASE WHEN n = 3 THEN 8 ELSE 4 END),
t AS (SELECT *, s0 + s1 + coalesce(s2, 0) AS total FROM w WHERE s0 > 0 AND s1 > 0 AND coalesce(s2, 1) > 0),
p AS (SELECT *, least(floor((s0 * o0 - total) * 100 + 0.5) / 100, floor((s1 * o1 - total) * 100 + 0.5) / 100, CASE WHEN n = 3 THEN floor((s2 * o2 - total) * 100 + 0.5) / 100 ELSE 1e18 END) AS min_profit FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id, group_key ORDER BY min_profit > 0 DESC, min_profit DESC, abs(total - 1000), m) AS r FROM p)
SELECT event_id, group_key, CAST(CAST(s0 AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(s1 AS BIGINT) AS VARCHAR) || CASE WHEN n = 3 THEN ',' || CAST(CAST(s2 AS BIGINT) AS VARCHAR) ELSE '' END AS stakes, CAST(total AS BIGINT) AS total, min_profit, min_profit > 0 AS positive FROM b WHERE r = 1"""


def market_keys(spark, sf_dir):
    d = B.read(spark, sf_dir, "lineitem").selectExpr("CASE l_linenumber WHEN 1 THEN 'OU' WHEN 2 THEN 'AH' WHEN 3 THEN 'OU_HOME' WHEN 4 THEN 'AH_SETS' WHEN 5 THEN '1X2' WHEN 6 THEN 'H_DA' ELSE 'XX' END AS mtype", "CAST(l_partkey % 41 - 20 AS DOUBLE) / 8 AS line").distinct()
    d = d.withColumn("key", S.market_key(F.col("mtype"), F.lit("REG"), F.col("line")))
    return d.select("mtype", "line", "key", S.norm_line(F.col("line")).alias("norm_line"), S.is_market_key(F.col("key")).alias("valid"), S.swap_market_key(F.col("key")).alias("swapped"), S.quarter_line(F.col("line")).alias("quarter")).distinct()


_LINE = "(floor({x} * 100 + 0.5) / 100 + 0.0)"
_TEXT = "CASE WHEN {l} < 0 THEN '-' ELSE '' END || CAST(CAST(floor(abs({l})) AS BIGINT) AS VARCHAR) || CASE WHEN CAST(floor(abs({l}) * 100 + 0.5) AS BIGINT) % 100 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(CAST(floor(abs({l}) * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0'), '0') END"
MARKET_KEYS = f"""WITH d AS (SELECT DISTINCT CASE l_linenumber WHEN 1 THEN 'OU' WHEN 2 THEN 'AH' WHEN 3 THEN 'OU_HOME' WHEN 4 THEN 'AH_SETS' WHEN 5 THEN '1X2' WHEN 6 THEN 'H_DA' ELSE 'XX' END AS mtype, CAST(l_partkey % 41 - 20 AS DOUBLE) / 8 AS line FROM lineitem),
n AS (SELECT *, {_LINE.format(x="line")} AS nl, {_LINE.format(x=f"(-{_LINE.format(x='line')})")} AS sl FROM d)
SELECT DISTINCT mtype, line, CASE WHEN mtype IN ('1X2', 'H_DA', 'XX') THEN mtype || '|REG' ELSE mtype || '|REG|' || {_TEXT.format(l="nl")} END AS key, nl AS norm_line, mtype <> 'XX' AS valid,
CASE WHEN mtype = 'OU' THEN 'OU|REG|' || {_TEXT.format(l="nl")} WHEN mtype = 'OU_HOME' THEN 'OU_AWAY|REG|' || {_TEXT.format(l="nl")} WHEN mtype IN ('AH', 'AH_SETS') THEN mtype || '|REG|' || {_TEXT.format(l="sl")} WHEN mtype = 'H_DA' THEN 'A_HD|REG' ELSE mtype || '|REG' END AS swapped,
abs(line * 2 - floor(line * 2 + 0.5)) > 1e-9 AS quarter FROM n"""


def swapped_selections(spark, sf_dir):
    return _quotes(spark, sf_dir).select("sel", S.swap_selection(F.col("sel")).alias("swapped")).groupBy("sel", "swapped").agg(F.count(F.lit(1)).alias("n"))


def normal_prices(spark, sf_dir):
    """Prices as different sites state them: rounded, cut, payout or fraction, comma decimals, with a fee."""
    d = B.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", "l_extendedprice / 997 AS x", "CAST(l_quantity AS DOUBLE) AS num", "CAST(l_partkey % 7 AS DOUBLE) AS den", "CASE WHEN l_partkey % 3 = 0 THEN l_extendedprice / 1999 END AS payout", "CAST(CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS STRING) AS digits")
    text = F.concat(F.col("digits"), F.lit(",25"))
    return d.select(
        "k", "n", S.site_price(F.col("x")).alias("rounded"), S.site_price(F.col("x"), floor=True).alias("cut"), S.fractional_price(F.col("payout"), F.col("num"), F.col("den")).alias("fraction"),
        S.comma_price(text).alias("comma"), F.round(S.effective_odds(F.col("x"), F.col("den")), 9).alias("effective"))


NORMAL_PRICES = """WITH d AS (SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice / 997 AS x, CAST(l_quantity AS DOUBLE) AS num, CAST(l_partkey % 7 AS DOUBLE) AS den, CASE WHEN l_partkey % 3 = 0 THEN l_extendedprice / 1999 END AS payout, CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS digits FROM lineitem),
r AS (SELECT *, floor(x * 100 + 0.5) / 100 AS rd, floor(x * 100 + 1e-6) / 100 AS ct FROM d)
SELECT k, n, CASE WHEN rd BETWEEN 1.01 AND 1000 THEN rd END AS rounded, CASE WHEN ct BETWEEN 1.01 AND 1000 THEN ct END AS cut, floor(coalesce(payout, CASE WHEN den > 0 THEN 1 + num / den END) * 100 + 1e-6) / 100 AS fraction,
CASE WHEN digits + 0.25 > 1 THEN floor((CAST(digits AS DOUBLE) + CAST(0.25 AS DOUBLE)) * 10000 + 0.5) / 10000 END AS comma, round(CASE WHEN den > 0 THEN x * (1 - den / 100) ELSE x END, 9) AS effective FROM r"""


def _feed(spark, sf_dir):
    """Batches of nested quotes: a fetch is (book, day); lines and prices as stated, some of them bad."""
    return B.read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 9).alias("bk"), (F.col("l_orderkey") % 50).alias("fetch_no"), (F.col("l_orderkey") % B.EVENTS).alias("event_id"),
        F.expr("CASE l_linenumber WHEN 1 THEN 'OU' WHEN 2 THEN 'AH' WHEN 3 THEN '1X2' ELSE 'DNB' END").alias("mtype"),
        F.expr("CAST(l_partkey % 9 - 4 AS DOUBLE) / 4").alias("line"),
        F.expr("CASE l_partkey % 4 WHEN 0 THEN 'HOME' WHEN 1 THEN 'AWAY' WHEN 2 THEN 'OVER' ELSE 'UNDER' END").alias("sel"),
        F.expr("CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1100 AS DOUBLE) / 100 + 0.95").alias("odds"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("pos"))


FEED_SQL = """f AS (SELECT l_suppkey % 9 AS bk, l_orderkey % 50 AS fetch_no, l_orderkey % 4000 AS event_id, CASE l_linenumber WHEN 1 THEN 'OU' WHEN 2 THEN 'AH' WHEN 3 THEN '1X2' ELSE 'DNB' END AS mtype, CAST(l_partkey % 9 - 4 AS DOUBLE) / 4 AS line,
CASE l_partkey % 4 WHEN 0 THEN 'HOME' WHEN 1 THEN 'AWAY' WHEN 2 THEN 'OVER' ELSE 'UNDER' END AS sel, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1100 AS DOUBLE) / 100 + 0.95 AS odds, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem),
j AS (SELECT *, CASE WHEN mtype IN ('OU', 'AH') AND abs(line * 2 - floor(line * 2 + 0.5)) > 1e-9 THEN 'quarter_line' WHEN NOT ((mtype = 'OU' AND sel IN ('OVER', 'UNDER')) OR (mtype IN ('AH', 'DNB', '1X2') AND sel IN ('HOME', 'AWAY'))) THEN 'foreign_selection'
WHEN row_number() OVER (PARTITION BY bk, fetch_no, event_id, mtype, CASE WHEN mtype IN ('OU', 'AH') THEN line END, sel ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) > 1 THEN 'duplicate' WHEN NOT (odds BETWEEN 1.01 AND 1000) THEN 'price' ELSE 'ok' END AS verdict FROM f)"""


def validation_verdicts(spark, sf_dir):
    judged = validate.judge_selections(_feed(spark, sf_dir), ("bk", "fetch_no"))
    return judged.groupBy("bk", "verdict").agg(F.count(F.lit(1)).alias("n"))


def validation_gate(spark, sf_dir):
    return validate.gate_batches(validate.judge_selections(_feed(spark, sf_dir), ("bk", "fetch_no")), ["bk", "fetch_no"], min_events=20, most_dropped=0.55).select("bk", "fetch_no", "events", "odds", "dropped", "accepted")


def quote_changes(spark, sf_dir):
    return cdc.changes(B.relation(spark, sf_dir, B.FEED), ["event_id", "bk", "market"], "fetched_at", ["odds"], ["uid"]).select("event_id", F.col("bk").cast("long").alias("bk"), "market", "uid", "odds", "previous_odds", "kind", "changed_at")


def late_fetches(spark, sf_dir):
    """Fetches older than one already applied in the same scope; ``uid`` is the order of arrival."""
    f = B.relation(spark, sf_dir, B.FEED).withColumn("arrived", F.col("uid") + (F.col("uid") % 7) * 13)
    return cdc.without_late(f, ["event_id", "bk", "live"], "fetched_at", ["arrived", "uid"]).groupBy("event_id").agg(F.count(F.lit(1)).alias("kept"), F.max("fetched_at").alias("last"))


def snapshot_diff(spark, sf_dir):
    """Two snapshots of the quote state (even and odd lines), compared by key."""
    q = B.relation(spark, sf_dir, B.QUOTES)
    ties = [F.col(c).desc() for c in ("u1", "u2", "u3", "u4", "odds", "is_open", "seen_at")]
    before, after = (detect.latest(q.where(c), ties).select("event_id", "bk", "market", "sel", "odds") for c in ("u3 % 2 = 0", "u3 % 2 = 1"))
    return cdc.snapshot_diff(before, after, ["event_id", "bk", "market", "sel"], ["odds"]).groupBy("market", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce(F.col("odds") - F.col("previous_odds"), F.lit(0.0))), 6).alias("moved"))


def quote_board(spark, sf_dir):
    """Prices of an event's outcomes over the books, best first."""
    q = _quotes(spark, sf_dir)
    return q.groupBy("event_id", "market", "sel").agg(F.count(F.lit(1)).alias("books"), F.max(F.when(F.col("is_open"), F.col("odds"))).alias("best"), F.min(F.when(F.col("is_open"), F.col("odds"))).alias("worst"))


def _snap(side: int) -> str:
    return f"(SELECT event_id, bk, market, sel, odds FROM (SELECT *, row_number() OVER (PARTITION BY event_id, bk, market, sel ORDER BY changed_at DESC, u1 DESC, u2 DESC, u3 DESC, u4 DESC, odds DESC, is_open DESC, seen_at DESC) AS rn FROM q WHERE u3 % 2 = {side}) WHERE rn = 1)"


def merged_sources(spark, sf_dir):
    """Listing and detail of the same events: what the detail has, it alone decides; of repeated rows the first stays."""
    li = B.read(spark, sf_dir, "lineitem").selectExpr(f"l_orderkey % {B.EVENTS} AS event_id", "l_linenumber AS market", "l_extendedprice AS price", "l_linestatus = 'F' AS detail", "l_partkey AS p", "l_suppkey AS s")
    listing, detail = li.where("NOT detail"), li.where("detail")
    return cdc.detail_over_listing(listing, detail, ["event_id"], ["event_id", "market"], [F.col("price"), F.col("p"), F.col("s")]).select("event_id", F.col("market").cast("long").alias("market"), "price", "origin")


QUERIES = {
    "latest_quotes": (latest_quotes, f"WITH {Q} SELECT event_id, CAST(bk AS BIGINT) AS bk, market, sel, odds, is_open, changed_at FROM latest"),
    "best_quotes": (best_quotes, f"WITH {Q}, {BEST.format(quotes='(SELECT * FROM latest WHERE is_open)')} SELECT event_id, group_key, CAST(leg AS BIGINT) AS leg, leg_sel, CAST(bk AS BIGINT) AS bk, market, sel, odds FROM best"),
    "detect_arbs": (detect_arbs, f"WITH {Q}, {BEST.format(quotes='(SELECT * FROM latest WHERE is_open)')} SELECT event_id, sport, mode, group_key, CAST(legs AS BIGINT) AS legs, books, round((1 / inv - 1) * 100, 6) AS margin FROM comb WHERE found = legs AND books >= 2 AND (1 / inv - 1) * 100 >= {LIMIT}"),
    "detect_arbs_checked": (detect_arbs_checked, f"""WITH {Q}, {CONSENSUS},
ok AS (SELECT l.* FROM latest l LEFT JOIN o ON l.event_id = o.event_id AND l.bk = o.bk AND l.market = o.market AND l.sel = o.sel WHERE NOT coalesce(o.others >= 3 AND abs(1 / l.odds - o.consensus) / o.consensus > 0.35, false) AND l.is_open AND {NOW} - l.seen_at <= 0.8 * {AGE}),
{BEST.format(quotes='ok')} SELECT event_id, group_key, mode, round((1 / inv - 1) * 100, 6) AS margin, round(inv, 9) AS inverse_sum FROM comb WHERE found = legs AND books >= 2 AND (1 / inv - 1) * 100 >= {LIMIT} AND (mode = 'PREMATCH' OR in_sync)"""),
    "consensus_outliers": (consensus_outliers, f"WITH {Q}, {CONSENSUS} SELECT l.event_id, CAST(l.bk AS BIGINT) AS bk, l.market, l.sel, l.odds, o.others, round(o.consensus, 9) AS consensus FROM latest l JOIN o ON l.event_id = o.event_id AND l.bk = o.bk AND l.market = o.market AND l.sel = o.sel WHERE o.others >= 3 AND abs(1 / l.odds - o.consensus) / o.consensus > 0.35"),
    "implied_sums": (implied_sums, f"WITH {Q}, {BEST.format(quotes='(SELECT * FROM latest WHERE is_open)')} SELECT sport, group_key, count(*) AS n, round(avg(inv), 6) AS avg_sum, round(min(inv), 9) AS min_sum FROM comb WHERE found = legs GROUP BY sport, group_key"),
    "affected_groups": (affected_groups, f"WITH {Q}, aff(sport, market, group_key) AS ({B.group_values(affected_rows(list(SPORTS), list(B.MARKETS)))}) SELECT sport, group_key, count(DISTINCT event_id) AS events FROM latest JOIN aff USING (sport, market) GROUP BY sport, group_key"),
    "stake_plans": (stake_plans, STAKES),
    "market_keys": (market_keys, MARKET_KEYS),
    "swapped_selections": (swapped_selections, f"WITH {Q} SELECT sel, CASE sel WHEN 'HOME' THEN 'AWAY' WHEN 'AWAY' THEN 'HOME' WHEN 'HOME_DRAW' THEN 'DRAW_AWAY' WHEN 'DRAW_AWAY' THEN 'HOME_DRAW' ELSE sel END AS swapped, count(*) AS n FROM latest GROUP BY sel"),
    "normal_prices": (normal_prices, NORMAL_PRICES),
    "validation_verdicts": (validation_verdicts, f"WITH {FEED_SQL} SELECT bk, verdict, count(*) AS n FROM j GROUP BY bk, verdict"),
    "validation_gate": (validation_gate, f"WITH {FEED_SQL} SELECT bk, fetch_no, count(DISTINCT event_id) AS events, count(*) AS odds, count(*) FILTER (verdict <> 'ok') AS dropped, count(DISTINCT event_id) >= 20 AND count(*) FILTER (verdict <> 'ok') <= 0.55 * count(*) AS accepted FROM j GROUP BY bk, fetch_no"),
    "quote_changes": (quote_changes, f"""WITH f AS ({B.sql(B.FEED)}), g AS (SELECT *, lag(odds) OVER w AS previous_odds, lag(uid) OVER w AS pu FROM f WINDOW w AS (PARTITION BY event_id, bk, market ORDER BY fetched_at, uid)),
k AS (SELECT *, CASE WHEN pu IS NULL THEN 'added' WHEN odds <> previous_odds THEN 'changed' ELSE 'seen' END AS kind FROM g)
SELECT event_id, CAST(bk AS BIGINT) AS bk, market, uid, odds, previous_odds, kind, last_value(CASE WHEN kind <> 'seen' THEN fetched_at END IGNORE NULLS) OVER (PARTITION BY event_id, bk, market ORDER BY fetched_at, uid ROWS UNBOUNDED PRECEDING) AS changed_at FROM k"""),
    "late_fetches": (late_fetches, f"WITH f AS (SELECT *, uid + (uid % 7) * 13 AS arrived FROM ({B.sql(B.FEED)})), g AS (SELECT *, max(fetched_at) OVER (PARTITION BY event_id, bk, live ORDER BY arrived, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM f) SELECT event_id, count(*) AS kept, max(fetched_at) AS last FROM g WHERE top IS NULL OR fetched_at >= top GROUP BY event_id"),
    "snapshot_diff": (snapshot_diff, f"WITH q AS ({B.sql(B.QUOTES)}), d AS (SELECT coalesce(a.market, b.market) AS market, CASE WHEN b.event_id IS NULL THEN 'added' WHEN a.event_id IS NULL THEN 'removed' WHEN a.odds <> b.odds THEN 'changed' ELSE 'seen' END AS kind, coalesce(a.odds - b.odds, 0) AS m FROM {_snap(1)} a FULL JOIN {_snap(0)} b ON a.event_id = b.event_id AND a.bk = b.bk AND a.market = b.market AND a.sel = b.sel) SELECT market, kind, count(*) AS n, round(sum(m), 6) AS moved FROM d GROUP BY market, kind"),
    "quote_board": (quote_board, f"WITH {Q} SELECT event_id, market, sel, count(*) AS books, max(CASE WHEN is_open THEN odds END) AS best, min(CASE WHEN is_open THEN odds END) AS worst FROM latest GROUP BY event_id, market, sel"),
    "merged_sources": (merged_sources, """WITH l AS (SELECT l_orderkey % 4000 AS event_id, CAST(l_linenumber AS BIGINT) AS market, l_extendedprice AS price, l_linestatus = 'F' AS detail, l_partkey AS p, l_suppkey AS s FROM lineitem),
u AS (SELECT *, 'detail' AS origin FROM l WHERE detail UNION ALL SELECT *, 'listing' AS origin FROM l WHERE NOT detail AND event_id NOT IN (SELECT event_id FROM l WHERE detail)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id, market ORDER BY price, p, s) AS rn FROM u) SELECT event_id, market, price, origin FROM r WHERE rn = 1"""),
}
QUERIES["incremental_arbs"] = (incremental_arbs, QUERIES["detect_arbs"][1])
