"""Queries on feeds and synthetic quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import epoch
from ..sources import feeds, market_ids, pricing
from ..stored import stored
from . import bindings as B


def shared_numbers(spark, d):
    """Lines as selections under shared market numbers, mapped to canonical markets; names, lines and outcomes partly unfit."""
    li = B.read(spark, d, "lineitem").selectExpr(
        "l_orderkey AS event_id", "CASE l_suppkey % 3 WHEN 0 THEN 'football' WHEN 1 THEN 'hockey' ELSE 'darts' END AS sport", "l_linenumber * 1000003 + l_partkey AS market_id",
        "CAST(CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 18 WHEN 3 THEN 16 WHEN 4 THEN 446 WHEN 5 THEN 366 WHEN 6 THEN 406 ELSE 999 END AS INT) AS number",
        "CASE WHEN l_partkey % 2 = 0 THEN 'Handicap – legy' ELSE 'Handicap – sety' END AS name", "CAST(l_partkey % 9 - 4 AS DOUBLE) / 2 AS line", "CAST(l_partkey % 5 AS STRING) AS part",
        "CAST(CASE l_linenumber WHEN 1 THEN l_quantity % 4 + 1 WHEN 2 THEN 12 + l_quantity % 2 WHEN 3 THEN 1714 + l_quantity % 2 WHEN 4 THEN 12 WHEN 5 THEN 1715 ELSE 4 END AS INT) AS outcome", "l_extendedprice / 1000 AS odds")
    specs = F.create_map(F.lit("hcp"), F.col("line").cast("string"), F.lit("total"), F.col("line").cast("string"), F.lit("periodnr"), F.col("part"))
    out = market_ids.mapped(li.withColumn("specs", specs))
    return out.groupBy("sport", "market", "sel").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("odds") * 100_000 + 0.5)).alias("odds"))


_T = "CASE WHEN line < 0 THEN '-' ELSE '' END || CAST(CAST(floor(abs(line)) AS BIGINT) AS VARCHAR) || CASE WHEN line = floor(line) THEN '' ELSE '.5' END"
SHARED = f"""WITH l AS (SELECT l_orderkey AS event_id, CASE l_suppkey % 3 WHEN 0 THEN 'football' WHEN 1 THEN 'hockey' ELSE 'darts' END AS sport, l_linenumber * 1000003 + l_partkey AS market_id, l_linenumber AS n, l_partkey, l_partkey % 5 AS part, CAST(l_partkey % 9 - 4 AS DOUBLE) / 2 AS line, CAST(l_quantity AS BIGINT) AS q, l_extendedprice / 1000 AS odds FROM lineitem),
m AS (SELECT *, CASE WHEN n = 1 AND sport <> 'darts' THEN '1X2|REG' WHEN n = 2 AND sport <> 'darts' AND line >= 0 THEN 'OU|REG|' || {_T} WHEN n = 3 AND sport <> 'darts' THEN 'AH|REG|' || {_T} WHEN n = 4 AND sport = 'hockey' AND part BETWEEN 1 AND 3 AND line >= 0 THEN 'OU|P' || part || '|' || {_T} WHEN n = 5 AND sport = 'darts' AND l_partkey % 2 = 0 THEN 'AH|MATCH|' || {_T} WHEN n = 6 AND sport = 'hockey' THEN 'ML|MATCH' END AS market,
CASE n WHEN 1 THEN CASE q % 4 WHEN 0 THEN 'HOME' WHEN 1 THEN 'DRAW' WHEN 2 THEN 'AWAY' END WHEN 2 THEN CASE q % 2 WHEN 0 THEN 'OVER' ELSE 'UNDER' END WHEN 3 THEN CASE q % 2 WHEN 0 THEN 'HOME' ELSE 'AWAY' END WHEN 4 THEN 'OVER' WHEN 5 THEN 'AWAY' ELSE 'HOME' END AS sel FROM l),
ok AS (SELECT * FROM m WHERE market IS NOT NULL AND (event_id, market_id) NOT IN (SELECT (event_id, market_id) FROM m WHERE market IS NOT NULL AND sel IS NULL))
SELECT sport, market, sel, count(*) AS n, CAST(sum(CAST(floor(odds * 100000 + 0.5) AS BIGINT)) AS BIGINT) AS odds FROM ok GROUP BY sport, market, sel"""


def market_uris(spark, d):
    li = B.read(spark, d, "lineitem").selectExpr("concat('uof:3/sr:sport:', l_suppkey % 5, '/', l_partkey % 300, '/', l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN concat('?total=', l_partkey % 7, '.5&setnr=', l_linenumber) ELSE '' END) AS uri")
    p = market_ids.parse_uri(F.col("uri"))
    return li.select(*[c.alias(n) for n, c in p.items()]).select(F.col("sport_no").cast("long").alias("sport_no"), F.col("number").cast("long").alias("number"), F.col("outcome").cast("long").alias("outcome"), F.col("specs")["total"].alias("total")).groupBy("sport_no", "number", "outcome", "total").agg(F.count(F.lit(1)).alias("n"))


def label_markets(spark, d):
    li = B.read(spark, d, "lineitem").selectExpr("l_orderkey AS event_id", "l_suppkey % 2 AS market_id", "element_at(array('1', 'x', '2', '1X', '12'), CAST(l_partkey % 5 + 1 AS INT)) AS label", "concat(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 20 AS STRING), ',5') AS price")
    out = feeds.label_markets(li)
    return out.groupBy("market", "sel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("odds"), 4).alias("odds"))


LABELS = """WITH l AS (SELECT l_orderkey AS event_id, l_suppkey % 2 AS market_id, ['1', 'X', '2', '1X', '12'][l_partkey % 5 + 1] AS label, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 20 AS DOUBLE) + 0.5 AS x FROM lineitem),
k AS (SELECT event_id, market_id, list_sort(list(DISTINCT label)) AS s FROM l GROUP BY event_id, market_id),
j AS (SELECT l.*, CASE WHEN s = ['1', '2', 'X'] THEN '1X2' WHEN s = ['1', '2'] THEN 'ML' END AS t FROM l JOIN k USING (event_id, market_id))
SELECT CASE t WHEN 'ML' THEN 'ML|MATCH' ELSE '1X2|REG' END AS market, CASE label WHEN '1' THEN 'HOME' WHEN '2' THEN 'AWAY' ELSE 'DRAW' END AS sel, count(*) AS n, round(sum(CASE WHEN x > 1 THEN x END), 4) AS odds FROM j WHERE t IS NOT NULL GROUP BY 1, 2"""


def journal_replay(spark, d):
    f = B.relation(spark, d, B.FEED).select("event_id", "bk", F.col("fetched_at").alias("at"), "odds", "uid", (F.col("uid") % 13 == 0).alias("removed"))
    keys = ["event_id", "bk"]
    early = f.where("at < 1705000000000").drop("removed")
    newest = F.max(F.struct("at", "uid", "odds"))
    snap = early.groupBy(*keys).agg(newest.alias("x")).select(*keys, "x.at", "x.odds", "x.uid")
    out = feeds.replay_journal(snap, f.where("at >= 1704900000000"), keys, 50_000_000)
    return out.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"), F.round(F.sum("odds"), 6).alias("odds"))


JOURNAL = f"""WITH f AS (SELECT event_id, bk, fetched_at AS at_ms, odds, uid, uid % 13 = 0 AS removed FROM ({B.sql(B.FEED)})),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, bk ORDER BY at_ms DESC, uid DESC) AS rn FROM f WHERE at_ms < 1705000000000) WHERE rn = 1),
u AS (SELECT event_id, bk, at_ms, odds, false AS removed, 0 AS side FROM s UNION ALL SELECT event_id, bk, at_ms, odds, removed, 1 FROM f WHERE at_ms >= 1704900000000 AND at_ms >= (SELECT max(at_ms) FROM s) - 50000000),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id, bk ORDER BY at_ms DESC, side DESC) AS rn FROM u)
SELECT event_id, count(*) AS n, max(at_ms) AS at, round(sum(odds), 6) AS odds FROM r WHERE rn = 1 AND NOT removed GROUP BY event_id"""


def fair_goals(spark, d):
    o = B.read(spark, d, "orders").selectExpr("o_orderkey AS event_id", "CAST(o_custkey % 30 AS DOUBLE) / 10 + 0.2 AS home_rate", "CAST(o_orderkey % 20 AS DOUBLE) / 10 + 0.1 AS away_rate", "CAST(o_orderkey % 3 AS INT) AS h", "CAST(o_custkey % 2 AS INT) AS a")
    kinds = o.groupBy("home_rate", "away_rate", "h", "a").agg(F.count(F.lit(1)).alias("n"))  # each state once
    out = pricing.goal_outcomes(kinds, F.col("home_rate"), F.col("away_rate"), F.col("h"), F.col("a"))
    return out.select("home_rate", "away_rate", F.col("h").cast("long").alias("h"), F.col("a").cast("long").alias("a"), "n", *[F.round(c, 9).alias(c) for c in ("p_home", "p_draw", "p_away", "p_btts")])


GOALS = """WITH o AS (SELECT CAST(o_custkey % 30 AS DOUBLE) / 10 + CAST(0.2 AS DOUBLE) AS home_rate, CAST(o_orderkey % 20 AS DOUBLE) / 10 + CAST(0.1 AS DOUBLE) AS away_rate, o_orderkey % 3 AS h, o_custkey % 2 AS a FROM orders),
k AS (SELECT home_rate, away_rate, h, a, count(*) AS n FROM o GROUP BY ALL),
g AS (SELECT CAST(i AS BIGINT) AS i FROM range(13) t(i)),
p AS (SELECT k.*, x.i AS x, y.i AS y, exp(-home_rate) * home_rate ** x.i / factorial(CAST(x.i AS INT)) AS px, exp(-away_rate) * away_rate ** y.i / factorial(CAST(y.i AS INT)) AS py FROM k, g x, g y)
SELECT home_rate, away_rate, h, a, n, round(sum(px * py) FILTER (h + x > a + y) / sum(px * py), 9) AS p_home, round(coalesce(sum(px * py) FILTER (h + x = a + y), 0) / sum(px * py), 9) AS p_draw, round(sum(px * py) FILTER (h + x < a + y) / sum(px * py), 9) AS p_away, round(sum(px * py) FILTER (h + x > 0 AND a + y > 0) / sum(px * py), 9) AS p_btts FROM p GROUP BY home_rate, away_rate, h, a, n"""


def ladder_prices(spark, d):
    li = B.read(spark, d, "lineitem").selectExpr("l_extendedprice / 700 AS x", "l_linenumber AS k")
    return li.select(pricing.price_ladder(F.col("x")).alias("price")).groupBy("price").agg(F.count(F.lit(1)).alias("n"))


def strategy_ladder(spark, d):
    """Health of each source from its log of outcomes: three failures in a row step down."""
    from ..operators import ladder

    f = B.relation(spark, d, B.FEED).select(F.col("bk").cast("long").alias("source"), F.col("fetched_at").alias("at"), "uid", (F.col("odds") > 1.8).alias("ok"))
    return ladder.failure_runs(f, ["source"], "at", ["uid"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("run").alias("longest"), F.sum(F.col("trips").cast("long")).alias("trips"))


def push_frames(spark, d):
    """Price messages as fixed-width text frames, read back and applied; some lines are no frames, some outcomes unknown."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    li = B.read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("q"))
    body = F.concat(F.lit('{"lp_num": '), F.col("q"), F.lit(', "lp_den": '), F.col("n"), F.lit(', "active": '), (F.col("q") % 2 == 0).cast("string"), F.lit("}"))
    user = F.when(F.col("n") % 2 == 0, F.concat(F.lit("U"), F.lit("0000000042"))).otherwise("G")
    line = F.concat(F.lit("MsEVENT"), F.lit("0" * 16), pad(F.col("l_orderkey"), 10), pad(F.col("l_orderkey") % 7, 10), user, F.lit("sPRICE"), pad(F.col("l_partkey"), 10), F.lit("000000000100"), body)
    frames = feeds.push_frames(li.select(F.when(F.col("l_suppkey") % 10 == 0, F.substr(line, F.lit(2))).otherwise(line).alias("value")))
    known = B.read(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").cast("string").alias("outcome_id"), F.col("p_brand").alias("market"))
    # summed by outcome, where the join has put the rows, so that frames are read once for both results
    sums = stored(feeds.price_messages(frames, known).groupBy("outcome_id", "market", "is_open").agg(F.count(F.lit(1)).alias("n"), F.sum("odds").alias("odds")), "outcomes")
    out = sums.where("market IS NOT NULL").groupBy("market", "is_open").agg(F.sum("n").alias("n"), F.round(F.sum("odds"), 2).alias("odds"))
    return out.unionByName(sums.where("market IS NULL").agg(F.count_distinct("outcome_id").alias("n")).select(F.lit("resync").alias("market"), F.lit(False).alias("is_open"), "n", F.lit(None).cast("double").alias("odds")))


FRAMES = """WITH l AS (SELECT l_partkey AS k, CAST(l_quantity AS BIGINT) AS q, CAST(floor((1 + CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) / l_linenumber) * 100 + 1e-6) AS DOUBLE) / 100 AS odds FROM lineitem WHERE l_suppkey % 10 <> 0),
j AS (SELECT l.*, p_brand AS market FROM l LEFT JOIN part ON k = p_partkey AND p_size > 5)
SELECT market, q % 2 = 0 AS is_open, count(*) AS n, round(sum(odds), 2) AS odds FROM j WHERE market IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'resync', false, count(DISTINCT k), NULL FROM j WHERE market IS NULL"""


def push_audit(spark, d):
    """Push types that map to another market than the listing has anywhere."""
    li = B.read(spark, d, "lineitem").select(F.col("l_partkey").alias("offer_id"), F.col("l_linenumber").cast("long").alias("push_type"), F.when((F.col("l_linenumber") == 3) & (F.col("l_suppkey") == 7), "B").otherwise("A").alias("market"))
    listing = B.read(spark, d, "part").select(F.col("p_partkey").alias("offer_id"), F.lit("A").alias("market"))
    return feeds.audit_push_types(listing, li)


def stated_times(spark, d):
    """Times as feeds state them: wrapped milliseconds, seconds, milliseconds, ISO text."""
    a = B.relation(spark, d, B.ARBS).select("arb_id", "first_seen")
    iso = F.date_format(epoch(F.col("first_seen")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = F.when(F.col("arb_id") % 4 == 0, F.concat(F.lit("/Date("), F.col("first_seen"), F.lit("+0200)/"))).when(F.col("arb_id") % 4 == 1, F.floor(F.col("first_seen") / 1000).cast("string")).when(F.col("arb_id") % 4 == 2, F.col("first_seen").cast("string")).otherwise(iso)
    return a.select("arb_id", feeds.any_time(text).alias("at"))


def silent_details(spark, d):
    f = B.relation(spark, d, B.FEED)
    newest = lambda test: f.where(test).groupBy("event_id").agg(F.max("fetched_at").alias("at"))
    return feeds.silent_details(newest("uid % 3 = 0"), newest("uid % 3 > 0"), F.lit(1_706_700_000_000))


def normalised_listing(spark, d):
    """A listing of entities that refer to each other by id: orders as events, lines as markets with two outcomes."""
    o = B.read(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS sportId", "o_custkey % 10 AS catId", "o_custkey % 100 AS champId", "array(o_custkey, (o_custkey * 7) % 1500) AS competitorIds", "o_orderdate AS startDate")
    keyed = B.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q")).selectExpr("l_orderkey", "l_orderkey * 10 + l_linenumber AS id", "l_linenumber AS typeId", "p", "q")
    events = o.join(keyed.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("id").alias("marketIds")), "id")
    markets = keyed.selectExpr("id", "typeId", "concat('m', typeId) AS name", "array(id * 2, id * 2 + 1) AS oddIds")
    odds = keyed.select("id", "p", "q", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).selectExpr("id * 2 + k AS id", "k AS typeId", "p + k AS price", "CAST(q AS INT) % 2 AS oddStatus")
    c = B.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    small = B.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    out = feeds.normalised_listing(events, markets, odds, c, small, small)
    return out.groupBy("home", "category", "is_open").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"), F.count("away").alias("away"), F.count("champ").alias("champ"))


LISTING = """WITH k AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
j AS (SELECT h.c_name AS home, a.c_name AS away, cat.n_name AS category, ch.n_name AS champ, CAST(q AS BIGINT) % 2 = 0 AS is_open, p + s.s AS price FROM orders JOIN k ON o_orderkey = l_orderkey CROSS JOIN (VALUES (0), (1)) s(s) LEFT JOIN customer h ON o_custkey = h.c_custkey LEFT JOIN customer a ON (o_custkey * 7) % 1500 = a.c_custkey LEFT JOIN nation cat ON o_custkey % 10 = cat.n_nationkey LEFT JOIN nation ch ON o_custkey % 100 = ch.n_nationkey)
SELECT home, category, is_open, count(*) AS n, CAST(sum(price) AS BIGINT) AS price, count(away) AS away, count(champ) AS champ FROM j GROUP BY home, category, is_open"""


def freshest_messages(spark, d):
    """The last message of each event over healthy connections."""
    f = B.relation(spark, d, B.FEED).select("event_id", F.struct("fetched_at", "uid").alias("at"), "odds", "uid", (F.col("bk") != 4).alias("healthy"))
    return feeds.freshest(f, ["event_id"], "at").select("event_id", "uid", "odds")


def detail_refresh(spark, d):
    """Details due for a refetch (older than three minutes, oldest first, 80 at most), and those young enough to be used."""
    a = B.relation(spark, d, B.ARBS).select("arb_id", (F.col("duration_ms")).alias("age_ms"), "mode")
    due = a.where("mode = 'PREMATCH' AND age_ms > 180000").orderBy(F.col("age_ms").desc(), "arb_id").limit(80)
    fresh = a.where("mode = 'PREMATCH' AND age_ms <= 480000")
    return due.select("arb_id", F.lit("refetch").alias("use")).unionByName(fresh.select("arb_id", F.lit("emit").alias("use")))


def virtual_names(spark, d):
    names = F.element_at(F.array(*[F.lit(x) for x in ("eFootball cup", "SRL League", "Virtual basketball", "Esta FC", "E-sports open", "cyber hockey", "Sparta")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    p = B.read(spark, d, "part").select(names.alias("name"))
    return p.groupBy("name", feeds.is_virtual(F.col("name")).alias("is_virtual")).agg(F.count(F.lit(1)).alias("n"))


VIRTUAL = "WITH p AS (SELECT ['eFootball cup', 'SRL League', 'Virtual basketball', 'Esta FC', 'E-sports open', 'cyber hockey', 'Sparta'][p_partkey % 7 + 1] AS name FROM part) SELECT name, name NOT IN ('Esta FC', 'Sparta') AS is_virtual, count(*) AS n FROM p GROUP BY name"


def fair_points(spark, d):
    """Chances of sums that are about normal: more points than a line, and a home win, from what is still expected."""
    o = B.read(spark, d, "orders").selectExpr("CAST(o_custkey % 40 AS DOUBLE) / 4 - 5 AS diff", "CAST(o_orderkey % 12 AS DOUBLE) AS sd", "CAST(o_custkey % 60 AS DOUBLE) + 140.5 AS line").distinct()
    over = pricing.points_over(F.col("line"), F.lit(170.0), F.col("sd"))
    return o.select("diff", "sd", "line", F.round(over, 9).alias("p_over"), F.round(pricing.points_over(F.lit(0.0), F.col("diff"), F.col("sd")), 9).alias("p_home"))


_RATIO = "(1 / (1 + CAST(0.2316419 AS DOUBLE) * abs({x})))"
_TAIL = "exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {t} * (CAST(0.319381530 AS DOUBLE) + {t} * (CAST(-0.356563782 AS DOUBLE) + {t} * (CAST(1.781477937 AS DOUBLE) + {t} * (CAST(-1.821255978 AS DOUBLE) + {t} * CAST(1.330274429 AS DOUBLE)))))"


def _cdf(x: str) -> str:
    tail = _TAIL.format(x=x, t=_RATIO.format(x=x))
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


POINTS = f"""WITH o AS (SELECT DISTINCT CAST(o_custkey % 40 AS DOUBLE) / 4 - 5 AS diff, CAST(o_orderkey % 12 AS DOUBLE) AS sd, CAST(o_custkey % 60 AS DOUBLE) + 140.5 AS line FROM orders),
z AS (SELECT *, (line - 170) / greatest(sd, CAST(0.8 AS DOUBLE)) AS z1, (0 - diff) / greatest(sd, CAST(0.8 AS DOUBLE)) AS z2 FROM o)
SELECT diff, sd, line, round(1 - {_cdf('z1')}, 9) AS p_over, round(1 - {_cdf('z2')}, 9) AS p_home FROM z"""


def fair_sets(spark, d):
    """Chance of a match of two won sets from the sets so far."""
    o = B.read(spark, d, "orders").selectExpr("CAST(o_custkey % 19 + 1 AS DOUBLE) / 20 AS p_now", "CAST(o_orderkey % 9 + 1 AS DOUBLE) / 10 AS p_set", "o_custkey % 2 AS home", "o_orderkey % 2 AS away").distinct()
    return o.select("p_now", "p_set", "home", "away", F.round(pricing.sets_match(F.col("p_now"), F.col("p_set"), F.col("home"), F.col("away")), 9).alias("p"))


SETS = """WITH o AS (SELECT DISTINCT CAST(o_custkey % 19 + 1 AS DOUBLE) / 20 AS c, CAST(o_orderkey % 9 + 1 AS DOUBLE) / 10 AS p, o_custkey % 2 AS h, o_orderkey % 2 AS a FROM orders)
SELECT c AS p_now, p AS p_set, h AS home, a AS away, round(CASE WHEN h = 0 AND a = 0 THEN c * (p + (1 - p) * p) + (1 - c) * p * p WHEN h = 1 AND a = 0 THEN c + (1 - c) * p WHEN h = 0 THEN c * p ELSE c END, 9) AS p FROM o"""


QUERIES = {
    "shared_numbers": (shared_numbers, SHARED),
    "market_uris": (market_uris, "WITH l AS (SELECT l_suppkey % 5 AS sport_no, l_partkey % 300 AS number, CAST(l_linenumber AS BIGINT) AS outcome, CASE WHEN l_partkey % 2 = 0 THEN (l_partkey % 7) || '.5' END AS total FROM lineitem) SELECT sport_no, number, outcome, total, count(*) AS n FROM l GROUP BY ALL"),
    "label_markets": (label_markets, LABELS),
    "journal_replay": (journal_replay, JOURNAL),
    "fair_goals": (fair_goals, GOALS),
    "ladder_prices": (ladder_prices, "WITH x AS (SELECT least(1000.0, greatest(CAST(1.01 AS DOUBLE), l_extendedprice / 700)) AS x FROM lineitem) SELECT CASE WHEN x < 3 THEN floor(x * 100 + 0.5) / 100 WHEN x < 10 THEN floor(x * 20 + 0.5) / 20 WHEN x < 30 THEN floor(x * 2 + 0.5) / 2 ELSE floor(x + 0.5) END AS price, count(*) AS n FROM x GROUP BY 1"),
    "strategy_ladder": (strategy_ladder, f"""WITH f AS (SELECT CAST(bk AS BIGINT) AS source, fetched_at AS at_ms, uid, odds > 1.8 AS ok FROM ({B.sql(B.FEED)})), g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY at_ms, uid) AS k FROM f),
r AS (SELECT *, CASE WHEN ok THEN 0 ELSE sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY source, k ORDER BY at_ms, uid) END AS run FROM g) SELECT source, count(*) AS n, CAST(max(run) AS BIGINT) AS longest, count(*) FILTER (run > 0 AND run % 3 = 0) AS trips FROM r GROUP BY source"""),
    "push_frames": (push_frames, FRAMES),
    "push_audit": (push_audit, "SELECT CAST(l_linenumber AS BIGINT) AS push_type, count(*) AS n, NOT bool_or(l_linenumber = 3 AND l_suppkey = 7) AS agrees FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_linenumber"),
    "stated_times": (stated_times, f"SELECT arb_id, CASE WHEN arb_id % 4 = 1 THEN first_seen // 1000 * 1000 ELSE first_seen END AS \"at\" FROM ({B.sql(B.ARBS)})"),
    "silent_details": (silent_details, f"WITH f AS ({B.sql(B.FEED)}), g AS (SELECT event_id, max(fetched_at) FILTER (uid % 3 = 0) AS o, max(fetched_at) FILTER (uid % 3 > 0) AS dt FROM f GROUP BY event_id) SELECT event_id FROM g WHERE o - dt > 1000 AND 1706700000000 - dt >= 3000"),
    "normalised_listing": (normalised_listing, LISTING),
    "freshest_messages": (freshest_messages, f"WITH f AS ({B.sql(B.FEED)}), r AS (SELECT event_id, uid, odds, row_number() OVER (PARTITION BY event_id ORDER BY fetched_at DESC, uid DESC) AS rn FROM f WHERE bk <> 4) SELECT event_id, uid, odds FROM r WHERE rn = 1"),
    "detail_refresh": (detail_refresh, f"WITH a AS (SELECT * FROM ({B.sql(B.ARBS)}) WHERE mode = 'PREMATCH') (SELECT arb_id, 'refetch' AS use FROM a WHERE duration_ms > 180000 ORDER BY duration_ms DESC, arb_id LIMIT 80) UNION ALL SELECT arb_id, 'emit' FROM a WHERE duration_ms <= 480000"),
    "virtual_names": (virtual_names, VIRTUAL),
    "fair_points": (fair_points, POINTS),
    "fair_sets": (fair_sets, SETS),
}
