"""Queries on states of play, pauses seen from clocks, entity resolution as a whole, and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, ladder, review, states, tracker, validate
from ..stored import stored
from ..streaming import book_state
from . import bindings as B
from .quote_plans import CONSENSUS, SETTINGS, Q, _quotes
from .stat_plans import A

STATED = ("events", {
    "event_id": "event_id",
    "sport": "CASE user_id % 4 WHEN 0 THEN 'football' WHEN 1 THEN 'hockey' WHEN 2 THEN 'tennis' ELSE 'basketball' END",
    "status": "CASE event_id % 9 WHEN 0 THEN '1. poločas' WHEN 1 THEN 'Poločas' WHEN 2 THEN '2. třetina' WHEN 3 THEN 'Druhá přestávka' WHEN 4 THEN '3. čtvrtina' WHEN 5 THEN '2. set' WHEN 6 THEN 'Konec zápasu' WHEN 7 THEN '' ELSE 'po 1. setu' END",
    "live_time": "CASE WHEN event_id % 4 = 0 THEN concat(user_id % 90, chr(39)) END",
    "playtime_ms": "CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 30000) AS BIGINT) END",
    "timer_at": "{ms:ts}",
    "timer_paused": "event_id % 2 = 0",
    "counts_down": "user_id % 4 = 3",
    "now": "{ms:ts} + (event_id % 7) * 1000",
})


def game_states(spark, d):
    out = states.text_states(B.relation(spark, d, STATED))
    kept = ["period", "break_flag", "finished", "clock_s", "remaining_s", "clock_running"]
    return out.select("event_id", *[F.col(c).cast("long").alias(c) if c in ("period", "clock_s", "remaining_s") else F.col(c) for c in kept])


STATES = f"""WITH e AS ({B.sql(STATED)}),
s AS (SELECT *, trim(coalesce(nullif(status, ''), live_time, '')) AS t FROM e),
k AS (SELECT *, t IN ('Poločas', 'Druhá přestávka', 'po 1. setu') AS stopped, CASE WHEN playtime_ms IS NOT NULL THEN NOT timer_paused END AS running FROM s),
m AS (SELECT *, CASE WHEN coalesce(running, false) AND now > timer_at THEN now - timer_at ELSE 0 END AS drift FROM k)
SELECT event_id, CASE t WHEN '1. poločas' THEN 1 WHEN '2. třetina' THEN 2 WHEN 'Druhá přestávka' THEN 2 WHEN '3. čtvrtina' THEN 3 WHEN '2. set' THEN 2 WHEN 'po 1. setu' THEN 1 END::BIGINT AS period, stopped AS break_flag, t = 'Konec zápasu' AS finished,
CASE WHEN playtime_ms IS NOT NULL THEN CASE WHEN NOT counts_down THEN least(14400, greatest(0, CAST(floor(CAST(playtime_ms + drift AS DOUBLE) / 1000 + 0.5) AS BIGINT))) END WHEN sport <> 'tennis' THEN least(14400, CAST(rtrim(live_time, '''') AS BIGINT) * 60) END AS clock_s,
CASE WHEN playtime_ms IS NOT NULL AND counts_down THEN least(3600, greatest(0, CAST(floor(CAST(playtime_ms - drift AS DOUBLE) / 1000 + 0.5) AS BIGINT))) END AS remaining_s, CASE WHEN stopped THEN false ELSE running END AS clock_running FROM m"""


def swapped_states(spark, d):
    """Scores of events whose sides a source has the other way round."""
    li = B.read(spark, d, "lineitem").selectExpr("l_orderkey AS event_id", "l_linenumber AS n", "array(CAST(l_partkey % 7 AS INT), CAST(l_suppkey % 7 AS INT)) AS score")
    own = li.withColumn("state", F.struct("score", F.col("score").alias("games"), F.array_join("score", ":").alias("points"), F.array("score").alias("periods")))
    s = own.withColumn("x", states.swapped_state(F.col("state")))
    done = states.set_complete(F.element_at("score", 1), F.element_at("score", 2))
    return s.groupBy(F.array_join("x.score", "-").alias("score"), F.col("x.points").alias("points"), F.array_join(F.element_at("x.periods", 1), "-").alias("period"), done.alias("set_done")).agg(F.count(F.lit(1)).alias("n"))


SWAPPED = """WITH l AS (SELECT l_partkey % 7 AS h, l_suppkey % 7 AS a FROM lineitem) SELECT a || '-' || h AS score, a || ':' || h AS points, a || '-' || h AS period, (greatest(h, a) >= 6 AND greatest(h, a) - least(h, a) >= 2) OR (greatest(h, a) = 7 AND least(h, a) >= 5) AS set_done, count(*) AS n FROM l GROUP BY ALL"""


def period_clocks(spark, d):
    """Clocks stated as offsets within periods, as seconds of the match or as seconds left."""
    e = B.read(spark, d, "events").selectExpr("event_id", "CASE user_id % 4 WHEN 0 THEN 'football' WHEN 1 THEN 'handball' WHEN 2 THEN 'hockey' ELSE 'tennis' END AS sport", "CASE event_id % 3 WHEN 0 THEN 'FIRST_HALF' WHEN 1 THEN 'SECOND_HALF' ELSE 'FIRST_OVERTIME' END AS period", "CAST(floor(value * 10) AS BIGINT) % 900 AS offset", "CASE event_id % 2 WHEN 0 THEN 'RUNNING' ELSE 'STOPPED' END AS state")
    own = states.clock_seconds(F.col("sport"), F.col("period"), F.col("offset"), F.col("state"), F.lit(0), F.col("event_id") % 5 * 1000)
    return e.select("event_id", *[c.alias(n) for n, c in own.items()])


CLOCKS = """WITH e AS (SELECT event_id, user_id % 4 AS k, event_id % 3 AS p, CAST(floor(value * 10) AS BIGINT) % 900 AS o, CASE WHEN event_id % 2 = 0 THEN event_id % 5 ELSE 0 END AS since FROM events)
SELECT event_id, CASE k WHEN 0 THEN CASE p WHEN 0 THEN 0 WHEN 1 THEN 2700 ELSE 5400 END + o + since WHEN 1 THEN CASE p WHEN 0 THEN 0 WHEN 1 THEN 1800 ELSE 3600 END + o + since END AS clock_s, CASE k WHEN 2 THEN greatest(0, o - since) END AS remaining_s FROM e"""


REPORTS = ("events", {
    "event_id": "user_id % 25",
    "bk": "event_id % 3",
    "uid": "event_id",
    "at": "event_id * 400",
    "sport": "CASE user_id % 25 % 4 WHEN 0 THEN 'football' WHEN 1 THEN 'hockey' WHEN 2 THEN 'basketball' ELSE 'tennis' END",
    "competition": "CASE WHEN user_id % 25 % 8 = 2 THEN 'NBA' ELSE 'Liga' END",
    "period": "CASE WHEN event_id % 6 > 0 THEN CAST(event_id DIV 700 % 4 + 1 AS INT) END",
    "clock": "CASE WHEN user_id % 25 % 4 < 3 AND user_id % 25 % 12 <> 6 THEN CAST(CASE event_id DIV 400 % 3 WHEN 0 THEN CASE user_id % 25 % 4 WHEN 0 THEN 2700 WHEN 1 THEN 1200 ELSE 1440 END WHEN 1 THEN 777 ELSE event_id % 2700 END AS INT) END",
    "remaining": "CASE WHEN user_id % 25 % 12 = 6 THEN CAST(CASE event_id DIV 300 % 2 WHEN 0 THEN 0 ELSE event_id % 600 END AS INT) END",
    "score_key": "CAST(event_id DIV 650 % 5 AS VARCHAR(9))",
    "progress_key": "CASE WHEN event_id % 7 > 0 THEN CAST((event_id + user_id % 25 * 31) DIV 550 % 6 AS VARCHAR(9)) END",
    "games": "CASE WHEN event_id DIV 900 % 3 < 2 THEN 0 ELSE 3 END",
    "status": "CASE WHEN event_id % 31 = 0 THEN 'Poločas' WHEN event_id % 37 = 0 THEN '2. poločas' END",
    "flag": "CASE WHEN event_id % 19 = 0 THEN true WHEN event_id % 23 = 0 THEN false END",
    "clock_running": "CASE WHEN event_id % 29 = 0 THEN true END",
    "market_open": "event_id % 8 > 0",
    "finished": "event_id % 101 = 0",
})


def _breaks(spark, d, tennis: bool):
    out = tracker.breaks(B.relation(spark, d, REPORTS)).where((F.col("sport") == "tennis") if tennis else (F.col("sport") != "tennis"))
    return out.where("pause_source IS NOT NULL").select("event_id", F.col("bk").cast("long").alias("bk"), "uid", "pause_source", "pause_started", "pause_type")


def clock_pauses(spark, d):
    """Breaks told by feeds and seen from clocks, at each report."""
    return _breaks(spark, d, False)


def set_pauses(spark, d):
    """Breaks told by feeds and between sets, at each report."""
    return _breaks(spark, d, True)


def _break_sql(sports: str) -> str:
    """Report after report, each with the state that the one before left."""
    moved = lambda now, old: f"CASE WHEN NOT coalesce(e.finished, false) AND e.{now} IS NOT NULL AND (r.{old} IS NULL OR r.{old} <> e.{now}) THEN e.tm ELSE r.{old}_at END"
    kept = lambda now, old: f"CASE WHEN NOT coalesce(e.finished, false) AND e.{now} IS NOT NULL THEN e.{now} ELSE r.{old} END"
    return f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY event_id, bk ORDER BY tm, uid) AS n, coalesce(clock, -remaining) AS k, coalesce(score_key, '') AS s, coalesce(progress_key, '') AS g,
  coalesce(flag, false) OR coalesce(status = 'Poločas', false) AS told, coalesce(flag = false, false) OR coalesce(status = '2. poločas', false) OR coalesce(clock_running, false) AS plays, CASE sport WHEN 'tennis' THEN 30000 ELSE 45000 END AS patience,
  CASE sport WHEN 'football' THEN 'football_ht' WHEN 'hockey' THEN 'hockey_intermission' WHEN 'tennis' THEN 'tennis_set_break'
    ELSE CASE WHEN coalesce(contains(status, 'oločas'), false) OR coalesce(period, greatest(1, CAST(floor(clock / CASE competition WHEN 'NBA' THEN 720.0 ELSE 600.0 END + 0.5) AS INT))) = 2 THEN 'basketball_ht' ELSE 'basketball_quarter' END END AS kind,
  coalesce(remaining <= 1, false) OR coalesce(CASE sport WHEN 'football' THEN clock BETWEEN 2670 AND 3600 AND (period IS NULL OR period <= 1) WHEN 'hockey' THEN clock BETWEEN 1195 AND 3600 AND (clock % 1200 <= 3 OR clock % 1200 >= 1197)
    WHEN 'basketball' THEN clock >= CASE competition WHEN 'NBA' THEN 715 ELSE 595 END AND clock < CASE competition WHEN 'NBA' THEN 2880 ELSE 2400 END AND (clock % CASE competition WHEN 'NBA' THEN 720 ELSE 600 END <= 3 OR clock % CASE competition WHEN 'NBA' THEN 720 ELSE 600 END >= CASE competition WHEN 'NBA' THEN 717 ELSE 597 END) END, false) AS edge
  FROM ({B.sql((REPORTS[0], {{"at": "tm"}.get(k, k): v.replace(" DIV ", " // ") for k, v in REPORTS[1].items()}))}) WHERE {sports}),
r AS (SELECT DISTINCT event_id, bk, 0::BIGINT AS n, NULL::BIGINT AS uid, NULL::INT AS k, NULL::BIGINT AS k_at, NULL::INT AS period, NULL::BIGINT AS period_at, NULL::VARCHAR AS s, NULL::BIGINT AS s_at, NULL::VARCHAR AS g, NULL::BIGINT AS g_at, NULL::VARCHAR AS source, NULL::BIGINT AS started, NULL::VARCHAR AS type FROM f
  UNION ALL SELECT event_id, bk, n, uid, k, k_at, period, period_at, s, s_at, g, g_at, step[1], CASE step[1] WHEN step[2] THEN started WHEN 'feed' THEN tm WHEN 'clock' THEN CASE sport WHEN 'tennis' THEN period_at ELSE k_at END END, CASE step[1] WHEN step[2] THEN type WHEN 'feed' THEN kind WHEN 'clock' THEN kind END FROM (
    SELECT *, [CASE WHEN ended THEN NULL WHEN told THEN coalesce(source, 'feed') WHEN source = 'feed' THEN NULL
      WHEN source = 'clock' THEN CASE WHEN coalesce(k_at, 0) > started OR (sport = 'tennis' AND coalesce(g_at, 0) > started) OR plays OR coalesce(s_at, 0) > started THEN NULL ELSE 'clock' END
      WHEN NOT market_open OR plays THEN NULL
      WHEN sport = 'tennis' THEN CASE WHEN period_at IS NOT NULL AND games = 0 AND coalesce(own_period, 1) > 1 AND tm - greatest(period_at, coalesce(g_at, 0)) >= patience AND tm - period_at < 600000 THEN 'clock' END
      WHEN k_at IS NOT NULL AND tm - k_at >= patience AND coalesce(s_at, 0) <= k_at AND edge THEN 'clock' END, source] AS step FROM (
    SELECT e.event_id, e.bk, e.n, e.uid, e.tm, e.sport, e.told, e.plays, e.patience, e.kind, e.edge, e.games, e.market_open, coalesce(e.finished, false) AS ended, e.period AS own_period, r.source, r.started, r.type,
      {kept('k', 'k')} AS k, {moved('k', 'k')} AS k_at, {kept('period', 'period')} AS period, {moved('period', 'period')} AS period_at, {kept('s', 's')} AS s, {moved('s', 's')} AS s_at, {kept('g', 'g')} AS g, {moved('g', 'g')} AS g_at
      FROM r JOIN f e ON e.event_id = r.event_id AND e.bk = r.bk AND e.n = r.n + 1)))
SELECT event_id, CAST(bk AS BIGINT) AS bk, uid, source AS pause_source, started AS pause_started, type AS pause_type FROM r WHERE n > 0 AND source IS NOT NULL"""


PAUSES, SETS = _break_sql("sport <> 'tennis'"), _break_sql("sport = 'tennis'")


def _participants(spark, d):
    """Orders as feed entries (odd) and events (even): two part names each, some with marks a source adds."""
    part = B.read(spark, d, "part").select("p_partkey", "p_name")
    a = B.relation(spark, d, B.ARBS).select("arb_id", "sport", F.col("first_seen").alias("start"), F.col("duration_ms").alias("x"))
    n = F.lit(B.read(spark, d, "part").count())
    a = a.withColumn("_h", F.col("x") % n).withColumn("_a", F.floor(F.col("x") / 1000) % n).join(part.toDF("_h", "home"), "_h").join(part.toDF("_a", "away"), "_a").drop("_h", "_a", "x")
    marked = F.when(F.col("arb_id") % 4 == 1, F.concat(F.lit("FC "), F.initcap("home"))).otherwise(F.col("home"))
    entries = a.where("arb_id % 2 = 1").select(F.col("arb_id").alias("entry_id"), "sport", (F.col("arb_id") % 9).cast("int").alias("bk"), marked.alias("home"), "away", "start")
    return entries, a.where("arb_id % 2 = 0").select(F.col("arb_id").alias("event_id"), "sport", "home", "away", "start", F.hash("home").cast("long").alias("home_id"), F.hash("away").cast("long").alias("away_id"))


def resolved_entries(spark, d):
    """Every entry with its event, or that it waits for review, or makes an event of its own. Similarity is beyond SQL."""
    entries, events = (stored(df, "participants") for df in _participants(spark, d))  # all that follows reads them
    links = entries.select("bk", "entry_id", (F.col("entry_id") - 1).alias("event_id"), F.lit(False).alias("swapped")).where("entry_id % 10 = 1")
    aliases = events.select("sport", F.col("home").alias("raw_name"), F.col("home_id").alias("participant_id")).distinct().withColumn("bk", F.explode(F.array(*[F.lit(b) for b in range(0, 9, 4)])))
    rejected = entries.select("entry_id", (F.col("entry_id") + 1).alias("event_id")).where("entry_id % 10 = 3")
    return review.resolve(entries, events, links, aliases, rejected, SETTINGS)


def _queue(spark, d):
    a = B.relation(spark, d, B.ARBS)
    status = F.when(F.col("end_reason").isNull() | (F.col("mode") == "LIVE"), "pending").otherwise("confirmed")
    return a.select(F.col("arb_id").alias("entry_id"), status.alias("status"), F.col("first_seen").alias("start"), F.when(F.col("sport") != "tennis", F.col("arb_id") * 2).alias("candidate_event_id"), F.lit(False).alias("swapped"), "mode", "sport", "muted")


QUEUE = f"{A}, q AS (SELECT arb_id AS entry_id, CASE WHEN end_reason IS NULL OR mode = 'LIVE' THEN 'pending' ELSE 'confirmed' END AS status, first_seen AS start, CASE WHEN sport <> 'tennis' THEN arb_id * 2 END AS candidate_event_id, muted FROM a)"
LATER = 915_148_800_000


def review_queue(spark, d):
    return review.listed(review.expired(_queue(spark, d), F.lit(LATER))).select("entry_id", "start", "candidate_event_id")


def waiting_entries(spark, d):
    return review.waiting(review.expired(_queue(spark, d), F.lit(LATER)))


def review_answers(spark, d):
    q = review.expired(_queue(spark, d), F.lit(LATER))
    answers = q.where("status = 'pending'").select("entry_id", F.when(F.col("muted"), "reject").otherwise("confirm").alias("answer"), F.when(F.col("start") % 2 == 0, F.col("start")).alias("event_id"), F.lit(True).alias("swapped"))
    out = review.decided(q.drop("mode", "sport", "muted"), answers)
    return out.select("entry_id", "status", "candidate_event_id", "swapped")


ANSWERS = f"""WITH {QUEUE}, e AS (SELECT *, CASE WHEN status = 'pending' AND start < {LATER} - 14400000 THEN 'expired' ELSE status END AS s FROM q),
r AS (SELECT *, CASE WHEN s = 'pending' AND muted THEN 'rejected' WHEN s = 'pending' AND coalesce(CASE WHEN start % 2 = 0 THEN start END, candidate_event_id) IS NOT NULL THEN 'confirmed' ELSE s END AS t FROM e)
SELECT entry_id, t AS status, CASE WHEN s = 'pending' AND t = 'confirmed' THEN coalesce(CASE WHEN start % 2 = 0 THEN start END, candidate_event_id) ELSE candidate_event_id END AS candidate_event_id, s = 'pending' AND t = 'confirmed' AS swapped FROM r"""


def merged_aliases(spark, d):
    c = B.read(spark, d, "orders").selectExpr("o_custkey % 9 AS bk", "o_orderpriority AS sport", "CAST(o_custkey % 200 AS STRING) AS raw_name", "o_orderkey AS participant_id", "CASE WHEN o_orderstatus = 'P' THEN 'manual' ELSE 'auto' END AS source", "o_totalprice AS at")
    return review.merged_aliases(c)


def started_prematch(spark, d):
    """Events before their start that are near enough to follow, and how long since the others started."""
    a = B.relation(spark, d, B.ARBS).where("mode = 'PREMATCH'")
    return review.remembered(a.withColumn("start", F.col("first_seen")), F.lit(LATER)).groupBy("sport", (F.col("start") <= LATER).alias("started")).agg(F.count(F.lit(1)).alias("n"))


def fetch_freshness(spark, d):
    f = B.relation(spark, d, B.FEED).withColumn("now", F.col("fetched_at") + (F.col("uid") % 40 - 10) * 1000)
    return f.groupBy("bk", validate.freshness(F.col("fetched_at"), F.col("now"), 20_000).alias("verdict")).agg(F.count(F.lit(1)).alias("n")).withColumn("bk", F.col("bk").cast("long"))


def first_markets(spark, d):
    """Of a fetch's repeated events and markets the first by place stays."""
    li = B.read(spark, d, "lineitem").selectExpr("l_suppkey AS batch", "l_partkey AS source_id", "l_linenumber AS market", "l_orderkey AS pos", "l_extendedprice AS price", "l_quantity AS q")
    kept = validate.first_of(li, ["batch", "source_id", "market"], [F.col(c) for c in ("pos", "price", "q")])
    return kept.groupBy("batch").agg(F.count(F.lit(1)).alias("kept"), F.min("pos").alias("first_pos"), F.round(F.sum("price"), 2).alias("price"))


def consensus_gate(spark, d):
    """Books of whose quotes too many are far from what the others say are rejected."""
    q = detect.with_consensus(_quotes(spark, d)).where(F.col("others") >= SETTINGS.consensus_books)
    return validate.consensus_gate(q.withColumn("outlier", detect.is_outlier(SETTINGS)), ["bk", "market"]).withColumn("bk", F.col("bk").cast("long"))


def throttled_ticks(spark, d):
    """Ticks of each opportunity at least so long after the last one kept; depends on its own past, so without SQL."""
    li = B.relation(spark, d, B.ACTIONS).select("arb_id", (F.col("reaction_ms") % 1000).alias("at"), "uid")
    return ladder.throttled(li, ["arb_id"], "at", 200).groupBy("arb_id").agg(F.count(F.lit(1)).alias("kept"), F.min("at").alias("first"))


def book_changes(spark, d):
    """Changes that recorded fetches make to each book's state: late fetches, scopes and removals; stateful, so without SQL."""
    q = B.relation(spark, d, B.QUOTES).repartition("bk", "event_id")  # the one shuffle: all that follows is within a book's event
    fetch = ["bk", "event_id", "changed_at"]
    quote = F.struct("market", "sel", "odds", "is_open")
    once = q.groupBy(*fetch, "market", "sel").agg(F.max(F.struct("odds", "is_open")).alias("x")).select(*fetch, "market", "sel", "x.*")
    f = once.groupBy(*fetch).agg(F.array_sort(F.collect_list(quote)).alias("quotes"))
    f = f.select("bk", "event_id", F.when(F.col("event_id") % 3 == 0, "live").otherwise("prematch").alias("scope"), F.col("changed_at").alias("fetched_at"), F.col("changed_at").alias("seq"), F.lit("1").alias("source_id"), "quotes")
    return book_state.recorded_changes(f)


QUERIES = {
    "game_states": (game_states, STATES),
    "swapped_states": (swapped_states, SWAPPED),
    "period_clocks": (period_clocks, CLOCKS),
    "clock_pauses": (clock_pauses, PAUSES),
    "set_pauses": (set_pauses, SETS),
    "resolved_entries": (resolved_entries, None),
    "review_queue": (review_queue, f"WITH {QUEUE} SELECT entry_id, start, candidate_event_id FROM q WHERE status = 'pending' AND start >= {LATER} - 14400000 ORDER BY start, entry_id LIMIT 200"),
    "waiting_entries": (waiting_entries, f"WITH {QUEUE} SELECT count(*) AS n FROM q WHERE status = 'pending' AND start >= {LATER} - 14400000"),
    "review_answers": (review_answers, ANSWERS),
    "merged_aliases": (merged_aliases, "WITH c AS (SELECT o_custkey % 9 AS bk, o_orderpriority AS sport, CAST(o_custkey % 200 AS VARCHAR) AS raw_name, o_orderkey AS participant_id, CASE WHEN o_orderstatus = 'P' THEN 'manual' ELSE 'auto' END AS source, o_totalprice AS at_ms FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY bk, sport, raw_name ORDER BY source = 'manual' DESC, at_ms DESC, participant_id DESC) AS rn FROM c) SELECT bk, sport, raw_name, participant_id, source FROM r WHERE rn = 1"),
    "started_prematch": (started_prematch, f"WITH {A} SELECT sport, first_seen <= {LATER} AS started, count(*) AS n FROM a WHERE mode = 'PREMATCH' AND first_seen >= {LATER} - 28800000 GROUP BY 1, 2"),
    "fetch_freshness": (fetch_freshness, f"WITH f AS ({B.sql(B.FEED)}) SELECT CAST(bk AS BIGINT) AS bk, CASE WHEN uid % 40 - 10 > 20 THEN 'stale' WHEN 10 - uid % 40 > 5 THEN 'future' ELSE 'ok' END AS verdict, count(*) AS n FROM f GROUP BY 1, 2"),
    "first_markets": (first_markets, "WITH l AS (SELECT l_suppkey AS batch, l_extendedprice AS price, l_orderkey AS pos, row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_linenumber ORDER BY l_orderkey, l_extendedprice, l_quantity) AS rn FROM lineitem) SELECT batch, count(*) AS kept, min(pos) AS first_pos, round(sum(price), 2) AS price FROM l WHERE rn = 1 GROUP BY batch"),
    "consensus_gate": (consensus_gate, f"WITH {Q}, {CONSENSUS}, c AS (SELECT l.bk, l.market, abs(1 / l.odds - o.consensus) / o.consensus > 0.35 AS far FROM latest l JOIN o ON l.event_id = o.event_id AND l.bk = o.bk AND l.market = o.market AND l.sel = o.sel WHERE o.others >= 3) SELECT CAST(bk AS BIGINT) AS bk, market, count(*) AS compared, count(*) FILTER (far) AS outliers, NOT (count(*) >= 30 AND count(*) FILTER (far) > CAST(0.3 AS DOUBLE) * count(*)) AS accepted FROM c GROUP BY bk, market"),
    "throttled_ticks": (throttled_ticks, None),
    "book_changes": (book_changes, None),
}
