"""Queries on lifetimes: curves, hierarchy, predictions, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cox, survival
from ..operators.series import quantiles
from . import bindings as B
from .stat_plans import CENSORED, A


def _obs(spark, d):
    a = B.relation(spark, d, B.ARBS).where("end_reason IS NOT NULL")
    return a.select("arb_id", "first_seen", (F.floor(F.col("duration_ms") / 1000) * 1000).cast("long").alias("duration_ms"), (~S.is_censored(F.col("end_reason"))).alias("event"), "mode", "sport", "mtype", "pair", S.margin_band(F.col("margin")).alias("band"), "margin")


OBS = f"""{A}, o AS (SELECT arb_id, first_seen, duration_ms // 1000 * 1000 AS t, NOT {CENSORED} AS event, mode, sport, mtype, pair, margin, CASE WHEN margin < 1 THEN '0-1' WHEN margin < 2 THEN '1-2' WHEN margin < 3 THEN '2-3' WHEN margin < 5 THEN '3-5' ELSE '5+' END AS band FROM a WHERE end_reason IS NOT NULL),
seg AS (SELECT 0 AS level, 'mode=' || mode || '|sport=' || sport || '|mtype=' || mtype || '|pair=' || pair || '|band=' || band AS segment, t, event FROM o
UNION ALL SELECT 1, 'mode=' || mode || '|sport=' || sport || '|mtype=' || mtype || '|pair=' || pair, t, event FROM o UNION ALL SELECT 2, 'mode=' || mode || '|sport=' || sport || '|mtype=' || mtype, t, event FROM o
UNION ALL SELECT 3, 'mode=' || mode || '|sport=' || sport, t, event FROM o UNION ALL SELECT 4, 'mode=' || mode, t, event FROM o UNION ALL SELECT 5, 'all', t, event FROM o),
cnt AS (SELECT level, segment, t, count(*) FILTER (event) AS d, count(*) AS m FROM seg GROUP BY level, segment, t),
risk AS (SELECT *, CAST(sum(m) OVER (PARTITION BY segment ORDER BY t DESC) AS BIGINT) AS at_risk FROM cnt),
km AS (SELECT *, CASE WHEN max(CASE WHEN d = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0 END) OVER w) END AS s FROM risk WHERE d > 0 WINDOW w AS (PARTITION BY segment ORDER BY t)),
summ AS (SELECT c.level, c.segment, c.n, c.n_events, min(CASE WHEN s <= 0.75 + 1e-12 THEN t END) AS p25_ms, min(CASE WHEN s <= 0.5 + 1e-12 THEN t END) AS median_ms, min(CASE WHEN s <= 0.25 + 1e-12 THEN t END) AS p75_ms,
coalesce(min(CASE WHEN t <= 5000 THEN s END), 1) AS over_5, coalesce(min(CASE WHEN t <= 10000 THEN s END), 1) AS over_10, coalesce(min(CASE WHEN t <= 30000 THEN s END), 1) AS over_30, coalesce(min(CASE WHEN t <= 60000 THEN s END), 1) AS over_60
FROM (SELECT level, segment, CAST(sum(m) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS n_events FROM cnt GROUP BY level, segment) c LEFT JOIN km k ON c.segment = k.segment GROUP BY c.level, c.segment, c.n, c.n_events)"""


def km_by_mode(spark, d):
    return survival.kaplan_meier(_obs(spark, d), ["mode"]).select("mode", "t", "at_risk", "d", F.round("s", 9).alias("s"))


def km_hierarchy(spark, d):
    own = survival.summaries(survival.hierarchy(_obs(spark, d)), ["level", "segment"])
    return own.select(F.col("level").cast("long").alias("level"), "segment", "n", "n_events", "p25_ms", "median_ms", "p75_ms", *[F.round(f"over_{s}", 9).alias(f"over_{s}") for s in survival.POINTS_SEC])


def lifetime_predictions(spark, d):
    obs = _obs(spark, d)
    model = survival.summaries(survival.hierarchy(obs), ["level", "segment"])
    out = survival.predict(obs, model, "arb_id")
    return out.select("arb_id", F.col("level").cast("long").alias("level"), "segment", "n", "median_ms", F.round("over_30", 9).alias("over_30"))


PREDICT = f"""WITH {OBS}, k AS (SELECT arb_id, unnest([0, 1, 2, 3, 4, 5]) AS level, unnest(['mode=' || mode || '|sport=' || sport || '|mtype=' || mtype || '|pair=' || pair || '|band=' || band, 'mode=' || mode || '|sport=' || sport || '|mtype=' || mtype || '|pair=' || pair, 'mode=' || mode || '|sport=' || sport || '|mtype=' || mtype, 'mode=' || mode || '|sport=' || sport, 'mode=' || mode, 'all']) AS segment FROM o),
r AS (SELECT k.arb_id, k.level, k.segment, n, median_ms, over_30, row_number() OVER (PARTITION BY arb_id ORDER BY k.level) AS rn FROM k JOIN summ USING (segment) WHERE n >= 30)
SELECT arb_id, CAST(level AS BIGINT) AS level, segment, n, median_ms, round(over_30, 9) AS over_30 FROM r WHERE rn = 1"""


def survival_lookup(spark, d):
    obs = _obs(spark, d)
    points = survival.kaplan_meier(obs, ["mode"])
    asked = B.relation(spark, d, B.ARBS).where("reaction_ms IS NOT NULL").select("mode", F.col("arb_id").alias("id"), (F.col("reaction_ms") * 20).alias("needed_ms"))
    return survival.survival_at(points, asked, ["mode"], "needed_ms").select("id", "mode", "needed_ms", F.round("s", 9).alias("s"))


#: A small model for the scoring query.
MODEL = cox.CoxModel(
    categorical={"mode": ("LIVE", "PREMATCH", "PAUSED"), "sport": ("football", "hockey", "other")}, numeric={"margin": (4.0, 2.0)},
    coef={"mode=PREMATCH": -0.9, "mode=PAUSED": -0.4, "sport=hockey": 0.25, "sport=other": -0.1, "margin": 0.15}, baseline=((1000.0, 0.01), (10_000.0, 0.08), (60_000.0, 0.3), (300_000.0, 0.9), (800_000.0, 2.5)))


def cox_scores(spark, d):
    a = B.relation(spark, d, B.ARBS).where("reaction_ms IS NOT NULL")
    out = MODEL.predict(a, F.col("reaction_ms").cast("double") * 10)
    return out.select("arb_id", *[F.round(c, 9).alias(c) for c in ("lp", "over_5", "over_10", "over_30", "over_60", "p_needed")], "median_ms", "p25_ms", "p75_ms")


_H = "CASE WHEN x <= 0 THEN 0 WHEN x < 1000 THEN 0.01 * x / 1000 WHEN x < 10000 THEN 0.01 + 0.07 * (x - 1000) / 9000 WHEN x < 60000 THEN 0.08 + 0.22 * (x - 10000) / 50000 WHEN x < 300000 THEN 0.3 + 0.6 * (x - 60000) / 240000 WHEN x < 800000 THEN 0.9 + 1.6 * (x - 300000) / 500000 ELSE 2.5 END"
_Q = "CASE WHEN exp(-CAST(0.01 AS DOUBLE) * r) <= {p} THEN 1000.0 WHEN exp(-CAST(0.08 AS DOUBLE) * r) <= {p} THEN 10000.0 WHEN exp(-CAST(0.3 AS DOUBLE) * r) <= {p} THEN 60000.0 WHEN exp(-CAST(0.9 AS DOUBLE) * r) <= {p} THEN 300000.0 WHEN exp(-CAST(2.5 AS DOUBLE) * r) <= {p} THEN 800000.0 END"
COX = f"""WITH {A}, l AS (SELECT arb_id, CAST(reaction_ms AS DOUBLE) * 10 AS x, CASE mode WHEN 'PREMATCH' THEN -0.9 WHEN 'PAUSED' THEN -0.4 ELSE 0 END + CASE sport WHEN 'football' THEN 0 WHEN 'hockey' THEN 0.25 ELSE -0.1 END + 0.15 * (margin - 4) / 2 AS lp FROM a WHERE reaction_ms IS NOT NULL),
r AS (SELECT *, exp(lp) AS r FROM l)
SELECT arb_id, round(CAST(lp AS DOUBLE), 9) AS lp, round(exp(-r * (0.01 + 0.07 * 4 / 9)), 9) AS over_5, round(exp(-r * 0.08), 9) AS over_10, round(exp(-r * (0.08 + 0.22 * 0.4)), 9) AS over_30, round(exp(-r * 0.3), 9) AS over_60, round(exp(-r * ({_H})), 9) AS p_needed, CAST({_Q.format(p="0.5")} AS DOUBLE) AS median_ms, CAST({_Q.format(p="0.75")} AS DOUBLE) AS p25_ms, CAST({_Q.format(p="0.25")} AS DOUBLE) AS p75_ms FROM r"""


def cox_levels(spark, d):
    return cox.top_levels(_obs(spark, d), "pair", 3)


def risk_quintiles(spark, d):
    """Observations by exact quantile edges of the linear predictor, with mean predicted survival."""
    out = MODEL.predict(_obs(spark, d)).withColumn("lp", F.round("lp", 9))
    out = out.crossJoin(F.broadcast(quantiles(out, "lp", [0.2, 0.4, 0.6, 0.8], 0.001)))  # one row
    bucket = sum((F.when(F.col("lp") >= F.element_at("e", i), 1).otherwise(0) for i in range(1, 5)), F.lit(0))
    return out.groupBy(bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("long")).alias("events"), F.round(F.avg("over_30"), 6).alias("predicted"))


QUINTILES = f"""WITH {OBS}, l AS (SELECT *, round(CAST(CASE mode WHEN 'PREMATCH' THEN -0.9 WHEN 'PAUSED' THEN -0.4 ELSE 0 END + CASE sport WHEN 'football' THEN 0 WHEN 'hockey' THEN 0.25 ELSE -0.1 END + 0.15 * (margin - 4) / 2 AS DOUBLE), 9) AS lp FROM o),
e AS (SELECT quantile_cont(lp, [0.2, 0.4, 0.6, 0.8]) AS e FROM l)
SELECT CAST((lp >= e[1])::INT + (lp >= e[2])::INT + (lp >= e[3])::INT + (lp >= e[4])::INT AS BIGINT) AS bucket, count(*) AS n, count(*) FILTER (event) AS events, round(avg(exp(-exp(lp) * (0.08 + 0.22 * 0.4))), 6) AS predicted FROM l, e GROUP BY 1"""


def cox_training(spark, d):
    """Coefficients of a model trained on the observations; iterative, so without SQL."""
    model = cox.train(_obs(spark, d), {"mode": 50, "sport": 50, "mtype": 50, "pair": 15}, ["margin"])
    rows = [(k, round(v, 6)) for k, v in (model.coef if model else {}).items()] + ([("c_index", round(float(model.c_index), 6))] if model else [])
    return spark.createDataFrame(rows, "name string, value double")


QUERIES = {
    "km_by_mode": (km_by_mode, f"WITH {OBS}, k AS (SELECT * FROM km WHERE level = 4) SELECT substr(segment, 6) AS mode, t, at_risk, d, round(s, 9) AS s FROM k"),
    "km_hierarchy": (km_hierarchy, f"WITH {OBS} SELECT CAST(level AS BIGINT) AS level, segment, n, n_events, p25_ms, median_ms, p75_ms, round(over_5, 9) AS over_5, round(over_10, 9) AS over_10, round(over_30, 9) AS over_30, round(over_60, 9) AS over_60 FROM summ"),
    "lifetime_predictions": (lifetime_predictions, PREDICT),
    "survival_lookup": (survival_lookup, f"WITH {OBS}, p AS (SELECT substr(segment, 6) AS mode, t, s FROM km WHERE level = 4), q AS (SELECT arb_id AS id, mode, reaction_ms * 20 AS needed_ms FROM a WHERE reaction_ms IS NOT NULL) SELECT q.id, q.mode, q.needed_ms, round(coalesce(p.s, 1), 9) AS s FROM q ASOF LEFT JOIN p ON q.mode = p.mode AND q.needed_ms >= p.t"),
    "cox_scores": (cox_scores, COX),
    "cox_levels": (cox_levels, f"WITH {OBS} SELECT pair, count(*) AS n FROM o GROUP BY pair HAVING count(*) >= 5 ORDER BY n DESC, pair LIMIT 3"),
    "risk_quintiles": (risk_quintiles, QUINTILES),
    "cox_training": (cox_training, None),
}
