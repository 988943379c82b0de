"""Prices from models of play: goals, points, sets, and the steps in which prices move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_up

MOST_GOALS = 12


def poisson(rate: Column) -> Column:
    """Probabilities of 0 to 12 goals, scaled to one."""
    lam = F.greatest(rate, F.lit(1e-6))
    raw = F.transform(F.sequence(F.lit(0), F.lit(MOST_GOALS)), lambda k: F.exp(-lam + k * F.ln(lam) - F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, i: s + F.when(i > 0, F.ln(i.cast("double"))).otherwise(0.0))))
    return F.transform(raw, lambda p: p / F.aggregate(raw, F.lit(0.0), lambda s, x: s + x))


def goal_outcomes(df: DataFrame, home_rate: Column, away_rate: Column, home: Column | None = None, away: Column | None = None) -> DataFrame:
    """Adds ``p_home, p_draw, p_away, p_btts`` from the goals still expected and the score so far."""
    h0, a0 = home if home is not None else F.lit(0), away if away is not None else F.lit(0)
    df = df.withColumn("_ph", poisson(home_rate)).withColumn("_pa", poisson(away_rate)).withColumn("_h0", h0).withColumn("_a0", a0)
    cells = F.flatten(F.transform("_ph", lambda p, i: F.transform(F.col("_pa"), lambda q, j: F.struct((p * q).alias("p"), (F.col("_h0") + i).alias("h"), (F.col("_a0") + j).alias("a")))))
    df = df.withColumn("_cells", cells)
    total = lambda test: F.aggregate(F.filter("_cells", test), F.lit(0.0), lambda s, c: s + c["p"])
    out = df.withColumn("p_home", total(lambda c: c["h"] > c["a"])).withColumn("p_draw", total(lambda c: c["h"] == c["a"])).withColumn("p_away", total(lambda c: c["h"] < c["a"])).withColumn("p_btts", total(lambda c: (c["h"] > 0) & (c["a"] > 0)))
    return out.drop("_ph", "_pa", "_h0", "_a0", "_cells")


def normal_cdf(x: Column) -> Column:
    """Rational approximation of the normal distribution function (error below 1e-7)."""
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / F.sqrt(2 * F.pi()) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def points_over(line: Column, mean: Column, sd: Column) -> Column:
    """Chance of more points than a line, for sums that are about normal."""
    return 1 - normal_cdf((line - mean) / F.greatest(sd, F.lit(0.8)))


def sets_match(p_now: Column, p_set: Column, home: Column, away: Column) -> Column:
    """Chance of the match (two sets) given the chance of the set in play and of later ones."""
    first_more = F.when(home >= 1, 1.0).when(away >= 1, p_set).otherwise(1 - (1 - p_set) * (1 - p_set))
    first_less = F.when(away >= 1, 0.0).when(home >= 1, p_set).otherwise(p_set * p_set)
    return p_now * first_more + (1 - p_now) * first_less


def price_ladder(odds: Column) -> Column:
    """Prices on the steps in which books move them."""
    x = F.least(F.lit(1000.0), F.greatest(F.lit(1.01), odds))
    step = lambda per: F.floor(x * per + 0.5) / per
    return F.when(x < 3, half_up(x, 2)).when(x < 10, step(F.lit(20.0))).when(x < 30, step(F.lit(2.0))).otherwise(step(F.lit(1.0)))
