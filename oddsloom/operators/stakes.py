"""Stake allocation in whole units.

All ways to round the ideal stakes down or up (2 to the number of legs) are an array of a row; the best is its greatest by a
struct order: profitable in every outcome, then the least profit, then the total nearest to the bankroll, then the first way.
Where no way at the bankroll is profitable, neighbouring totals are tried, and the first that has a profitable way, in order
of distance (less before more), is taken. A row needs no other row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_up

MOST_STEPS = 400
_WAY = "struct<order:struct<positive:boolean,least:double,near:double,first:int>,stakes:array<double>,profits:array<double>,sum:double>"


def _inverse(odds: Column) -> Column:
    return F.aggregate(odds, F.lit(0.0), lambda s, o: s + F.lit(1.0) / o)


def _best(odds: Column, inverse: Column, total: Column, unit: float, bankroll: Column, fixed: tuple[Column, Column] | None = None) -> Column:
    """The best rounding of the ideal stakes for a total (null if none has only positive stakes); ``fixed`` is the place (from 1)
    and the stake of a leg that is given."""
    bit = lambda mask, i: mask.bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0
    rounded = lambda o, up: (F.floor(total / o / inverse / unit) + F.when(up, 1).otherwise(0)).cast("double") * unit
    masks = F.sequence(F.lit(0), F.pow(F.lit(2), F.size(odds)).cast("int") - 1)
    if fixed:
        place, given = fixed
        masks = F.filter(masks, lambda m: ~bit(m, place - 1))
        stake = lambda m: lambda o, i: F.when(i + 1 == place, given).otherwise(rounded(o, bit(m, i)))
    else:
        stake = lambda m: lambda o, i: rounded(o, bit(m, i))
    ways = F.transform(masks, lambda m: F.struct(m.alias("m"), F.transform(odds, stake(m)).alias("s")))
    ways = F.filter(ways, lambda w: F.forall(w["s"], lambda s: s > 0))
    ways = F.transform(ways, lambda w: F.struct(w["m"].alias("m"), w["s"].alias("s"), F.aggregate(w["s"], F.lit(0.0), lambda a, x: a + x).alias("t")))
    gain = lambda w: F.transform(F.arrays_zip(w["s"].alias("s"), odds.alias("o")), lambda x: half_up(x["s"] * x["o"] - w["t"], 2))
    ways = F.transform(ways, lambda w: F.struct(w["m"].alias("m"), w["s"].alias("s"), w["t"].alias("t"), gain(w).alias("p")))
    order = lambda w: F.struct((F.array_min(w["p"]) > 0).alias("positive"), F.array_min(w["p"]).alias("least"), (-F.abs(w["t"] - bankroll)).alias("near"), (-w["m"]).alias("first"))
    return F.array_max(F.transform(ways, lambda w: F.struct(order(w).alias("order"), w["s"].alias("stakes"), w["p"].alias("profits"), w["t"].alias("sum")))).cast(_WAY)


def _plan(df: DataFrame, keys: list[str], best: str) -> DataFrame:
    b = F.col(best)
    return df.where(b.isNotNull()).select(*keys, b["stakes"].alias("stakes"), b["profits"].alias("profits"), b["sum"].alias("total"), b["order"]["least"].alias("min_profit"), b["order"]["positive"].alias("positive"))


def allocate(arbs: DataFrame, keys: list[str], odds: str = "odds", bankroll: float = 10_000.0, unit: float = 1.0) -> DataFrame:
    """``stakes``, ``profits``, ``total``, ``min_profit``, ``positive`` for each row of ``arbs`` (an array of prices a row)."""
    bank, prices = F.lit(float(bankroll)), F.col(odds)
    steps = min(MOST_STEPS, int(bankroll / unit / 2))
    near = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max(1, steps))), lambda k: F.array(bank - k * unit, bank + k * unit)))
    near = F.filter(near, lambda t: (t > 0) & (t <= bankroll * 1.05))
    df = arbs.select(*keys, odds).withColumn("_inv", _inverse(prices)).withColumn("_first", _best(prices, F.col("_inv"), bank, unit, bank))

    def next_total(found: Column, total: Column) -> Column:
        tried = _best(prices, F.col("_inv"), total, unit, bank)
        return F.when(found.isNotNull(), found).otherwise(F.get(F.filter(F.array(tried), lambda w: F.coalesce(w["order"]["positive"], F.lit(False))), F.lit(0)))

    # a total is only tried while none before it was profitable
    second = F.aggregate(near, F.lit(None).cast(_WAY), next_total)
    positive = F.coalesce(F.col("_first")["order"]["positive"], F.lit(False))
    return _plan(df.withColumn("_best", F.when(positive, F.col("_first")).otherwise(F.coalesce(second, F.col("_first")))), keys, "_best")


def allocate_fixed(arbs: DataFrame, keys: list[str], place: Column, stake: Column, odds: str = "odds", unit: float = 1.0) -> DataFrame:
    """As :func:`allocate` when one leg's stake is given: the others cover its return."""
    own = arbs.select(*keys, odds, place.alias("_place"), stake.cast("double").alias("_given")).withColumn("_inv", _inverse(F.col(odds)))
    own = own.withColumn("_target", F.col("_given") * F.element_at(odds, F.col("_place")) * F.col("_inv"))
    best = _best(F.col(odds), F.col("_inv"), F.col("_target"), unit, F.col("_target"), (F.col("_place"), F.col("_given")))
    return _plan(own.withColumn("_best", best), keys, "_best")
