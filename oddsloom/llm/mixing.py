"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of words: its share of ``budget`` times all words by weight, no more than ``most``
times its own words, the excess reshared by weight. Document rates are the base rates (1 by default) exponentially
tilted by the quantity that is constrained, the document's words: ``min(most, base * exp(lambda_source * words / mean))``.
Of all rates up to ``most`` that meet the source's word target these have the least entropy relative to the base rates. The
multipliers solve the convex dual by Newton steps inside a bracket; each step is one aggregate over the documents' cells
(source, size, base rate) with exact sums, so that reruns agree to the last bit.

Rates, in billionths, are then rounded to whole copies: cells of a source in order of size share one running sum of rates,
and a document gets as many copies as whole numbers its rate passes, so that the words taken miss the target by about one
document; ``polish`` rounds of one copy more or less in the cell whose size comes nearest close that gap. What is
left is ``target`` less ``source_taken``.

Sources are ordered by code point, null last, and weigh 3, 1, 2, repeating. Sources and multipliers are tables,
however many there are. Documents without words take none and get the copies of their base rate; null texts have no words.
Base rates are taken in thousandths. Rows with equal ids are told apart only by the order in which their copies fall, which
yields the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_table, fresh, materialize, with_ordinals, word_count

WEIGHTS = (3, 1, 2)
UNIT = 1_000_000_000
#: Steps end when every source's words are this near to the target, in proportion; rounding to copies is coarser.
NEAR = 1e-7


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", base_rate: str | None = None, budget: float = 1.5, most: int = 2, polish: int = 8) -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target``, ``source_taken``, ``rate``, ``copies``, ``taken`` of every document."""
    q = F.round(F.coalesce(F.col(base_rate).cast("double"), F.lit(0.0)) * 1000).cast("long") if base_rate else F.lit(1000).cast("long")
    source = F.col(source_col).cast("string")
    base = docs.select(
        F.col(id_col).alias("_id"), F.when(source.isNull(), "z").otherwise(F.concat(F.lit("s"), source)).alias("_key"), word_count(F.col(text_col)).alias("_size"),
        F.least(F.greatest(q, F.lit(0)), F.lit(most * 1000)).cast("long").alias("_q"))
    base = materialize(base, "mix")
    cells = materialize(base.groupBy("_key", "_size", "_q").agg(F.count(F.lit(1)).alias("_n")), "cells")
    sources = targets(cells, budget, most)
    tilts = solve(cells, sources, most)

    # a cell starts where the running sum of the smaller cells of its source ends
    rated = cells.join(tilts, "_key").withColumn("_rate", _rate(most))
    before = Window.partitionBy("_key").orderBy("_size", "_q").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(_whole("_n") * F.col("_rate")).over(before), F.lit(0).cast("decimal(38,0)"))
    rated = rated.withColumn("_start", F.pmod(run + UNIT // 2, F.lit(UNIT).cast("decimal(38,0)")).cast("long"))
    rated = rated.withColumn("_copies", _passed(F.col("_n")) - _passed(F.lit(0))).select("_key", "_size", "_q", "_n", "_rate", "_start", "_copies", "source_size", "target")
    found = rated.groupBy("_key").applyInPandas(polisher(most, polish), "_key string, _size long, _q long, _rate long, _start long, source_size long, target double, source_taken long, _fixed long, _d int")

    rows = cells.agg(F.sum("_n")).first()[0] or 0
    numbered = with_ordinals(base, ["_key", "_size", "_q"], rows, "_o", [F.xxhash64("_id"), F.col("_id")], F.col("_id"), more=found)
    fix = F.when(F.col("_o") == F.col("_fixed"), F.col("_d")).otherwise(0)
    copies = _passed(F.col("_o") + 1) - _passed(F.col("_o")) + fix
    return numbered.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "source_taken", (F.col("_rate") / UNIT).alias("rate"),
        copies.cast("int").alias("copies"), (copies * F.col("_size")).cast("long").alias("taken"))


def targets(cells: DataFrame, budget: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(``_key``, ``source_size``, ``mean``, ``target``) of every source: shares by weight, stopped at ``most`` times the size, excess reshared.

    A share is level times weight; a source stops where that passes its limit, which raises the level of the others. Each
    round is one aggregate, until the level stands.
    """
    sized = cells.groupBy("_key").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"), F.sum(F.when(F.col("_size") > 0, F.col("_n"))).alias("_docs"))
    # ordinals of the sources: range partitions in order, numbered inside and by the counts of those before. "z" (null) sorts after "s..."
    ranged = materialize(sized.repartitionByRange("_key").withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))
    first = counts.select(F.col("_part"), F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_key")) - 1
    place = ((F.col("_first") + F.col("_inside")) % len(weights) + 1).cast("int")
    ordered = ranged.withColumn("_inside", inside).join(first, "_part").withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), place))
    ordered = materialize(ordered.select("_key", "source_size", "_weight", (F.col("source_size") / F.greatest(F.col("_docs"), F.lit(1))).alias("mean")), "sources")
    drop_table(ranged)

    limit, level = F.col("source_size") * float(most), 0.0
    while True:
        stopped = limit < F.col("_weight") * level
        words, used, weight = ordered.agg(F.sum("source_size"), F.sum(F.when(stopped, F.col("source_size"))), F.sum(F.when(~stopped, F.col("_weight")))).first()
        if not weight:
            break
        now = (budget * words - float(most) * (used or 0)) / weight
        if now <= level:
            break
        level = now
    return ordered.select("_key", "source_size", "mean", F.least(limit, F.col("_weight") * level).alias("target"))


def solve(cells: DataFrame, sources: DataFrame, most: int, steps: int = 80) -> DataFrame:
    """``sources`` with ``_tilt``: Newton on the dual of the word constraints, all sources at once.

    A step is one aggregate over the cells and gives each source's words at its present multiplier and their derivative. A
    Newton step that leaves the bracket of multipliers known to be too low and too high is replaced by its middle. A source
    whose target is all it can give takes ``most`` of everything (multiplier infinite), one whose target is nothing gives none.
    """
    weight = _whole(F.col("_n") * F.col("_size"))
    able = cells.where("_q > 0").groupBy("_key").agg(F.sum(F.col("_n") * F.col("_size")).alias("_able"))
    now = sources.join(able, "_key", "left").withColumn("_reach", F.coalesce("_able", F.lit(0)) * float(most))
    infinite = F.lit(float("inf"))
    start = F.when(F.col("target") <= 0, -infinite).when(F.col("target") >= F.col("_reach"), infinite).otherwise(0.0)
    watch = Observation()
    left = F.sum((~F.col("_done")).cast("long")).alias("left")
    now = materialize(now.select(*sources.columns, start.alias("_tilt"), (-infinite).alias("_lo"), infinite.alias("_hi"), (F.abs(start) == infinite).alias("_done")).observe(watch, left), "tilt")
    for _ in range(steps):
        if not watch.get.get("left"):
            break
        open_, watch = now.where("not _done"), Observation()
        rate = _rate(most)
        free = F.when(rate < most * UNIT, weight * _whole("_size") * rate)
        got = cells.where("_size > 0").join(open_.select("_key", "mean", "_tilt"), "_key").groupBy("_key").agg(
            (F.sum(weight * rate).cast("double") / UNIT).alias("_g"), (F.sum(free).cast("double") / UNIT / F.first("mean")).alias("_h"))
        gap = F.col("target") - F.col("_g")
        lo = F.when(gap > 0, F.col("_tilt")).otherwise(F.col("_lo"))
        hi = F.when(gap < 0, F.col("_tilt")).otherwise(F.col("_hi"))
        # as long as one side is open, a step at most doubles the multiplier or moves it by 1
        reach = F.greatest(F.lit(1.0), F.abs("_tilt"))
        newton = F.col("_tilt") + F.greatest(-reach, F.least(reach, F.when(F.col("_h") > 0, gap / F.col("_h")).otherwise(F.signum(gap) * reach)))
        moved = now.join(got, "_key", "left").withColumn("_l", lo).withColumn("_u", hi).withColumn("_near", F.abs(gap) <= NEAR * F.col("target")).withColumn("_new", newton)
        inside = (F.col("_new") > F.col("_l")) & (F.col("_new") < F.col("_u"))
        done = F.col("_done") | F.coalesce("_near", F.lit(True)) | (F.col("_u") - F.col("_l") <= 1e-14)
        tilt = F.when(done, F.col("_tilt")).when(inside, F.col("_new")).otherwise((F.col("_l") + F.col("_u")) / 2)
        after = materialize(moved.select(*sources.columns, tilt.alias("_tilt"), F.col("_l").alias("_lo"), F.col("_u").alias("_hi"), done.alias("_done")).observe(watch, left), "tilt")
        drop_table(now)
        now = after
    return now.select(*sources.columns, "_tilt")


def _rate(most: int) -> Column:
    """A document's rate in billionths at multiplier ``_tilt``."""
    tilted = F.when(F.col("_size") > 0, F.least(F.col("_q") / 1000 * F.exp(F.col("_tilt") * F.col("_size") / F.col("mean")), F.lit(float(most)))).otherwise(F.col("_q") / 1000)
    return F.when(F.col("_q") == 0, 0).otherwise(F.floor(tilted * UNIT + 0.5)).cast("long")


def _whole(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)")


def _passed(ordinal: Column) -> Column:
    """Whole numbers passed after so many documents of the cell."""
    return F.floor((_whole("_start").cast("decimal(38,0)") + _whole(ordinal) * F.col("_rate")) / F.lit(UNIT).cast("decimal(38,0)")).cast("long")


def polisher(most: int, rounds: int):
    """Adds to a source's cells the single-copy corrections ``_d`` (+1 or -1) of their documents ``_fixed``, and ``source_taken``.

    A round takes the unused cell whose size comes nearest to what is missing. A source has at most as many cells as its
    documents have sizes and base rates: k sizes take k * k / 2 words, so the cells of one source are few beside its documents.
    """

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        size, n, rate, start = (cells[c].to_numpy() for c in ("_size", "_n", "_rate", "_start"))
        fixed, change = np.full(len(size), -1), np.zeros(len(size), np.int64)
        taken = sum(c * z for c, z in zip(cells["_copies"].tolist(), size.tolist(), strict=True))
        # the first document of a cell with a copy to get (rates from 1 on: where some have 2) or to give (rates below 1)
        gets = np.where(rate < UNIT, 0, np.where(rate % UNIT == 0, 0, start // (UNIT - rate % UNIT)))
        gives = np.where(rate >= UNIT, 0, -(-(UNIT - start) // np.maximum(rate, 1)) - 1)
        can_get, can_give = (size > 0) & (rate < most * UNIT) & (gets < n), (size > 0) & (rate > 0) & (gives < n)
        for _ in range(rounds):
            missing = float(cells["target"].iloc[0]) - taken
            still = np.abs(abs(missing) - size)
            able = np.flatnonzero((can_get if missing > 0 else can_give) & (change == 0) & (still < abs(missing)))
            if not len(able):
                break
            at = able[np.lexsort((cells["_q"].to_numpy()[able], size[able], still[able]))[0]]
            change[at] = 1 if missing > 0 else -1
            fixed[at] = (gets if missing > 0 else gives)[at]
            taken += int(change[at] * size[at])
        out = cells[["_key", "_size", "_q", "_rate", "_start", "source_size", "target"]]
        return out.assign(source_taken=taken, _fixed=fixed, _d=change)

    return run


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, each as often as the mix takes it; columns stay as they are. Rows that share an id take the copies of
    their id together, evenly."""
    one = fresh(docs, "copy")
    found = mix(docs, id_col, text_col, source_col).groupBy(id_col).agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("r"))
    copies = found.where("c > 0").select(F.col(id_col).alias("id"), F.sequence(F.lit(1), F.ceil(F.col("c") / F.col("r")).cast("int")).alias("times"))
    joined = docs.join(copies, docs[id_col].eqNullSafe(copies["id"]))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(copies["times"]).alias(one)).drop(one)
