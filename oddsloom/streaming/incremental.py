"""Detection kept up to date batch by batch: only groups that a batch touches are looked at again.

Two logs lie under a path. ``quotes`` holds what came last of each key in a batch (no other quote of the batch can ever count), by batch and by bucket of the event; ``found`` holds, for each group that a batch touched, what it is worth since.
A batch reads the buckets of its own events (partitions pruned by a join with at most ``BUCKETS`` numbers), and of them its own events. It replaces its own
files, so that a repeated batch changes nothing. Use it as ``foreachBatch(lambda df, n: evaluate(df, n, path, ...))``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..domain import Settings
from ..operators import detect

BUCKETS = 64
_OWN = T.StructType([T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])


def _write(rows: DataFrame, batch: int, path: str) -> None:
    own = rows.withColumns({"batch": F.lit(batch).cast("long"), "bucket": F.pmod(F.hash("event_id"), F.lit(BUCKETS))})
    own.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, *_OWN.fields])).parquet(path)


def evaluate(quotes: DataFrame, batch: int, path: str, groups: DataFrame, settings: Settings, ties: list[str]) -> None:
    """Takes in one batch of quotes and evaluates the groups it touches. Batches bear rising numbers; quotes may come late and in any split.

    Of quotes of one key the last by ``changed_at``, then by ``ties``, counts, and an event's mode is that of its last quote. A quote touches the groups
    it can serve; a new mode touches all groups of its event. A closed quote serves no leg. An empty batch touches nothing; null event ids are no event and are left out.
    """
    spark = quotes.sparkSession
    order = [F.col(c).desc() for c in ties]
    _write(detect.latest(quotes.where("event_id IS NOT NULL"), order, ("event_id", "sport", "bk", "market", "sel")), batch, f"{path}/quotes")
    log = _read(spark, f"{path}/quotes", quotes.schema).where(F.col("batch") <= batch)
    came = log.where(F.col("batch") == batch)
    buckets = came.select("bucket").distinct()
    own = log.join(F.broadcast(buckets), "bucket", "left_semi").join(came.select("event_id").distinct(), "event_id", "left_semi")

    place = F.struct("changed_at", *ties)
    before = F.max_by(F.when(F.col("batch") < batch, F.struct("mode")), F.when(F.col("batch") < batch, place))["mode"]
    events = own.groupBy("event_id").agg(F.max_by("mode", place).alias("_mode"), before.alias("_before"))
    moved = events.where(~F.col("_before").eqNullSafe(F.col("_mode"))).select("event_id")
    served = groups.select("sport", "market", "group_key").distinct()
    markets = came.select("event_id", "sport", "market").unionByName(own.join(moved, "event_id", "left_semi").select("event_id", "sport", "market")).distinct()
    touched = markets.join(F.broadcast(served), ["sport", "market"]).select("event_id", "group_key").distinct()

    last = detect.latest(own, order).join(events.select("event_id", "_mode"), "event_id")
    found = detect.arbs(last.withColumn("mode", F.col("_mode")).drop("_mode"), groups, settings, check_consensus=False)
    out = touched.join(found.withColumn("holds", F.lit(True)), ["event_id", "group_key"], "left")
    _write(out.withColumn("holds", F.coalesce("holds", F.lit(False))), batch, f"{path}/found")


def current(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Opportunities as the batches so far (or up to one of them) leave them: of each group what the last batch that touched it says."""
    rows = spark.read.parquet(f"{path}/found")
    rows = rows.where(F.col("batch") <= upto) if upto is not None else rows
    values = [c for c in rows.columns if c not in ("event_id", "group_key", "batch", "bucket")]
    last = rows.groupBy("event_id", "group_key").agg(F.max_by(F.struct(*values), "batch").alias("x"))
    return last.select("event_id", "group_key", "x.*").where("holds").drop("holds")
