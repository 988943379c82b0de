"""Sinks of streams: what a micro-batch writes, so that a batch that is repeated after a failure changes nothing.

A batch owns its files: it writes the partitions (day, batch) or (batch) that bear its number and replaces them when it comes again.
Use them as ``foreachBatch(lambda df, n: append(df, n, path, "at"))``. Tables are read back by :func:`days` and :func:`current`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ladder import throttled
from ..operators.series import running
from ..operators.stats import day_of

#: Rows that a batch of changes may hold before the rest is dropped and counted, and days that are kept.
MOST_ROWS, KEEP_DAYS = 200_000, 90
MINUTE = 60_000


def bounded(rows: DataFrame, at: str, ties: list[str], most: int = MOST_ROWS, width: int = MINUTE) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows in order of arrival, and one row with ``dropped``: how many came after.

    Rows are numbered over chunks of time, not in one task. Rows of null time come first; of rows with equal order any may be the last one kept.
    """
    numbered = running(rows, [], at, ties, width, number="_n")
    return numbered.where(F.col("_n") <= most).drop("_n"), rows.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("dropped"))


def _replace(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(rows: DataFrame, batch: int, path: str, at: str) -> None:
    """Writes a batch of changes or ticks by day. Days are UTC; rows of null time are kept under the default partition.

    A batch that comes again must hold the same rows, as a replayed micro-batch does. Columns ``day`` and ``batch`` are the table's own.
    """
    _replace(rows.withColumns({"day": day_of(F.col(at)), "batch": F.lit(batch).cast("long")}).hint("rebalance", "day"), path, ["day", "batch"])


def days(spark: SparkSession, path: str, schema: T.StructType, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of the days from ``since`` to ``until``, both included; other days' folders are not read."""
    own = [T.StructField("day", T.StringType()), T.StructField("batch", T.LongType())]
    rows = spark.read.schema(T.StructType([*schema.fields, *own])).parquet(path)
    rows = rows.where(F.col("day") >= since) if since else rows
    return (rows.where(F.col("day") <= until) if until else rows).drop("batch")


def drop_old(spark: SparkSession, path: str, today: str, keep: int = KEEP_DAYS) -> list[str]:
    """Drops the folders of days more than ``keep`` days before ``today`` and names them; what is gone already is no error.

    The driver sees folder names only, one a day.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    named = {str(s.getPath().getName()).removeprefix("day="): s.getPath() for s in fs.listStatus(root) if s.isDirectory() and str(s.getPath().getName()).startswith("day=")} if fs.exists(root) else {}
    names = spark.createDataFrame([(n,) for n in named], "day string")
    old = sorted(r.day for r in names.where(F.col("day").try_cast("date") < F.date_sub(F.lit(today).cast("date"), keep)).collect())
    for name in old:
        fs.delete(named[name], True)
    return old


def log(rows: DataFrame, batch: int, path: str) -> None:
    """Writes a batch of inserts and updates: rows with ``kind`` (``insert`` or ``update``) and the table's columns; a column that an update does not set is null."""
    _replace(rows.withColumn("batch", F.lit(batch).cast("long")), path, ["batch"])


def logged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


def current(written: DataFrame, key: list[str], at: str, inserted: list[str], updated: list[str]) -> DataFrame:
    """The table that a log of inserts and updates stands for: one row a key.

    Inserts come before updates, whatever order or batch brings them. Of several inserts of a key the first counts (by batch, then time, then values) and later ones change
    nothing; of the updates the last one counts, and what none sets is as inserted. An update without any insert makes no row. Null keys are one key.
    """
    is_in, is_up = F.col("kind") == "insert", F.col("kind") == "update"
    place = [F.col("batch"), F.col(at)]

    def picked(pick, when: Column, names: list[str]) -> Column:
        return pick(F.when(when, F.struct(*names)), F.when(when, F.struct(*place, *names)))

    # an update's value counts column by column, as the last batch that set it
    set_last = [F.max_by(n, F.when(is_up & F.col(n).isNotNull(), F.struct(*place, n))).alias(f"_u_{n}") for n in updated]
    # rows of a key come together before they are sorted for the aggregates: a partition of the shuffle is small, a split of a compressed file is not
    out = written.repartition(*key).groupBy(*key).agg(picked(F.min_by, is_in, inserted).alias("_in"), *set_last).where("_in IS NOT NULL")
    return out.select(*key, *[(F.coalesce(f"_u_{n}", F.col("_in")[n]) if n in updated else F.col("_in")[n]).alias(n) for n in inserted], *[F.col(f"_u_{n}").alias(n) for n in updated if n not in inserted])


def broken(judged: DataFrame, keys: list[str], at: str, ties: list[str], every_ms: int = 600_000) -> DataFrame:
    """Rejected responses worth keeping: of each source one in ten minutes (``judged`` as ``operators.structure.judged`` makes it)."""
    return throttled(judged.where(~F.col("ok")).drop("issues", "ok"), keys, at, every_ms, ties)
