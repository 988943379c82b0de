"""Helpers shared by the operators: shared-folder tables and distributed ordinals."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..stored import shared_dir


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    df.write.parquet(path := table_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, when nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_ordinals(df: DataFrame, keys: list[str], rows: int, out: str, order: list[Column], spread: Column, per_bucket: int = 1_000, more: DataFrame | None = None) -> DataFrame:
    """Number the rows of each key gaplessly from 0, no key being sorted in one task.

    Rows are dealt into hash buckets of about ``per_bucket`` rows by ``spread`` (of the root of the rows, if that is
    more, so that neither a bucket nor a key's bucket counts grow in proportion); a key's bucket counts, summed up,
    give each bucket its first number, and a window numbers the rows inside a bucket. ``df`` is read twice and should
    be a stored table. ``more`` (one row for each key) adds columns by way of the bucket counts, so its join spreads a key's
    rows over the buckets as well.
    """
    buckets = max(1, math.ceil(rows / max(per_bucket, math.isqrt(rows))))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(F.lit("bucket"), spread), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    if more is not None:
        first = first.join(more, keys)
    added = [c for c in more.columns if c not in keys] if more is not None else []
    first = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.coalesce("_first", F.lit(0)).alias("_first"), *added)
    on = [dealt[k].eqNullSafe(first[f"_k{i}"]) for i, k in enumerate(keys)] + [dealt["_b"] == first["_kb"]]
    numbered = dealt.withColumn("_j", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = numbered.join(first, condition)
    return joined.withColumn(out, (F.col("_first") + F.col("_j")).cast("long")).drop("_b", "_j", "_first", "_kb", *[f"_k{i}" for i in range(len(keys))])


HOT_SHARE = 1_024


def join_spread(rows: DataFrame, found: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``found`` (one row for each ``key``; column ``count``: how many of ``rows`` have it, ``total`` in all).

    Keys of more than a ``HOT_SHARE``-th of the rows are at most ``HOT_SHARE`` and are broadcast, so that their rows stay where
    they are; the other keys are shuffled. ``rows`` is read twice and should be a stored table.
    """
    hot = found.where(F.col(count) * HOT_SHARE > total)
    cold = found.where(F.col(count) * HOT_SHARE <= total)
    first = rows.join(F.broadcast(hot), key)
    return first.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key).select(*first.columns))


def units(rows: DataFrame, key: str, member: str, most: int, weight: Column | None = None) -> DataFrame:
    """``rows`` with column ``unit``: pieces of a key's rows, so that each two rows of a key meet in a piece that weighs at most about 2 * ``most``.

    A row weighs 1, or ``weight``. A key of weight up to ``most`` is one piece. The rows of a larger one are dealt into blocks
    by hash of ``member``, and each two blocks make a piece. The sums by key decide, in a join of the large keys alone.
    """
    large = rows.groupBy(key).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n")).where(F.col("_n") > most)
    large = large.select(F.col(key).alias("_large"), F.ceil(F.col("_n") / most).cast("int").alias("_blocks"))
    dealt = rows.join(large, F.col(key) == F.col("_large"), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(F.lit("unit"), member), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("unit", F.least("_own", "_other") * F.col("_blocks") + F.greatest("_own", "_other")).select(*rows.columns, "unit")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null counts as empty."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def small_batches(batches: Iterator[pa.RecordBatch], text_at: int = 1, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches where their texts pass ``most_bytes``; a longer text makes a batch of its own. No row is lost."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
