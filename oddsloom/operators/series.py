"""Running values along a series without sorting a whole series in one task.

A series (the rows of some keys in order of time) is cut into chunks of equal time. Each chunk is summed up in one row;
a window over those rows, few and small, gives what holds where a chunk begins; a window inside each chunk does the
rest. So a key that holds a third of all rows is spread over its chunks, and the rows are shuffled by (keys, chunk)
only. Null times form a chunk of their own, before all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "_chunk"


def running(
    df: DataFrame, keys: list[str], at: str, ties: list[str], width: int, *, total: dict[str, Column] | None = None, most: dict[str, Column] | None = None, before: dict[str, Column] | None = None,
    number: str | None = None, size: str | None = None, latest: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds columns along each series in order of ``at`` (a number), then ``ties``, both ascending:

    ``total``: running sums; ``most``: running maxima; ``before``: values of the row before (null for the first);
    ``latest``: last non-null values up to the row; ``number``: the row's number from 1; ``size``: rows of the series.
    ``width`` is a chunk's length in units of ``at``. Rows with equal order are in no defined order among themselves.
    """
    total, most, before, latest = total or {}, most or {}, before or {}, latest or {}
    order = [at, *ties]
    cut = df.withColumns({CHUNK: F.floor(F.col(at) / F.lit(width)), **{f"_v{n}": c for n, c in {**total, **most, **before, **latest}.items()}})
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.sum(f"_v{n}").alias(f"_a{n}") for n in total] + [F.max(f"_v{n}").alias(f"_a{n}") for n in most]
    aggs += [F.max_by(F.struct(f"_v{n}"), F.struct(*order)).alias(f"_a{n}") for n in before]
    aggs += [F.max_by(F.when(F.col(f"_v{n}").isNotNull(), F.struct(f"_v{n}")), F.when(F.col(f"_v{n}").isNotNull(), F.struct(*order))).alias(f"_a{n}") for n in latest]
    heads = cut.groupBy(*keys, CHUNK).agg(*aggs)

    along = Window.partitionBy(*keys).orderBy(CHUNK)  # one row a chunk
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    starts = {f"_s{n}": F.coalesce(F.sum(f"_a{n}").over(earlier), F.lit(0)) for n in total}
    starts |= {f"_s{n}": F.max(f"_a{n}").over(earlier) for n in most}
    starts |= {f"_s{n}": F.lag(f"_a{n}").over(along) for n in before}
    starts |= {f"_s{n}": F.last(f"_a{n}", ignorenulls=True).over(earlier) for n in latest}
    starts["_s"] = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    starts["_all"] = F.sum("_rows").over(Window.partitionBy(*keys))
    heads = heads.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(CHUNK).alias("_c"), *[c.alias(n) for n, c in starts.items()])

    on = [cut[k].eqNullSafe(heads[f"_k{i}"]) for i, k in enumerate(keys)] + [cut[CHUNK].eqNullSafe(heads["_c"])]
    joined = cut.join(heads, reduce(lambda a, b: a & b, on))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(inside)
    out = {n: F.col(f"_s{n}") + F.coalesce(F.sum(f"_v{n}").over(upto), F.lit(0)) for n in total}
    out |= {n: F.greatest(f"_s{n}", F.max(f"_v{n}").over(upto)) for n in most}
    out |= {n: F.when(first == 1, F.col(f"_s{n}._v{n}")).otherwise(F.lag(f"_v{n}").over(inside)) for n in before}
    out |= {n: F.coalesce(F.last(f"_v{n}", ignorenulls=True).over(upto), F.col(f"_s{n}._v{n}")) for n in latest}
    out |= {number: (F.col("_s") + first).cast("long")} if number else {}
    out |= {size: F.col("_all")} if size else {}
    return joined.select(*[cut[c] for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def width_for(span: int, chunks: int = 1000) -> int:
    """A chunk's length that cuts a span of time into about so many chunks."""
    return max(1, span // chunks)


def quantiles(df: DataFrame, value: str, shares: list[float], width: float) -> DataFrame:
    """One row with ``e``: the exact quantiles, interpolated between neighbours, of ``value``; null values do not count.

    Equal values are counted first; running counts over chunks of ``width`` then place each value, so that no task
    holds or sorts all of them.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_m"))
    placed = running(counted, [], "_x", [], width, total={"_upto": F.col("_m")}).crossJoin(F.broadcast(counted.agg(F.sum("_m").alias("_all_rows"))))
    at = [F.lit(q) * (F.col("_all_rows") - 1) for q in shares]
    first = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_x")))
    sums = placed.agg(*[first(F.floor(p)).alias(f"_lo{i}") for i, p in enumerate(at)], *[first(F.ceil(p)).alias(f"_hi{i}") for i, p in enumerate(at)], *[F.first(p).alias(f"_at{i}") for i, p in enumerate(at)])
    between = [F.col(f"_lo{i}") + (F.col(f"_at{i}") - F.floor(f"_at{i}")) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i in range(len(shares))]
    return sums.select(F.array(*between).alias("e"))


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: T.StructType | str) -> DataFrame:
    """Stream each key's rows in order through ``step(state, row) -> (state, rows)``, from the state ``start()``.

    For rules that depend on their own past. Rows are sorted by Spark and read in batches; a task holds one state and one
    batch, never a whole group.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = fields.names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in frames:
            out = []
            columns = {c: pdf[c].tolist() for c in pdf.columns}
            for key, values in zip(zip(*[columns[k] for k in keys], strict=True), zip(*columns.values(), strict=True), strict=True):
                if key != now:
                    now, state = key, start()
                state, rows = step(state, dict(zip(columns, values, strict=True)))
                out += [{**dict(zip(keys, key, strict=True)), **r} for r in rows]
            if out:
                yield pd.DataFrame({n: pd.Series([r[n] for r in out], dtype=None if not isinstance(f.dataType, T.DoubleType) else "float64") for n, f in zip(names, fields, strict=True)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, fields)
