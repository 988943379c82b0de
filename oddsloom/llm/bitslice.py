"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers (``floor(scale * x)``). The rows of a block are indexed by slices: for attribute j and
bit b a bitmap over the block's rows. A query's score of all rows is added up from slices with bitmap arithmetic: its
component, in signed binary digits, picks slices (complements where the digit is negative, which shifts all scores by
the same constant), and carry-save adders reduce the picked bitmaps of each weight to one. The top rows come from the
most significant slice downward; rows that tie at the boundary are resolved exactly, smaller ids first, and reported
scores are exact inner products.

Work is dealt out in units (row block, query group). Queries are streamed past a unit's index, so a task holds one
block and a batch of queries, and keeps k rows a query. Vectors that are null, or hold null or non-finite components,
take no part; shorter vectors count as padded with zeros. A query is a row: rows that share an id are asked each, all rows but
the asked one are its candidates, and each has its own ranks 1 to k. Equal rows get equal answers, as often as they come.
Ranks hold for scores of any size, since slices have no last weight. A reported score has 64 bits: one among the k best that passes that is
refused (``ValueError``), and so is a component beyond 2**62; other large components only make their block's index deeper.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 65_536


class BitSlicedIndex:
    """Slices of an int matrix (rows sorted by id)."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        n = len(ids)
        low = int(values.min(initial=0))
        self.bits = max(1, (int(values.max(initial=0)) - low).bit_length())
        words = max(1, -(-n // 64))
        self.slices = []
        for j in range(values.shape[1]):
            column = (values[:, j] - low).astype(np.uint64)
            own = []
            for b in range(self.bits):
                bytes_ = np.zeros(words * 8, np.uint8)
                packed = np.packbits((column >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little")
                bytes_[: len(packed)] = packed
                own.append(bytes_.view(np.uint64))
            self.slices.append((own, [~s for s in own]))
        every = np.zeros(words * 8, np.uint8)
        packed = np.packbits(np.ones(n, np.uint8), bitorder="little")
        every[: len(packed)] = packed
        self.every = every.view(np.uint64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the scores (up to a constant), least significant first."""
        weights: list[list[np.ndarray]] = []
        for j, q in enumerate(query.tolist()):
            for shift, digit in signed_digits(q):
                own = self.slices[j][digit < 0]
                while len(weights) < shift + self.bits:
                    weights.append([])
                for b, s in enumerate(own):
                    weights[shift + b].append(s)
        out, w = [], 0
        while w < len(weights):
            column = weights[w]
            if len(column) > 1 and w + 1 == len(weights):
                weights.append([])
            at = 0  # a queue: sums go to the end, so adders form a tree
            while len(column) - at > 2:
                a, b, c = column[at], column[at + 1], column[at + 2]
                x = a ^ b
                column.append(x ^ c)
                weights[w + 1].append((a & b) | (x & c))
                at += 3
            if len(column) - at == 2:
                a, b = column[at], column[at + 1]
                column.append(a ^ b)
                weights[w + 1].append(a & b)
                at += 2
            out.append(column[at] if len(column) > at else np.zeros_like(self.every))
            weights[w] = []
            w += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows, the query's own row left out; ties to smaller ids."""
        sure, even = np.zeros_like(self.every), self.every.copy()
        a, b = np.searchsorted(self.ids, query_id, "left"), np.searchsorted(self.ids, query_id, "right")
        for i in range(int(a), int(b)):
            if (self.values[i] == query).all():  # equal rows are alike: one of them is the query
                even[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
                break
        have = 0
        for s in reversed(self.score_slices(query)):
            ones = even & s
            n = int(np.bitwise_count(ones).sum())
            if have + n > k:
                even = ones
            else:
                sure, have = sure | ones, have + n
                even = even & ~s
                if have == k:
                    break
        rows = np.concatenate([_positions(sure), _positions(even)[: k - have]])
        scores = self._scores(rows, query)
        order = np.lexsort((self.ids[rows], -scores))
        return self.ids[rows][order], scores[order]


    def _scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products; sums that wrap on the way are right where the result fits."""
        own, asked = self.values[rows].astype(np.int64), query.astype(np.int64)
        with np.errstate(over="ignore"):
            out = own @ asked
        for i in np.flatnonzero(np.abs(own.astype(np.float64)) @ np.abs(asked.astype(np.float64)) >= 2.0**62):
            score = sum(int(a) * int(b) for a, b in zip(own[i], asked, strict=True))
            if not -(2**63) <= score < 2**63:
                raise ValueError(f"a score of row {self.ids[rows[i]]} passes 64 bits")
        return out


def signed_digits(q: int) -> Iterator[tuple[int, int]]:
    """(shift, +1 or -1): the non-adjacent form of an integer."""
    shift = 0
    while q:
        if q & 1:
            digit = 2 - (q & 3)
            yield shift, digit
            q -= digit
        q >>= 1
        shift += 1


def _positions(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", *more: Column) -> DataFrame:
    """(id, v): whole-number vectors of the rows that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    own = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite).select(F.col(id_col).cast("long").alias("id"), own.alias("v"), *more)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's k best rows; queries are the ids divisible by ``every``."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, id_col, vector_col)
    n, width, low, high = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if max(abs(low or 0), abs(high or 0)) > 2**62:
        raise ValueError("a component passes 62 bits, so that scores could pass 64 bits")
    blocks = max(1, math.ceil(n / block_rows))
    groups = max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / blocks))
    width = max(1, width or 1)

    block = F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks))
    group = F.pmod(F.xxhash64(F.lit("group"), "id"), F.lit(groups))
    units = lambda b, g: (b * groups + g).cast("int")
    index = rows.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        units(block, F.col("_g")).alias("unit"), F.lit(0).alias("kind"), "id", "v", F.lit(0).alias("nth"), F.lit(0).cast("long").alias("times"))
    # the different rows of an asked id are told apart by the order of their vectors; equal ones are asked once, their answers repeated
    asked = rows.where(F.col("id") % every == 0).groupBy("id", "v").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("v"))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.select(units(F.col("_b"), group).alias("unit"), F.lit(1).alias("kind"), "id", "v", "nth", "times")
    dealt = index.unionByName(asked).repartition(blocks * groups, "unit").sortWithinPartitions("unit", "kind", "id")

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column(3)
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.zeros((batch.num_rows, width), np.int64)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(np.arange(batch.num_rows), sizes), at] = lists.flatten().to_numpy()
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, built = None, [], None
        for batch in batches:
            where = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                u, kind = int(where[a]) // 2, int(where[a]) % 2
                if u != unit:
                    unit, held, built = u, [], None
                ids, values = part.column(2).to_numpy(), matrix(part)
                if kind == 0:
                    held.append((ids, values))
                    continue
                if not held:
                    continue  # a block without rows
                if built is None:
                    built = BitSlicedIndex(*(np.concatenate(x) for x in zip(*held, strict=True)))
                found = [(q, *built.top(q, v, k)) for q, v in zip(ids.tolist(), values, strict=True)]
                row = pa.array(np.repeat(np.arange(len(ids)), [len(x[1]) for x in found]))
                own = [part.column(c).take(row) for c in (2, 4, 5)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate([x[1] for x in found])), pa.array(np.concatenate([x[2] for x in found]))], names=["query_id", "nth", "times", "vec_id", "score"])

    best = dealt.mapInArrow(search, "query_id long, nth int, times long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "nth").orderBy(F.col("score").desc(), "vec_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")
