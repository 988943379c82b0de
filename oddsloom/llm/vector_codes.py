"""Codes of vectors: one small codebook for each part of a vector, searched by annular norm pruning.

Components become whole numbers, ``floor(scale * x)``; vectors are cut into equal parts. The codebook of a part's position starts as that
part of the rows with the smallest ids; each round assigns every part to its nearest entry (squared distance; ties: the lower
index) and moves each entry to the floored mean of its parts. Unused entries stay.

The search: entries lie in order of their norms. The entry whose norm is nearest to the part's gives the first distance d;
since ``| |x| - |e| | <= |x - e|``, only entries of norms in ``[|x| - d, |x| + d]`` can do as well. Binary search finds that annulus, its
ends included; only its entries are evaluated, in whole numbers, and d shrinks as better ones come. Norms are floating point, so
the annulus is widened by more than their error; distances are exact. A round is one pass: a task sums up its
parts by entry, Spark adds the tasks' sums, and the entries (as many numbers as ``entries`` vectors have) go back to the tasks.

Defined results: rows whose vector is null or holds a null or non-finite component take no part. Shorter vectors, and lengths that
the parts don't divide, are padded with zeros, which changes no distance between them. A null id is coded like any other and is
last among the seeds; equal ids are ordered by their vectors, and equal rows give equal rows. Fewer rows than ``entries``: as many entries as rows. An
empty table gives an empty one. Numbers beyond 2**62 count as 2**62; an error beyond 64 bits is given as the largest one.
Other columns of the table are left out, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, join_spread, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 2**63 - 1
_FARTHEST = 2**62
#: Rows that are searched together.
_ROWS = 8_192


class Codebook:
    """The entries of one part's position in order of their norms."""

    def __init__(self, entries: list[list[int]]):
        self.width = len(entries[0])
        self.safe_to = math.isqrt((2**61 - 1) // max(1, self.width))
        norms = np.array([math.hypot(*map(float, e)) for e in entries])
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.exact = np.array([entries[i] for i in self.order], object).reshape(len(entries), self.width)
        self.safe = np.array([all(abs(c) <= self.safe_to for c in entries[i]) for i in self.order])
        self.fast = np.array([entries[i] if s else [0] * self.width for i, s in zip(self.order, self.safe, strict=True)], np.int64).reshape(len(entries), self.width)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of and squared distance to each part's nearest entry; how many distances were computed."""
        small = (np.abs(parts) <= self.safe_to).all(1) & self.safe.any()
        index, distance, work = np.zeros(len(parts), np.int64), np.zeros(len(parts), object), 0
        for rows, whole in ((np.flatnonzero(small), False), (np.flatnonzero(~small), True)):
            if len(rows):
                index[rows], distance[rows], n = self._search(parts[rows], whole)
                work += n
        return index, (distance.astype(np.int64) if small.all() else distance), work

    def _distance(self, parts: np.ndarray, at: np.ndarray, whole: bool) -> np.ndarray:
        """Squared distances to the entries at places ``at``. Where parts fit (not ``whole``) a distance to an entry that does not is
        cut to 64 bits; it is more than that to an entry that fits, of which there is one."""
        if whole:
            return ((parts.astype(object) - self.exact[at]) ** 2).sum(1) if self.width else np.zeros(len(parts), object)
        out = ((parts - self.fast[at]) ** 2).sum(1)
        for i in np.flatnonzero(~self.safe[at]):
            out[i] = min(LARGEST, sum((int(a) - b) ** 2 for a, b in zip(parts[i], self.exact[at[i]], strict=True)))
        return out

    def _search(self, parts: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, int]:
        own = np.sqrt((parts.astype(np.float64) ** 2).sum(1))
        k = len(self.norms)
        above = np.searchsorted(self.norms, own).clip(0, k - 1)
        below = (above - 1).clip(0)
        first = np.where(np.abs(self.norms[below] - own) <= np.abs(self.norms[above] - own), below, above)
        best, at = self._distance(parts, first, whole), first.copy()
        work = len(parts)
        slack = 1e-9 * (own + self.norms[-1]) + 1e-9

        def reach() -> np.ndarray:
            return np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + slack

        low, high = np.searchsorted(self.norms, own - reach(), "left"), np.searchsorted(self.norms, own + reach(), "right")
        for step in range(1, k):  # outwards from the first place, above and below
            for place in (first + step, first - step):
                rows = np.flatnonzero((place >= low) & (place < high))
                if not len(rows):
                    continue
                rows = rows[np.abs(self.norms[place[rows]] - own[rows]) <= reach()[rows]]
                found = self._distance(parts[rows], place[rows], whole)
                work += len(rows)
                better = (found < best[rows]) | ((found == best[rows]) & (self.order[place[rows]] < self.order[at[rows]]))
                best[rows[better]], at[rows[better]] = found[better], place[rows[better]]
        return self.order[at], best, work


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, v): whole-number vectors of the rows that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))

    def own(x):
        y = x.cast("double") * scale
        return F.when(y >= _FARTHEST, F.lit(_FARTHEST)).when(y <= -_FARTHEST, F.lit(-_FARTHEST)).otherwise(F.floor(y))

    return vectors.where(F.col(vector_col).isNotNull()).where(finite).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vector_col, own).alias("v"))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(lists)), sizes), at] = lists.flatten().to_numpy()
    return out


def _coded(v: np.ndarray, books: list[Codebook]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    width = v.shape[1] // len(books)
    found = [b.nearest(v[:, p * width : (p + 1) * width]) for p, b in enumerate(books)]
    return [f[0] for f in found], [f[1] for f in found]


def _moved(rows: DataFrame, entries: list[list[list[int]]], width: int) -> list[list[list[int]]]:
    """The entries after a round over ``rows``."""
    parts, k = len(entries), len(entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        sums, counts = np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                v = _matrix(batch.column(0).slice(i, _ROWS), parts * width)
                for p, index in enumerate(_coded(v, books)[0]):
                    own = v[:, p * width : (p + 1) * width]
                    exact = own if np.abs(own).max(initial=0) < 2**48 else own.astype(object)
                    for e in np.unique(index):
                        mine = index == e
                        sums[p, e] += exact[mine].sum(0).astype(object)
                        counts[p, e] += mine.sum()
        p, e = np.nonzero(counts)
        flat = [Decimal(int(x)) for x in sums[p, e].ravel()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(x, width).astype(np.int32)) for x in (p, e)] + [pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))), pa.array(flat, pa.decimal128(38, 0)), pa.array(np.repeat(counts[p, e], width))],
            names=["part", "entry", "at", "total", "n"])

    added = rows.select("v").mapInArrow(run, "part int, entry int, at int, total decimal(38,0), n long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = [[list(e) for e in book] for book in entries]
    for r in added.collect():  # at most as many rows as the entries have components
        out[r["part"]][r["entry"]][r["at"]] = int(r["total"]) // r["n"]
    return out


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[list[list[int]]], int]:
    """Entries by part, and the width of a part, of the stored table ``rows`` (:func:`kept`); no entries if it is empty."""
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return [], 0
    width = -(-longest // parts)
    seeds = [r["v"] + [0] * (parts * width - len(r["v"])) for r in rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    now = [[v[p * width : (p + 1) * width] for v in seeds] for p in range(parts)]
    for _ in range(rounds if width else 0):
        now = _moved(rows, now, width)
    return now, width


def encode(rows: DataFrame, entries: list[list[list[int]]], width: int) -> DataFrame:
    """``id``, ``label``, ``code`` (hex digits of the entries' indexes) and ``error`` of each row of ``rows``. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                index, distance = _coded(_matrix(part.column(2), len(entries) * width), books)
                codes = np.stack(index, 1).astype(np.uint8)
                total = sum(d.astype(object) for d in distance)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array([min(int(t), LARGEST) for t in total], pa.int64())], names=["id", "label", "code", "error"])

    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.mapInArrow(run, schema)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``id_col``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of each row that takes part.

    Errors are summed up by label before they are joined back; labels of more than a 1024th of the rows are broadcast.
    """
    rows = materialize(kept(vectors, id_col, vector_col, label_col, scale), "vector-parts")
    books, width = codebooks(rows, parts, entries, rounds)
    name = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    label = F.when(F.col("label").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    coded = materialize(encode(rows, books or [[[]]], width).withColumn("_label", label), "vector-codes")
    drop_table(rows)
    by_label = coded.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    joined = join_spread(coded, by_label, "_label", "_n", coded.count())
    total = F.least(F.col("_sum"), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    return joined.select(F.col("id").alias(id_col), "code", "error", total.alias("label_error"), F.lit(name).alias("codebooks_sha256"))
