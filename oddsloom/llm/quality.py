"""Quality classifier by positive-unlabelled learning.

Trusted positives P are rows labelled 1 (outside the held-out fold), the unlabelled web texts U are all documents, and the
class prior pi is the share of ones among all labels outside the fold. A linear scorer over statistics of the text is fitted
to the non-negative unbiased risk

    pi E_P[l(+)] + max(0, E_U[l(-)] - pi E_P[l(-)])

with the logistic loss, so that its output is a probability. For this loss l(+) - l(-) = -z, so the risk is convex where the
second part is not negative: Newton steps minimise it, bent along the edge where that part would turn negative (one linear
constraint a step), and halved where they cross it all the same. At the end the bias is set so that the mean score of all
documents is the prior. Labelled zeros only count for pi. Each step is one pass over a stored table of all documents' features, whose sums are
added up by key, so E_U, means and scales cover every document. P is at most ``sample_rows`` labelled texts (those whose ids
hash lowest, one text an id: the bound of the method's labelled sample).

Features are surface statistics (marks, cases, digits, repeats) and content: words and character trigrams hashed into
buckets. Labels, lang, source and doc_id are never inputs of a score. Null texts count as empty; an empty text has all-zero
features and gets the score these give. Without any positive or document the weights stay zero and all scores are 0.5.
A null id is in the held-out fold; a document labelled twice counts by each label.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, fresh, materialize, small_batches

FOLDS = 5
THRESHOLD = 0.3
RIDGE = 2e-3
#: How far below zero the part may go: the constraint is met to this.
EDGE = 1e-3
_PUNCT = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_WORDS = 8
_SURFACE = len(_PUNCT) + 5 + _WORDS
BUCKETS = 32
SIZE = _SURFACE + 2 * BUCKETS


def features(text: str | None) -> np.ndarray:
    """Surface statistics: shares of ASCII marks, of letter cases and digits, and of repeated words; then the shares of words and
    of byte trigrams, lower-cased, in hash buckets."""
    out = np.zeros(SIZE, np.float32)
    data = (text or "").encode()
    words = data.split()
    if not words:
        return out
    n, k = len(data), len(words)
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=256)
    share = lambda x: np.log1p(1000.0 * x / n)
    p = len(_PUNCT)
    out[:p] = share(counts[_PUNCT])
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    out[p : p + 5] = share(np.array([upper, counts[48:58].sum(), counts[10], counts[128:].sum(), counts[9] + counts[13]]))
    seen = Counter(words)
    same_next = sum(map(eq, words, words[1:]))
    top = max(seen.values())
    out[p + 5 : _SURFACE] = (
        np.log1p(100.0 * same_next / k),
        np.log1p(100.0 * max(0, top - 1) / k),
        1.0 - len(seen) / k,
        np.log1p(k),
        np.log1p(n / k),
        upper / max(1, upper + lower),
        (len(seen) == 1) * (k > 3),
        np.log1p(len(max(seen, key=len))),
    )
    low = np.frombuffer(data.lower(), np.uint8).astype(np.uint32)
    # words: the wrapping sum of byte times an odd power of its place in the word; trigrams: of three bytes
    letter = low > 32
    start = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    stop = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1
    if len(start):
        place = np.arange(n, dtype=np.uint32) - np.repeat(np.r_[0, start].astype(np.uint32), np.diff(np.r_[0, start, n]))
        sums = np.r_[np.uint32(0), np.cumsum((low + np.uint32(7)) * (place * np.uint32(2_654_435_761) + np.uint32(1)), dtype=np.uint32)]
        out[_SURFACE : _SURFACE + BUCKETS] = np.sqrt(np.bincount(_bucket(sums[stop] - sums[start]), minlength=BUCKETS) / len(start))
    if n > 2:
        grams = low[:-2] * np.uint32(2_654_435_761) + low[1:-1] * np.uint32(2_246_822_519) + low[2:] * np.uint32(3_266_489_917)
        out[_SURFACE + BUCKETS :] = np.sqrt(np.bincount(_bucket(grams), minlength=BUCKETS) / len(grams))
    return out


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ hashes >> np.uint32(15)) * np.uint32(2_246_822_519) >> np.uint32(16)) % np.uint32(BUCKETS)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    positives: int
    unlabelled: int
    shift: float = 0.0  # of the bias, to match the prior

    def squash(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.squash(x) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(table: DataFrame, values, width: int) -> np.ndarray:
    """The sum over all rows of ``table`` (column ``x``: packed features) of ``values(matrix)``, a vector of ``width``.

    Every task adds up its rows; the tasks' vectors are added place by place, so that one vector comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, SIZE).astype(np.float64)
            for i in range(0, len(x), 2_000):
                total += values(x[i : i + 2_000])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["i", "v"])

    rows = table.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def fit_pu(positive: np.ndarray, unlabelled: DataFrame, prior: float, steps: int = 10) -> Model:
    """Newton steps on the non-negative risk; ``unlabelled`` is the feature table of all documents."""
    moments = _sums(unlabelled, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * SIZE)
    n = int(moments[0])
    if not len(positive) or not n:
        return Model(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE), 0.0, prior, len(positive), n)
    mean = np.round(moments[1 : 1 + SIZE] / n, 9)
    scale = np.round(np.sqrt(np.maximum(moments[1 + SIZE :] / n - mean**2, 0)), 9)
    scale = np.where(scale > 1e-6, np.maximum(scale, 0.01), 1e9)
    squash = lambda x: np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))])
    p = squash(positive)
    k = SIZE + 1
    upper = np.triu_indices(k)
    flat = np.r_[np.full(SIZE, RIDGE), 0.0]

    def parts(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray, np.ndarray]:
        """Risk, its part that must not be negative, the gradients of both, and the Hessian at w."""

        def values(x: np.ndarray) -> np.ndarray:
            x = squash(x)
            z = np.clip(x @ w, -30, 30)
            s = 1 / (1 + np.exp(-z))
            return np.concatenate([[np.logaddexp(0, z).sum()], s @ x, ((x * (s * (1 - s))[:, None]).T @ x)[upper]])

        got = _sums(unlabelled, values, 1 + k + len(upper[0])) / n
        hessian = np.zeros((k, k))
        hessian[upper] = got[1 + k :]
        hessian = hessian + np.triu(hessian, 1).T + np.diag(flat + 1e-9)
        z = p @ w
        part = got[0] - prior * np.logaddexp(0, z).mean()
        down = got[1 : 1 + k] - prior * ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) @ p) / len(p)
        return got[0] - prior * z.mean() + (flat * w * w).sum() / 2, part, got[1 : 1 + k] - prior * p.mean(0) + flat * w, down, hessian

    w = np.r_[np.zeros(SIZE), np.log(prior / (1 - prior))]
    risk, part, gradient, down, hessian = parts(w)
    step = 1.0
    for _ in range(steps):
        move, along = np.linalg.solve(hessian, np.stack([-gradient, down], 1)).T
        if part + down @ move < 0:  # the least move that keeps the part, to first order, from going below zero
            move = move - (part + down @ move) / max(down @ along, 1e-12) * along
        if np.abs(move).max() < 1e-5 or step < 1e-3:
            break
        tried = parts(w + step * move)
        if tried[1] < -EDGE or (tried[0] > risk + 1e-12 and tried[1] <= part):
            step /= 2
            continue
        w, (risk, part, gradient, down, hessian), step = w + step * move, tried, min(1.0, 2 * step)
    shift = round(_matching(unlabelled, lambda x: squash(x) @ w, prior, n), 9)
    w = np.round(w, 9)
    return Model(mean, scale, w[:-1], float(w[-1]) + shift, prior, len(positive), n, shift)


def _matching(unlabelled: DataFrame, logit, prior: float, n: int, bins: int = 4_000) -> float:
    """What to add to all logits so that the mean score of all documents is the prior; by a histogram of the logits."""

    def counts(x: np.ndarray) -> np.ndarray:
        return np.bincount(((np.clip(logit(x), -20, 20) + 20) * (bins / 40)).astype(np.int64).clip(0, bins - 1), minlength=bins).astype(float)

    share = _sums(unlabelled, counts, bins) / n
    z = (np.arange(bins) + 0.5) * (40 / bins) - 20
    lo, hi = -20.0, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if share @ (1 / (1 + np.exp(-np.clip(z + mid, -40, 40)))) < prior:
            lo = mid
        else:
            hi = mid
    return lo


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 8000) -> Model:
    """Estimate the prior over all labels outside the fold and fit on a bounded sample of P and on all documents."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(~held_out("id") & F.col("y").isNotNull())
    n, ones = known.agg(F.count(F.lit(1)), F.sum((F.col("y") == 1).cast("long"))).first()
    prior = min(0.98, ((ones or 0) + 1) / (n + 2))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["id", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = materialize(texts.mapInArrow(packed, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("x", T.BinaryType())])), "features")
    by_hash = [F.xxhash64(F.lit("pu"), "id"), F.col("id")]
    trusted = known.where("y = 1").join(table.select("id"), "id", "left_semi").select("id").distinct().orderBy(*by_hash).limit(sample_rows)
    # one text an id, so no more rows than ids come to the driver
    rows = table.join(F.broadcast(trusted), "id").groupBy("id").agg(F.min("x").alias("x")).orderBy("id").collect()
    positive = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, SIZE).astype(np.float64)
    model = fit_pu(positive, table, prior)
    drop_table(table)
    return model


def with_scores(docs: DataFrame, model: Model, out: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the score of every whole text in column ``out``. No shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at):
            x = np.stack([features(t) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score``, ``predicted`` of every document."""
    scored = with_scores(docs.select(id_col, text_col), train(docs, labels, id_col, text_col), "_score", text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts; columns stay as they are."""
    out = fresh(docs, "_quality_score")
    return with_scores(docs, train(docs, labels, id_col, text_col), out, text_col).where(F.col(out) >= THRESHOLD).drop(out)
