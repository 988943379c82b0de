"""Proportional hazards: training on all observations, scoring as column expressions, evaluation.

``train`` works on Spark tables; ``fit``, ``baseline`` and ``concordance`` do the same on arrays, for small samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import stored
from . import survival
from .series import running, width_for

LEAST_ROWS, LEAST_EVENTS = 1000, 30
PENALTY = 0.05
BASELINE_POINTS = 400


@dataclass(frozen=True)
class CoxModel:
    """Levels and coefficients (``name=level``, numeric names), and the cumulative baseline hazard at times in ms."""

    categorical: dict[str, tuple[str, ...]]
    numeric: dict[str, tuple[float, float]]
    coef: dict[str, float]
    baseline: tuple[tuple[float, float], ...]
    n_train: int = 0
    c_index: float = float("nan")
    metrics: dict = field(default_factory=dict)

    def linear_predictor(self) -> Column:
        """Sum of coefficients; an unknown level counts as ``other`` where that is a level, else as the reference."""
        lp = F.lit(0.0)
        for name, levels in self.categorical.items():
            term = F.when(F.lit(False), F.lit(0.0))
            for level in levels:
                term = term.when(F.col(name) == level, F.lit(float(self.coef.get(f"{name}={level}", 0.0))))
            lp = lp + term.otherwise(F.lit(float(self.coef.get(f"{name}=other", 0.0)) if "other" in levels else 0.0))
        for name, (mean, std) in self.numeric.items():
            lp = lp + F.coalesce((F.col(name) - mean) / (std or 1.0) * float(self.coef.get(name, 0.0)), F.lit(0.0))
        return lp

    def hazard(self, t: float) -> float:
        """Baseline at one time: linear between points, from zero before the first, flat after the last."""
        if not self.baseline:
            return 0.0
        times, values = zip(*self.baseline, strict=True)
        return float(np.interp(max(0.0, t), [0.0, *times], [0.0, *values]))

    def hazard_column(self, t: Column) -> Column:
        """The same for a column of times: a search among the (at most some hundred) points."""
        points = [(0.0, 0.0), *self.baseline]
        array = F.array(*[F.struct(F.lit(float(a)).alias("t"), F.lit(float(h)).alias("h")) for a, h in points])
        place = F.size(F.filter(array, lambda p: p["t"] <= t))
        low, high = F.element_at(array, F.greatest(place, F.lit(1))), F.element_at(array, F.least(place + 1, F.lit(len(points))))
        width = high["t"] - low["t"]
        return F.when(t <= 0, 0.0).when(width <= 0, low["h"]).otherwise(low["h"] + (high["h"] - low["h"]) * (t - low["t"]) / width)

    def survival(self, t_ms: float) -> Column:
        return F.exp(-F.lit(self.hazard(t_ms)) * F.exp(self.linear_predictor()))

    def quantile(self, q: float) -> Column:
        """First baseline time at which survival is down to 1 - q; null if it never is."""
        need = -np.log(1 - q)
        risk = F.exp(self.linear_predictor())
        array = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(h)).alias("h")) for t, h in self.baseline])
        return F.element_at(F.concat(F.transform(F.filter(array, lambda p: p["h"] * risk >= F.lit(float(need) - 1e-15)), lambda p: p["t"]), F.array(F.lit(None).cast("double"))), 1)

    def predict(self, rows: DataFrame, needed: Column | None = None) -> DataFrame:
        out = rows.withColumn("lp", self.linear_predictor())
        for s in (5, 10, 30, 60):
            out = out.withColumn(f"over_{s}", F.exp(F.lit(-self.hazard(s * 1000.0)) * F.exp("lp")))
        out = out.withColumn("p25_ms", self.quantile(0.25)).withColumn("median_ms", self.quantile(0.5)).withColumn("p75_ms", self.quantile(0.75))
        return out if needed is None else out.withColumn("p_needed", F.exp(-self.hazard_column(needed) * F.exp("lp")))


def top_levels(obs: DataFrame, name: str, most: int, least: int = 5) -> DataFrame:
    """The most frequent levels of a column; the rest is ``other``."""
    return obs.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), name).limit(most)


def fit(x: np.ndarray, t: np.ndarray, event: np.ndarray, penalty: float = PENALTY, steps: int = 50) -> np.ndarray:
    """Newton-Raphson on the partial likelihood with Efron's ties and a ridge of ``penalty`` per row on average."""
    n, p = x.shape
    order = np.argsort(-t, kind="stable")
    x, t, event = x[order], t[order], event[order].astype(bool)
    beta = np.zeros(p)
    cuts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    for _ in range(steps):
        w = np.exp(np.clip(x @ beta, -50, 50))
        wx = x * w[:, None]
        s0, s1, s2 = 0.0, np.zeros(p), np.zeros((p, p))
        grad, hess = np.zeros(p), np.zeros((p, p))
        for a, b in zip(cuts, [*cuts[1:], n], strict=True):
            s0, s1 = s0 + w[a:b].sum(), s1 + wx[a:b].sum(0)
            s2 = s2 + x[a:b].T @ wx[a:b]
            own = np.flatnonzero(event[a:b]) + a
            if not len(own):
                continue
            d0, d1, d2 = w[own].sum(), wx[own].sum(0), x[own].T @ wx[own]
            grad += x[own].sum(0)
            for k in range(len(own)):
                f = k / len(own)
                z0, z1, z2 = s0 - f * d0, s1 - f * d1, s2 - f * d2
                grad -= z1 / z0
                hess += z2 / z0 - np.outer(z1, z1) / z0**2
        grad = grad / n - penalty * beta
        step = np.linalg.solve(hess / n + penalty * np.eye(p), grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return beta


def baseline(x: np.ndarray, t: np.ndarray, event: np.ndarray, beta: np.ndarray, points: int = BASELINE_POINTS) -> list[tuple[float, float]]:
    """Cumulative hazard at event times, thinned evenly, the last kept."""
    order = np.argsort(t, kind="stable")
    t, event, w = t[order], event[order].astype(bool), np.exp(x[order] @ beta)
    at_risk = np.cumsum(w[::-1])[::-1]
    times, first, count = np.unique(t, return_index=True, return_counts=True)
    d = np.add.reduceat(event.astype(float), first)
    h = np.cumsum(d / at_risk[first])
    keep = np.flatnonzero(d > 0)
    if len(keep) > points:
        keep = keep[np.unique(np.r_[np.arange(0, len(keep), -(-len(keep) // points)), len(keep) - 1])]
    return [(float(times[i]), float(h[i])) for i in keep]


def concordance(t: np.ndarray, event: np.ndarray, risk: np.ndarray, block: int = 2000) -> float:
    """Share of comparable pairs in which the higher risk ends first; equal risks count half."""
    good = total = 0.0
    for i in range(0, len(t), block):
        a = slice(i, i + block)
        comparable = event[a, None].astype(bool) & ((t[a, None] < t[None]) | ((t[a, None] == t[None]) & ~event[None].astype(bool)))
        higher = np.where(risk[a, None] > risk[None], 1.0, np.where(risk[a, None] == risk[None], 0.5, 0.0))
        good, total = good + (comparable * higher).sum(), total + comparable.sum()
    return good / total if total else float("nan")


def kth(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """Value of the k-th smallest (from 0) of an integer column and the number of rows below it, by narrowing histograms."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    below = 0
    while low < high:
        width = (high - low) // 1000 + 1
        bins = rows.where(F.col(column).between(low, high)).groupBy(F.expr(f"(`{column}` - {low}L) div {width}L").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        for b, n in sorted(map(tuple, bins.collect())):
            if below + n > k:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            below += n
    return int(low), below


def _levels(rows: DataFrame, name: str, most: int) -> tuple[str, ...]:
    """Most frequent levels of five rows or more, the first one at least; ``other`` if there are more. Null is no level."""
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    top = [tuple(r) for r in counts.orderBy(F.col("n").desc(), "k").limit(most).collect()]
    kept = [k for k, n in top if n >= 5] or [k for k, _ in top[:1]]
    return tuple(kept) + (("other",) if counts.count() > len(kept) else ())


def _dot(beta: np.ndarray) -> Column:
    out = F.lit(0.0)
    for i, b in enumerate(beta.tolist()):
        if b:
            out = out + F.lit(b) * F.col(f"x{i}")
    return out


def fit_cells(cells: DataFrame, own: list[int], rows: int, penalty: float = PENALTY, steps: int = 50) -> np.ndarray:
    """:func:`fit` on a stored table of cells ``t, event, n, x0, x1, ...`` (n rows each), for the covariates ``own``.

    A step makes one row for each distinct time (weights of all and of those that end, and their covariate sums), in parts
    that are ranges of time; part sums give each part what is at risk after it. With A(t) the sum of the inverse risk sets
    up to t, the parts of gradient and Hessian that are linear in the risk sets are sums over cells weighted by A, so no
    p x p matrix is held for a time.
    """
    p, names = len(own), [f"x{i}" for i in own]
    beta = np.zeros(p)
    base = cells.select("t", "event", "n", *[F.col(c).alias(f"x{i}") for i, c in enumerate(names)])
    for _ in range(steps):
        weighted = base.withColumn("w", F.col("n") * F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), _dot(beta)))))
        wd = F.when(F.col("event"), F.col("w")).otherwise(0.0)
        sums = [F.sum("w").alias("s"), F.sum(wd).alias("d"), F.sum(F.when(F.col("event"), F.col("n")).otherwise(0)).alias("ends")]
        sums += [F.sum(F.col("w") * F.col(f"x{i}")).alias(f"s{i}") for i in range(p)] + [F.sum(wd * F.col(f"x{i}")).alias(f"d{i}") for i in range(p)]
        dealt = weighted.groupBy("t").agg(*sums).repartitionByRange("t").sortWithinPartitions("t")
        times = stored(dealt.withColumn("part", F.spark_partition_id()), "cox-times")
        held = times.groupBy("part").agg(F.min("t").alias("at"), F.array(F.sum("s"), *[F.sum(f"s{i}") for i in range(p)]).alias("v")).orderBy("at").collect()
        order = [r.part for r in held]
        totals = np.array([r.v for r in held])
        after = dict(zip(order, (np.cumsum(totals[::-1], 0)[::-1] - totals).tolist(), strict=True))

        def risks(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t", ascending=False, kind="stable")
            part = int(pdf["part"].iloc[0])
            both = np.cumsum(pdf[["s", *[f"s{i}" for i in range(p)]]].to_numpy(float), 0) + np.array(after[part])
            s0, s1 = both[:, 0], both[:, 1:]
            d0, d1 = pdf["d"].to_numpy(float), pdf[[f"d{i}" for i in range(p)]].to_numpy(float).reshape(len(pdf), p)
            z = np.zeros((len(pdf), 5))
            for i, m in enumerate(pdf["ends"].to_numpy(np.int64).tolist()):
                for k in range(0, m, 1_000_000):
                    f = np.arange(k, min(m, k + 1_000_000)) / m
                    inverse = 1 / (s0[i] - f * d0[i])
                    z[i] += [inverse.sum(), (f * inverse).sum(), (inverse**2).sum(), (f * inverse**2).sum(), (f**2 * inverse**2).sum()]
            cross = (s1 * z[:, 3:4]).T @ d1
            square = (s1 * z[:, 2:3]).T @ s1 - cross - cross.T + (d1 * z[:, 4:5]).T @ d1
            each = pd.DataFrame({"part": part, "t": pdf["t"].to_numpy(), "a": z[:, 0], "b": z[:, 1], "square": None})
            return pd.concat([each, pd.DataFrame({"part": [part], "t": [None], "a": [z[:, 0].sum()], "b": [0.0], "square": [square.ravel().tolist()]})])

        found = stored(times.groupBy("part").applyInPandas(risks, "part int, t double, a double, b double, square array<double>"), "cox-risks")
        last = {r.part: r for r in found.where("square IS NOT NULL").collect()}
        hess = -sum(np.array(last[k].square).reshape(p, p) for k in order)
        before = dict(zip(order, np.cumsum([0.0, *[last[k].a for k in order]])[:-1].tolist(), strict=True))
        offset = F.create_map(*[F.lit(v) for kv in before.items() for v in kv])[F.col("part")]
        upto = Window.partitionBy("part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        along = found.where("square IS NULL").select(F.col("t").alias("_t"), (F.sum("a").over(upto) + offset).alias("a"), "b")
        joined = weighted.join(along, F.col("t") == F.col("_t"))
        weight = F.col("w") * (F.col("a") - F.when(F.col("event"), F.col("b")).otherwise(0.0))
        known = joined.select(weight.alias("u"), F.when(F.col("event"), F.col("n")).otherwise(0).cast("double").alias("e"), *[F.col(f"x{i}") for i in range(p)])

        def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((p + 1) * p)
            for batch in batches:
                u, e, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                x = np.stack(x, 1)
                out += np.concatenate([(e - u) @ x, ((x * u[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["i", "v"])

        flat = np.array([r.v for r in known.mapInArrow(matrices, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])
        hess = hess + flat[p:].reshape(p, p)
        step = np.linalg.solve(hess / rows + penalty * np.eye(p), flat[:p] / rows - penalty * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return beta


def baseline_cells(cells: DataFrame, points: int = BASELINE_POINTS) -> list[tuple[float, float]]:
    """:func:`baseline` on a table of cells ``t, event, n, lp``."""
    times = cells.groupBy("t").agg(F.sum(F.col("n") * F.exp("lp")).alias("s"), F.sum(F.when(F.col("event"), F.col("n")).otherwise(0)).alias("d"))
    times = stored(times.withColumn("back", -F.col("t")), "cox-baseline")
    low, high = times.agg(F.min("t"), F.max("t")).first()
    width = width_for(int(high - low))
    ended = stored(running(times, [], "back", [], width, total={"at_risk": F.col("s")}).where("d > 0"), "cox-ended")
    h = running(ended, [], "t", [], width, total={"h": F.col("d") / F.col("at_risk")}, number="place", size="of")
    thin = F.ceil(F.col("of") / F.lit(points)).cast("long")
    return sorted((r.t, r.h) for r in h.where(((F.col("place") - 1) % thin == 0) | (F.col("place") == F.col("of"))).select("t", "h").collect())


def concordance_cells(cells: DataFrame) -> float:
    """:func:`concordance` on a table of cells ``t, event, n, lp``, exact.

    Distinct risks are numbered; a pair of unequal risks differs first at one base-16 digit of its numbers. So at each
    digit, rows with equal digits before it are summed by time, and running sums count what ends later with a lower digit.
    """
    risks = cells.select(F.col("lp").alias("_lp")).distinct()
    low, high, many = risks.agg(F.min("_lp"), F.max("_lp"), F.count(F.lit(1))).first()
    if not many:
        return float("nan")
    numbered = running(risks, [], "_lp", [], max(high - low, 1e-9) / 1000, number="rank")
    # even: ends at t; odd: censored at t. Whoever has a greater number outlives whoever ends.
    when = (2 * F.col("t") + F.when(F.col("event"), 0).otherwise(1)).alias("o")
    rows = stored(cells.join(numbered, F.col("lp") == F.col("_lp")).select("rank", "event", "n", (-when).alias("o")), "cox-ranks")
    digits = max(1, -(-int(many).bit_length() // 4))
    level = lambda i: F.struct(F.lit(i).alias("level"), F.shiftright("rank", 4 * (i + 1)).alias("key"), F.shiftright("rank", 4 * i).bitwiseAND(F.lit(15)).alias("digit"))
    # a last level holds equal risks: its key is the whole number
    equal = F.struct(F.lit(-1).alias("level"), F.col("rank").alias("key"), F.lit(0).cast("long").alias("digit"))
    wide = rows.select("event", "n", "o", F.explode(F.array(equal, *[level(i) for i in range(digits)])).alias("l")).select("event", "n", "o", "l.*")
    count = lambda i, c=F.lit(True): F.sum(F.when((F.col("digit") == i) & c, F.col("n")).otherwise(0))
    summed = wide.groupBy("level", "key", "o").agg(*[count(i).alias(f"m{i}") for i in range(16)], *[count(i, F.col("event")).alias(f"e{i}") for i in range(16)])
    summed = stored(summed, "cox-digits")
    first, last = summed.agg(F.min("o"), F.max("o")).first()
    later = running(summed, ["level", "key"], "o", [], width_for(int(last - first)), total={f"r{i}": F.col(f"m{i}") for i in range(16)})
    below, lower, equals = F.lit(0), F.lit(0).cast("decimal(38,0)"), F.col("r0") - F.col("m0")
    for i in range(16):
        lower = lower + F.col(f"e{i}").cast("decimal(18,0)") * below if i else lower
        below = below + F.col(f"r{i}") - F.col(f"m{i}")
        below = below.cast("decimal(18,0)")
    top = F.col("level") == digits - 1
    all_ends = sum((F.col(f"e{i}") for i in range(16)), F.lit(0))
    out = later.agg(
        F.sum(F.when(F.col("level") >= 0, lower).otherwise(0)).cast("double").alias("good"),
        F.sum(F.when(F.col("level") < 0, F.col("e0").cast("decimal(18,0)") * equals).otherwise(0)).cast("double").alias("even"),
        F.sum(F.when(top, all_ends.cast("decimal(18,0)") * below).otherwise(0)).cast("double").alias("pairs")).first()
    return (out.good + out.even / 2) / out.pairs if out.pairs else float("nan")


def quantiles(cells: DataFrame, q: list[float]) -> list[float]:
    """Quantiles of ``lp`` over the rows of the cells, linear between neighbours."""
    risks = cells.groupBy("lp").agg(F.sum("n").alias("n"))
    low, high, n = risks.agg(F.min("lp"), F.max("lp"), F.sum("n")).first()
    upto = running(risks, [], "lp", [], max(high - low, 1e-9) / 1000, total={"upto": F.col("n")})
    at = [(n - 1) * x for x in q]
    places = sorted({int(np.floor(a)) for a in at} | {int(np.ceil(a)) for a in at})
    found = dict(zip(places, upto.agg(*[F.min(F.when(F.col("upto") > k, F.col("lp"))) for k in places]).first(), strict=True))
    return [found[int(np.floor(a))] + (found[int(np.ceil(a))] - found[int(np.floor(a))]) * (a - np.floor(a)) for a in at]


def calibration_cells(model: CoxModel, cells: DataFrame, groups: int = 5) -> list[dict]:
    """Predicted and observed survival by quantile of risk, on a table of cells ``t, event, n, lp``."""
    edges = quantiles(cells, np.linspace(0, 1, groups + 1)[1:-1].tolist())
    placed = cells.withColumn("g", sum((F.when(F.col("lp") >= e, 1).otherwise(0) for e in edges), F.lit(0)))
    counted = placed.groupBy("g", "t").agg(F.sum(F.when(F.col("event"), F.col("n")).otherwise(0)).alias("d"), F.sum("n").alias("m"))
    observed = {r.g: r for r in survival.summaries(counted, ["g"]).collect()}
    own = [F.sum(F.col("n") * F.exp(F.lit(-model.hazard(s * 1000.0)) * F.exp("lp"))).alias(f"over_{s}") for s in survival.POINTS_SEC]
    predicted = {r.g: r for r in placed.groupBy("g").agg(*own).collect()}
    return [{"group": g, "n": int(observed[g].n), "survival": {s: (predicted[g][f"over_{s}"] / observed[g].n, float(observed[g][f"over_{s}"])) for s in survival.POINTS_SEC}} for g in sorted(observed)]


def train(obs: DataFrame, categorical: dict[str, int], numeric: list[str], force: bool = False, key: str = "arb_id") -> CoxModel | None:
    """Fit on the first four fifths of all observations by time (then ``key``), levels and scales included; the rest tests.

    ``obs`` has ``first_seen, duration_ms, event``, an integer ``key`` and the features. None if there are too few rows or events.
    """
    rows = stored(obs.select("first_seen", F.col(key).alias("_key"), F.greatest(F.lit(1.0), F.col("duration_ms").cast("double")).alias("t"), F.col("event").cast("boolean").alias("event"), *categorical, *[F.col(n).cast("double").alias(n) for n in numeric]), "cox-rows")
    n, events = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("event").cast("long")), F.lit(0))).first()
    if (n < LEAST_ROWS and not force) or events < LEAST_EVENTS:
        return None
    split = int(n * 0.8)
    cut, below = kth(rows, "first_seen", split)
    tie, _ = kth(rows.where(F.col("first_seen") == cut), "_key", split - below)
    is_train = (F.col("first_seen") < cut) | ((F.col("first_seen") == cut) & (F.col("_key") < tie))
    train_rows = rows.where(is_train)
    levels = {name: _levels(train_rows, name, most) for name, most in categorical.items()}
    scales = train_rows.agg(*[f(c) for c in numeric for f in (F.avg, F.stddev_pop)]).first()
    stats = {c: (float(scales[2 * i]), float(scales[2 * i + 1]) or 1.0) for i, c in enumerate(numeric)}
    names, columns = [], []
    for name, own in levels.items():
        value = F.when(F.col(name).cast("string").isin(list(own)), F.col(name).cast("string")).otherwise("other")
        for level in own[1:]:
            names.append(f"{name}={level}")
            columns.append((value == level).cast("double"))
    for c, (mean, std) in stats.items():
        names.append(c)
        columns.append(F.coalesce((F.col(c) - mean) / std, F.lit(0.0)))
    x = [f"x{i}" for i in range(len(names))]
    shown = rows.select(is_train.alias("train"), "t", "event", *[c.alias(i) for c, i in zip(columns, x, strict=True)])
    cells = stored(shown.groupBy("train", "t", "event", *x).agg(F.count(F.lit(1)).alias("n")), "cox-cells")
    known = cells.where("train")
    spread = known.agg(*[F.min(i) for i in x], *[F.max(i) for i in x]).first()
    varied = [i for i in range(len(x)) if spread[i] != spread[len(x) + i]]
    beta = np.zeros(len(x))
    beta[varied] = fit_cells(known, varied, split)
    scored = stored(cells.select("train", "t", "event", "n", _dot(beta).alias("lp")).groupBy("train", "t", "event", "lp").agg(F.sum("n").alias("n")), "cox-scored")
    model = CoxModel(levels, stats, dict(zip(names, beta.tolist(), strict=True)), tuple(baseline_cells(scored.where("train"))), split)
    rest = scored.where("NOT train")
    return CoxModel(**{**model.__dict__, "c_index": concordance_cells(rest), "metrics": {"c_index_train": concordance_cells(scored.where("train")), "calibration": calibration_cells(model, rest)}})


def active_models(registry: DataFrame) -> DataFrame:
    """The newest active model of each kind."""
    newest = F.max_by(F.struct(*registry.columns), F.struct("trained_at", "version"))
    return registry.where("active").groupBy("kind").agg(newest.alias("m")).select("m.*")
