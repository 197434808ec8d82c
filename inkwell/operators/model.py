"""Calibrated logistic regression over z-scored features; ablation; evidence.

Logistic models are fitted by Newton's method, many side by side: a step is one job, whose tasks send the sums of loss,
gradient and curvature over their rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import stats as st
from inkwell.operators import sampling
from inkwell.operators.stylometry import LIKELIHOOD
from inkwell.runtime import ship
from inkwell.sources import checkpoint

MAX_ITERATIONS, PENALTY, TOLERANCE = 1000, 1.0, 1e-10
ROWS_PER_TASK = 50_000
MIN_WORDS = 150

# What an ablation leaves out.
FAMILIES = {
    "likelihood_all": LIKELIHOOD,
    "cross_ppl_ratio": ["cross_ppl_ratio"],
    "punctuation_construction": ["em_dash_rate", "semicolon_rate", "oxford_comma_rate", "construction_template_rate"],
    "error_rates": ["spelling_error_rate", "homophone_error_rate"],
    "concreteness": ["proper_noun_rate", "numeral_rate", "named_entity_rate"],
}


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing features count as 0, the mean."""
    return df.withColumns({c: F.coalesce(st.known(F.col(c)), F.lit(0.0)) for c in features})


@dataclass
class Logistic:
    features: list[str]
    coefficients: list[float]
    intercept: float

    def margin(self) -> Column:
        return sum((F.col(c) * w for c, w in zip(self.features, self.coefficients)), F.lit(self.intercept))


def chance(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


@dataclass
class Fit:
    """A logistic model to fit: over all rows, over those of other folds than ``without``, or over those of the fold ``only``.
    The intercept has no penalty."""

    features: list[str]
    penalty: float = 1 / PENALTY
    without: int | None = None
    only: int | None = None


def solve(rows: DataFrame, fits: list[Fit], target: str) -> list[Logistic]:
    """Fit all of them to the end, side by side. rows: the features, ``_fold`` and a target from 0 to 1."""
    ship(rows.sparkSession)
    columns = sorted({c for f in fits for c in f.features})
    places = [[columns.index(c) for c in f.features] for f in fits]
    base = rows.select(target, "_fold", *columns)

    def sums(at: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Of each fit that goes on: rows, loss, gradient and curvature at its weights, the intercept's first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = {i: np.zeros(2 + len(w) + len(w) ** 2) for i, w in at.items()}
            for b in batches:
                y, fold, *rest = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                whole = np.column_stack([np.ones(len(y)), *rest])
                for i, w in at.items():
                    f = fits[i]
                    own = np.ones(len(y), bool) if f.without is None and f.only is None else fold != f.without if f.only is None else fold == f.only
                    x, t = whole[own][:, [0, *(k + 1 for k in places[i])]], y[own]
                    m = x @ w
                    p = 0.5 * (1 + np.tanh(m / 2))
                    out[i] += np.concatenate([[len(t), (np.logaddexp(0, m) - t * m).sum()], x.T @ (p - t), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v.tobytes() for v in out.values()], pa.binary())], ["fit", "sums"])

        total = {i: np.zeros(2 + len(w) + len(w) ** 2) for i, w in at.items()}
        for r in base.mapInArrow(run, "fit int, sums binary").collect():  # a row for each fit and task
            total[r.fit] += np.frombuffer(r.sums)
        return total

    most = base.agg(*(F.max(F.abs(c)).alias(c) for c in columns)).first() if columns else {}
    top = [np.array([1.0] + [most[c] or 0.0 for c in f.features]) for f in fits]
    best = [np.zeros(1 + len(f.features)) for f in fits]  # the lowest so far
    lowest, step, least, short = [np.inf] * len(fits), [np.zeros(1)] * len(fits), [0.0] * len(fits), [False] * len(fits)
    at = dict(enumerate(best))
    for _ in range(MAX_ITERATIONS):
        if not at:
            break
        tried, at = at, {}
        for i, s in sums(tried).items():
            w, k = tried[i], len(tried[i])
            ridge = np.array([0.0] + [fits[i].penalty] * (k - 1))
            loss = s[1] + (ridge * w * w).sum() / 2
            if loss > lowest[i] - (0 if short[i] else least[i]) + 1e-12 * abs(loss):
                # too far: a step that moves no margin by more than r leads down at log(1 + r) / r of its length
                r = float(top[i] @ np.abs(step[i]))
                step[i], short[i] = step[i] / 2 if short[i] else step[i] * np.log1p(r) / r, True
                at[i] = best[i] + step[i]
                continue
            slope, curve = s[2 : 2 + k] + ridge * w, s[2 + k :].reshape(k, k) + np.diag(ridge)
            step[i] = -np.linalg.lstsq(curve, slope, rcond=None)[0]
            best[i], lowest[i], least[i], short[i] = w, loss, -(slope @ step[i]) / 10, False
            if -slope @ step[i] > TOLERANCE * max(s[0], 1):
                at[i] = w + step[i]
            else:
                best[i] = w + step[i]
    return [Logistic(f.features, [float(x) for x in w[1:]], float(w[0])) for f, w in zip(fits, best)]


@dataclass
class CalibratedModel:
    """One logistic model and one calibrator for each fold; a probability is their mean. ``plain`` is fitted on all rows."""

    features: list[str]
    folds: list[tuple[Logistic, Logistic | IsotonicRegressionModel]] = field(default_factory=list)
    plain: Logistic | None = None
    method: str = "isotonic"

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        columns, rows = df.columns, filled(df, self.features)
        parts = []
        for k, (model, calibrator) in enumerate(self.folds):
            rows = rows.withColumn("_m", model.margin())
            if self.method == "isotonic":
                rows = calibrator.transform(rows).withColumnRenamed("prediction", f"_p{k}")
            else:
                rows = rows.withColumn(f"_p{k}", chance(calibrator.margin()))
            parts.append(F.col(f"_p{k}"))
        return rows.withColumn("_mean", sum(parts, F.lit(0.0)) / len(parts)).select(*(c for c in columns if c != name), F.col("_mean").alias(name))

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.features, self.plain.coefficients))

    def save(self, path: str) -> None:
        isotonic = self.method == "isotonic"
        for k, (_, calibrator) in enumerate(self.folds if isotonic else []):
            calibrator.write().overwrite().save(f"{path}/calibrator{k}")
        spark = SparkSession.getActiveSession()
        about = {"features": self.features, "method": self.method, "folds": [[asdict(m), None if isotonic else asdict(c)] for m, c in self.folds], "plain": self.plain and asdict(self.plain)}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CalibratedModel:
        """What ``save`` has written; fails with a plain message if nothing is there."""
        if not checkpoint.exists(spark, f"{path}/about"):
            raise FileNotFoundError(f"no trained model at {path}; train and save one first")
        about = json.loads(spark.read.parquet(f"{path}/about").first().about)
        folds = [(Logistic(**m), Logistic(**c) if c else IsotonicRegressionModel.load(f"{path}/calibrator{k}")) for k, (m, c) in enumerate(about["folds"])]
        return cls(about["features"], folds, Logistic(**about["plain"]) if about["plain"] else None, about["method"])


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, kept for the many passes of a fit, in as many partitions as their rows are worth."""
    whole = df.select(*columns).persist()
    few = whole.coalesce(max(1, -(-whole.count() // ROWS_PER_TASK))).persist()
    few.count()
    whole.unpersist()
    return few


def target(label: Column, up: Column, down: Column) -> Column:
    """(n + 1) / (n + 2) of n rows of label 1, 1 / (n + 2) of label 0, so that a calibrator never becomes certain of few rows."""
    return F.when(label == 1, (up + 1) / (up + 2)).otherwise(1 / (down + 2))


def smoothed(held: DataFrame) -> DataFrame:
    """Each row under both labels, weighted by its smoothed target."""
    n = held.agg(F.sum("label").alias("_up"), F.sum(1 - F.col("label")).alias("_down"))
    up = target(F.col("label"), F.col("_up"), F.col("_down"))
    both = F.array(F.struct(F.lit(1.0).alias("label"), up.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - up).alias("weight")))
    return held.join(F.broadcast(n)).select("_m", F.inline(both))  # one row


def fit(df: DataFrame, key: str, features: list[str], **how) -> CalibratedModel:
    """One model by ``fit_all``."""
    return fit_all(df, key, [features], **how)[0]


def fit_all(df: DataFrame, key: str, sets: list[list[str]], *, seed: int = 42, method: str = "isotonic", folds: int = 3, plain: bool = True) -> list[CalibratedModel]:
    """A model for each set of features. df: the key, ``label`` (0 or 1) and the features. Folds hold a like share of each
    label, dealt in hash order; there are min(folds, smallest class), two at least."""
    features = list(dict.fromkeys(c for s in sets for c in s))
    base = numbers(filled(df, features).withColumn("label", F.col("label").cast("double")), [key, "label", *features])
    counts = {r.label: r["count"] for r in base.groupBy("label").count().collect()}
    if len(counts) < 2:
        base.unpersist()
        raise ValueError("both classes are needed")
    folds = max(2, min(folds, min(counts.values())))
    rows = numbers(sampling.numbered(base, key, "_place", by=["label"], seed=seed).withColumn("_fold", F.pmod("_place", F.lit(folds))), [key, "label", *features, "_fold"])
    base.unpersist()
    wanted = [Fit(s, without=k) for s in sets for k in range(folds)] + [Fit(s) for s in sets if plain]
    found = iter(solve(rows, wanted, "label"))
    models = [[next(found) for _ in range(folds)] for _ in sets]
    # each row's margins by the models that haven't seen it
    held = rows.select("_fold", "label", *(F.coalesce(*(F.when(F.col("_fold") == k, m.margin()) for k, m in enumerate(ms))).alias(f"_m{i}") for i, ms in enumerate(models)))
    if method == "isotonic":
        made = iter([IsotonicRegression(featuresCol=f"_m{i}", labelCol="label").fit(held.where(F.col("_fold") == k)).setFeaturesCol("_m") for i in range(len(sets)) for k in range(folds)])
    else:
        n = rows.groupBy("_fold").agg(F.sum("label").alias("_up"), F.sum(1 - F.col("label")).alias("_down"))
        held = held.join(F.broadcast(n), "_fold").withColumn("_t", target(F.col("label"), F.col("_up"), F.col("_down")))  # a row for each fold
        made = iter([Logistic(["_m"], c.coefficients, c.intercept) for c in solve(held, [Fit([f"_m{i}"], 0.0, only=k) for i in range(len(sets)) for k in range(folds)], "_t")])
    out = [CalibratedModel(s, [(m, next(made)) for m in ms], next(found) if plain else None, method) for s, ms in zip(sets, models)]
    rows.unpersist()
    return out


def train(frame: DataFrame, key: str, features: list[str], *, path: str | None = None, seed: int = 42) -> tuple[CalibratedModel, DataFrame, DataFrame]:
    """The whole run: split by label, fit with isotonic calibration (with a sigmoid where a class is too small for it),
    report and save. Returns the model, (key, split), and a one-row report of sizes and accuracies."""
    parts = numbers(sampling.train_test(frame, key, "label", seed=seed), [key, "label", "split", *features])
    own = parts.where("split = 'train'")
    smallest = own.groupBy("label").count().agg(F.min("count").alias("n")).first().n or 0
    fitted = fit(own, key, features, seed=seed, method="isotonic" if smallest >= 2 else "sigmoid", plain=False)
    fitted.plain = solve(filled(parts, features).withColumns({"label": F.col("label").cast("double"), "_fold": F.lit(0)}), [Fit(features)], "label")[0]
    right = ((F.col("probability") >= 0.5).cast("int") == F.col("label")).cast("double")
    part = lambda name: F.col("split") == name
    report = fitted.score(parts).agg(*(f.alias(f"{n}_{name}") for name in ("train", "test") for n, f in (("rows", F.count_if(part(name))), ("accuracy", F.avg(F.when(part(name), right))))))
    split = parts.select(key, "split")
    if path:
        fitted.save(path)
        split.write.mode("overwrite").parquet(f"{path}/split")
        report.write.mode("overwrite").parquet(f"{path}/report")
    return fitted, split, report


def ablation(df: DataFrame, key: str, features: list[str], families: dict[str, list[str]] = FAMILIES) -> list[tuple[str, float | None]]:
    """Held-out AUC with all features and without each family, all fitted side by side; None where a class is too small for
    a fit."""
    from inkwell.operators.metrics import auc

    parts = numbers(sampling.train_test(df, key, "label"), [key, "label", "split", *features])
    without = {"full_model": [], **{f"without_{k}": v for k, v in families.items()}}
    left = {name: [c for c in features if not any(c == d or c == f"{d}_z" for d in dropped)] for name, dropped in without.items()}
    found: dict[str, float | None] = {}
    try:
        models = fit_all(parts.where("split = 'train'"), key, list(left.values()), method="sigmoid", folds=2, plain=False)
    except ValueError:
        models = []
    if models:
        test = parts.where("split = 'test'")
        scored = [m.score(test, "score").select("label", F.lit(name).alias("family"), "score") for name, m in zip(left, models)]
        found = {r.family: r.auc for r in auc(reduce(DataFrame.unionAll, scored), "score", "label", "family").collect()}
    parts.unpersist()
    return [(name, found.get(name)) for name in left]


def evidence(df: DataFrame, words: str, probability: str, coefficients: dict[str, float], top: int = 10) -> DataFrame:
    """Abstain under MIN_WORDS words; else the uncertainty band and the features by the size of their contribution
    (z times coefficient). df has <feature>_z columns named as the coefficients' keys."""
    low, high = st.uncertainty(F.col(probability))
    rows = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("z"), (F.col(c) * v).alias("contribution")) for c, v in coefficients.items()))
    order = F.array_sort(rows, lambda a, b: F.when(F.abs(a.contribution) > F.abs(b.contribution), -1).when(F.abs(a.contribution) < F.abs(b.contribution), 1).when(a["name"] < b["name"], -1).otherwise(1))
    short = F.coalesce(F.col(words), F.lit(0)) < MIN_WORDS
    shown = lambda c: F.when(~short, c)
    return df.select("*", short.alias("abstained"), shown(low).alias("band_low"), shown(high).alias("band_high"), shown(F.slice(order, 1, top)).alias("evidence"))


def heat(df: DataFrame, doc: str, signal: str) -> DataFrame:
    """Add ``heat``: the signal scaled to 0 to 1 inside its document."""
    span = df.groupBy(doc).agg(F.min(signal).alias("_lo"), F.max(signal).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return df.join(span, doc).withColumn("heat", (F.col(signal) - F.col("_lo")) / width).drop("_lo", "_hi")
