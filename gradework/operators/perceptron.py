"""Perceptron regression by full-batch gradient steps: tasks compute gradients over their rows, sums come back, weights go out.

All folds' models take each step together, so one pass over the rows serves them all; a row adds to every model but its own fold's.
Only weights and their gradients, whose size depends on the layers alone, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hidden layers, penalty, learning rate.
HIDDEN = (64, 32)
PENALTY = 1e-2
RATE = 0.01
STEPS = 80


def _shapes(inputs: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    sizes = [inputs, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:]))


def initial(inputs: int, hidden: tuple[int, ...], seed: int) -> np.ndarray:
    """He-initialised weights of all layers, flat, each layer's biases behind its weights."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return np.concatenate([np.concatenate([rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)]) for a, b in _shapes(inputs, hidden)])


def _layers(theta: np.ndarray, shapes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes:
        out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def answer(theta: np.ndarray, x: np.ndarray, hidden: tuple[int, ...]) -> np.ndarray:
    for k, (w, b) in enumerate(_layers(theta, _shapes(x.shape[1], hidden))):
        x = x @ w + b
        x = np.maximum(x, 0) if k < len(hidden) else x
    return x[:, 0]


def gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: tuple[int, ...]) -> tuple[np.ndarray, float]:
    """Slope and value of half the weighted sum of squares."""
    layers = _layers(theta, _shapes(x.shape[1], hidden))
    seen = [x]
    for k, (w, b) in enumerate(layers):
        z = seen[-1] @ w
        z += b
        seen.append(np.maximum(z, 0, out=z) if k < len(hidden) else z)
    gap = seen[-1][:, 0] - y
    delta, parts = (weight * gap)[:, None], []
    for k in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(seen[k].T @ delta).ravel(), delta.sum(axis=0)]))
        if k:  # nothing lies before the features
            delta = delta @ layers[k][0].T
            delta *= seen[k] > 0
    return np.concatenate(parts[::-1]), float((weight * gap**2).sum() / 2)


@dataclass(frozen=True)
class Training:
    """What a fold's model knows of its training rows: scale of the features and weights of the grades."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[float, float]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Missing features are the mean."""
        return np.nan_to_num((x - self.mean) / self.spread, nan=0.0)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _features(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    return _column(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)


def _others(folds: pa.Array, k: str) -> np.ndarray:
    """Which rows are of other folds."""
    return pc.not_equal(folds, k).to_numpy(zero_copy_only=False)


def trainings(rows: DataFrame, features: int) -> dict[str, Training]:
    """fold -> scale and weights of all other folds' labelled rows; grades weigh the same in sum.  One aggregation, a row for each fold and grade."""
    each = rows.filter("y is not null").groupBy("fold", "y").agg(F.count("*").alias("n"), *(f(F.when(~F.isnan(F.get("x", F.lit(i))), F.get("x", F.lit(i)) ** k)).alias(f"{name}{k}_{i}") for i in range(features) for name, f, k in (("c", F.count, 1), ("s", F.sum, 1), ("s", F.sum, 2)))).collect()
    out = {}
    for fold in sorted({r[0] for r in rows.select("fold").distinct().collect()}):
        others = [r for r in each if r["fold"] != fold]
        total = lambda name: np.array([sum(r[f"{name}_{i}"] or 0.0 for r in others) for i in range(features)], dtype=np.float64)
        n = np.maximum(total("c1"), 1)
        mean = total("s1") / n
        spread = np.sqrt(np.maximum(total("s2") / n - mean**2, 0))
        counts: dict[float, int] = {}
        for r in others:
            counts[r["y"]] = counts.get(r["y"], 0) + r["n"]
        weights = {g: sum(counts.values()) / (len(counts) * k) for g, k in counts.items()}
        out[fold] = Training(mean, np.where(spread > 1e-12, spread, 1.0), weights)
    return out


def fit_folds(rows: DataFrame, features: int, known: dict[str, Training], hidden: tuple[int, ...] = HIDDEN, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY, seed: int = 0) -> dict[str, np.ndarray]:
    """fold -> weights of the model that sees all labelled rows but the fold's, by Adam.

    rows: x (array of ``features`` doubles, NaN where missing), y, fold.  Each step is one job whose tasks return a gradient a model.
    """
    start = initial(features, hidden, seed)
    theta = {k: start.copy() for k in known}
    m, v = ({k: np.zeros_like(start) for k in known} for _ in range(2))
    for step in range(1, steps + 1):
        now = {k: theta[k].tobytes() for k in known}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = {k: np.frombuffer(raw) for k, raw in now.items()}
            slopes = {k: np.zeros(len(start)) for k in models}
            mass = dict.fromkeys(models, 0.0)
            for batch in batches:
                x, y = _features(batch, features), _column(batch, "y").to_numpy(zero_copy_only=False)
                folds = _column(batch, "fold")
                grades, grade = np.unique(y, return_inverse=True)  # weights are looked up by grade, not by row
                for k, model in models.items():
                    others = _others(folds, k)
                    if others.any():
                        weight = np.array([known[k].weights.get(g, 0.0) for g in grades.tolist()])[grade[others]]
                        slopes[k] += gradient(model, known[k].scaled(x[others]), y[others], weight, hidden)[0]
                        mass[k] += weight.sum()
            yield pa.RecordBatch.from_arrays([pa.array(list(slopes)), pa.array([s.tobytes() for s in slopes.values()], pa.binary()), pa.array(list(mass.values()))], names=["fold", "slope", "mass"])

        sums, masses = {k: np.zeros(len(start)) for k in known}, dict.fromkeys(known, 0.0)
        for r in rows.filter("y is not null").select("x", "y", "fold").mapInArrow(run, "fold string, slope binary, mass double").collect():  # a row for each task and model
            sums[r["fold"]] += np.frombuffer(bytes(r["slope"]))
            masses[r["fold"]] += r["mass"]
        for k in known:
            slope = sums[k] / max(masses[k], 1e-12) + penalty * theta[k]
            m[k] = 0.9 * m[k] + 0.1 * slope
            v[k] = 0.999 * v[k] + 0.001 * slope**2
            theta[k] = theta[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return theta


def scored(rows: DataFrame, features: int, theta: dict[str, np.ndarray], known: dict[str, Training], carry: list[str], hidden: tuple[int, ...] = HIDDEN) -> DataFrame:
    """(carry..., grade_score) of each row by the model of its fold, in one pass."""
    raw = {k: t.tobytes() for k, t in theta.items()}
    schema = rows.select(*carry).schema.add("grade_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {k: np.frombuffer(t) for k, t in raw.items()}
        for batch in batches:
            x, folds = _features(batch, features), _column(batch, "fold")
            out = np.zeros(batch.num_rows)
            for k, model in models.items():
                mine = ~_others(folds, k)
                if mine.any():
                    out[mine] = answer(model, known[k].scaled(x[mine]), hidden)
            yield pa.RecordBatch.from_arrays([*(_column(batch, c) for c in carry), pa.array(out)], names=[*carry, "grade_score"])

    return rows.mapInArrow(run, schema)


def cross_validated(df: DataFrame, features: list[str], label: str, fold: str, carry: list[str], hidden: tuple[int, ...] = HIDDEN, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> DataFrame:
    """(carry..., fold, grade_score) of models that have not seen the row's fold, nor taken scale or weights from it.

    Rows without label teach nothing but are scored, missing features are the mean, rows without fold are left out.
    """
    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features))
    given = df.filter(F.col(fold).isNotNull()).select(*carry, F.col(fold).cast("string").alias("fold"), x.alias("x"), F.col(label).cast("double").alias("y")).persist()
    try:
        known = trainings(given, len(features))
        if len(known) < 2:
            raise ValueError("cross-validation needs two folds")
        theta = fit_folds(given, len(features), known, hidden, steps, rate, penalty)
    finally:
        given.unpersist()
    return scored(given, len(features), theta, known, [*carry, "fold"], hidden)
