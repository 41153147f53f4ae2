"""Mixed logistic regression with two nested random intercepts: likelihoods summed in Spark, steps taken on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.storage import written

#: Newton steps for a group's intercepts, and for the parameters; lengths of a step that are tried together.
INNER, OUTER, LENGTHS = 60, 40, (1.0, 0.5, 0.2, 0.05, 0.005)
# What a fit must meet to be trusted.
MOST_COEFFICIENT, MOST_ERROR, MOST_GRADIENT, SINGULAR = 20.0, 10.0, 0.002, 1e-4


def counted(rows: DataFrame, group: str, sub: str, terms: Mapping[str, Column], success: Column) -> DataFrame:
    """A row for each group: its cells (sub, x, n, y), rows that are alike in sub and terms counted together.

    However many rows there are, a group has no more cells than sub-groups times different designs. Cells with null terms or outcomes
    are refused.
    """
    x = F.array(*(c.cast("double") for c in terms.values()))
    base = rows.select(F.col(group).alias("group"), F.col(sub).alias("sub"), x.alias("x"), success.cast("int").alias("ok"))
    whole = F.col("ok").isNotNull() & ~F.exists("x", lambda v: v.isNull())
    base = base.withColumn("ok", F.when(whole, F.col("ok")).otherwise(F.raise_error(F.lit("a term or an outcome is null")).cast("int")))
    cells = base.groupBy("group", "sub", "x").agg(F.count("*").alias("n"), F.sum("ok").alias("y"))
    return cells.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("sub", "x", "n", "y"))).alias("cells"))


def laplace(x: np.ndarray, n: np.ndarray, y: np.ndarray, sub: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Log likelihood of one group at each point (coefficients and two deviations), its intercepts integrated by Laplace's method.

    The group has an intercept b and each sub-group one of its own, c. Their mode is found by Newton steps; the matrix of second
    derivatives has a border and a diagonal, so it is solved, and its determinant taken, without a matrix.
    """
    beta, s1, s2 = points[:, :-2], points[:, -2:-1], points[:, -1:]
    own = np.eye(sub.max() + 1)[sub]
    fixed = beta @ x.T
    b, c = np.zeros_like(s1), np.zeros((len(points), own.shape[1]))
    for _ in range(INNER):
        eta = fixed + s1 * b + s2 * (c @ own.T)
        mu = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
        w, r = (n * mu * (1 - mu)) @ own, (y - n * mu) @ own
        gb, gc = s1 * r.sum(axis=1, keepdims=True) - b, s2 * r - c
        hb, hc, hbc = 1 + s1**2 * w.sum(axis=1, keepdims=True), 1 + s2**2 * w, s1 * s2 * w
        schur = hb - (hbc**2 / hc).sum(axis=1, keepdims=True)
        db = (gb - (hbc * gc / hc).sum(axis=1, keepdims=True)) / schur
        dc = (gc - hbc * db) / hc
        scale = np.minimum(1, 4 / np.maximum(1e-300, np.maximum(np.abs(db), np.abs(dc).max(axis=1, keepdims=True))))
        b, c = b + scale * db, c + scale * dc
        if max(np.abs(db).max(), np.abs(dc).max()) < 1e-10:
            break
    eta = fixed + s1 * b + s2 * (c @ own.T)
    mu = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
    w = (n * mu * (1 - mu)) @ own
    hc = 1 + s2**2 * w
    schur = 1 + s1[:, 0] ** 2 * w.sum(axis=1) - ((s1 * s2 * w) ** 2 / hc).sum(axis=1)
    fit = (y * eta - n * np.logaddexp(0, eta)).sum(axis=1)
    return fit - (b[:, 0] ** 2 + (c**2).sum(axis=1)) / 2 - (np.log(hc).sum(axis=1) + np.log(schur)) / 2


def log_likelihoods(cells: DataFrame, points: np.ndarray) -> np.ndarray:
    """Sums over all groups, at all points in one pass. A task sends one number for each point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(points))
        for batch in batches:
            for own in batch.column(0).to_pylist():
                _, sub = np.unique([str(v["sub"]) for v in own], return_inverse=True)
                total += laplace(np.array([v["x"] for v in own]), *(np.array([v[k] for v in own], float) for k in "ny"), sub, points)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(points)), pa.int32()), pa.array(total)], ["point", "v"])

    out = np.zeros(len(points))
    for r in cells.select("cells").mapInArrow(run, "point int, v double").groupBy("point").agg(F.sum("v").alias("v")).collect():
        out[r["point"]] = r["v"]
    return out


@dataclass
class Fit:
    """terms and estimates (deviations last), their errors, the log likelihood, and what was checked."""

    terms: list[str]
    estimates: np.ndarray
    errors: np.ndarray
    log_likelihood: float
    checks: dict[str, bool]

    @property
    def passed(self) -> bool:
        return all(self.checks.values())


def _differences(cells: DataFrame, at: np.ndarray, step: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and second derivatives by differences, all from one pass."""
    p = len(at)
    h = step * np.maximum(1, np.abs(at))
    e = np.diag(h)
    i, j = np.triu_indices(p, 1)
    v = log_likelihoods(cells, np.concatenate([[at], at + e, at - e, at + e[i] + e[j], at - e[i] - e[j]]))
    f, up, down, both, neither = v[0], v[1 : p + 1], v[p + 1 : 2 * p + 1], v[2 * p + 1 : 2 * p + 1 + len(i)], v[2 * p + 1 + len(i) :]
    second = np.diag((up - 2 * f + down) / h**2)
    second[i, j] = second[j, i] = (both + neither + 2 * f - up[i] - up[j] - down[i] - down[j]) / (2 * h[i] * h[j])
    return f, (up - down) / (2 * h), second


def fit(cells: DataFrame, terms: Sequence[str]) -> Fit:
    """The parameters of greatest likelihood, by Newton steps; a step is damped until its matrix is positive and its value rises.

    cells: as counted() gives, stored if they are dear to make. A term of which the likelihood has no maximum (separation), a deviation
    at 0 and other faults are reported in checks and never raised.
    """
    at = np.concatenate([np.zeros(len(terms)), [0.5, 0.5]])
    f = -np.inf
    for _ in range(OUTER):
        f, gradient, second = _differences(cells, at, 1e-3)
        least = np.linalg.eigvalsh(-second).min()
        step = np.linalg.solve(-second + max(0.0, 1e-6 - least) * 1.1 * np.eye(len(at)), gradient)
        step *= min(1.0, 5 / max(1e-300, np.abs(step).max()))
        tried = at + np.outer(LENGTHS, step)
        values = log_likelihoods(cells, tried)
        best = int(np.argmax(values))
        if not values[best] > f + 1e-9:
            break
        at = tried[best]
        if values[best] - f < 1e-8 or np.abs(at[: len(terms)]).max(initial=0) > 2 * MOST_COEFFICIENT:
            break
    at[-2:] = np.abs(at[-2:])
    f, gradient, second = _differences(cells, at, 1e-3)
    positive = bool(np.isfinite(second).all() and np.linalg.eigvalsh(-second).min() > 0)
    errors = np.sqrt(np.diag(np.linalg.inv(-second))) if positive else np.full(len(at), np.nan)
    scaled = np.abs(np.linalg.solve(np.linalg.cholesky(-second), gradient)).max() if positive else np.inf
    beta, beta_errors = at[:-2], errors[:-2]
    checks = {
        "curvature_positive": positive, "gradient_small": bool(scaled <= MOST_GRADIENT), "deviations_above_zero": bool((at[-2:] > SINGULAR).all()),
        "coefficients_bounded": bool(np.abs(beta).max(initial=0) < MOST_COEFFICIENT), "errors_bounded": bool(positive and beta_errors.max(initial=0) < MOST_ERROR),
    }
    checks["no_separation"] = checks["coefficients_bounded"] and (not positive or checks["errors_bounded"])
    return Fit([*terms, "sd_group", "sd_sub"], at, errors, float(f), checks)


def likelihood_ratio(rows: DataFrame, group: str, sub: str, terms: Mapping[str, Column], tested: Sequence[str], success: Column) -> tuple[Fit, Fit, float, int, float]:
    """The fit with all terms, that without the tested ones, and the test between them: statistic, degrees of freedom, p."""
    from tallyloom.plans.rules import chi_square_tail

    rest = [n for n in terms if n not in set(tested)]
    full = fit(written(counted(rows, group, sub, terms, success)), list(terms))
    null = fit(written(counted(rows, group, sub, {n: terms[n] for n in rest}, success)), rest)
    statistic = max(0.0, 2 * (full.log_likelihood - null.log_likelihood))
    return full, null, statistic, len(tested), chi_square_tail(statistic, len(tested))
