"""Signature fitting on 96-context spectra: small dense algebra with numpy.

A spectrum has 96 numbers, whatever the cohort, so fits run on the driver or, for
many samples, one Arrow group per sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.alleles import contexts96


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Least squares with nonnegative coefficients, by the active set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    grad = a.T @ (b - a @ x)
    for _ in range(30 * n):
        free = ~active
        if not free.any() or grad[free].max() <= tolerance:
            break
        active[np.flatnonzero(free)[np.argmax(grad[free])]] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (s[active] > 0).all():
                x = s
                break
            bad = active & (s <= 0)
            step = np.min(x[bad] / (x[bad] - s[bad]))
            x = x + step * (s - x)
            active &= x > tolerance
            x[~active] = 0.0
            if not active.any():
                break
        grad = a.T @ (b - a @ x)
    return x


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    norm = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / norm if norm else 0.0


def fit(spectrum: np.ndarray, signatures: pd.DataFrame, top: int | None = None) -> dict:
    """Exposures of ``signatures`` (contexts x names) in a spectrum; with ``top``, fitted again on that many."""
    order = signatures.reindex(contexts96()).fillna(0.0)
    names = list(order.columns)
    x = nnls(order.to_numpy(float), spectrum)
    if top and top < len(names):
        best = np.sort(np.argsort(-x, kind="stable")[:top])
        names = [names[i] for i in best]
        x = nnls(order[names].to_numpy(float), spectrum)
    again = order[names].to_numpy(float) @ x
    total, whole = x.sum(), spectrum.sum()
    return {
        "names": names, "exposures": x, "shares": x / total if total else x, "cosine": cosine(spectrum, again),
        "residual_pct": float(np.linalg.norm(spectrum - again) / whole * 100) if whole else 0.0,
    }


def fit_samples(matrix: DataFrame, signatures: pd.DataFrame) -> DataFrame:
    """``sample, signature, exposure, share, cosine`` from ``matrix(sample, context, n)``, a group of 96 rows each."""
    order = contexts96()

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        counts = rows.set_index("context")["n"].reindex(order).fillna(0.0).to_numpy(float)
        found = fit(counts, signatures)
        return pd.DataFrame({"sample": rows["sample"].iloc[0], "signature": found["names"], "exposure": found["exposures"], "share": found["shares"], "cosine": found["cosine"]})

    return matrix.select("sample", "context", "n").groupBy("sample").applyInPandas(one, "sample string, signature string, exposure double, share double, cosine double")


def _start(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First factors from the leading singular pairs' dominant signs, zeros filled with the mean."""
    u, s, vt = np.linalg.svd(v, full_matrices=False)
    w, h = np.zeros((v.shape[0], k)), np.zeros((k, v.shape[1]))
    w[:, 0], h[0] = np.sqrt(s[0]) * np.abs(u[:, 0]), np.sqrt(s[0]) * np.abs(vt[0])
    for j in range(1, k):
        x, y = u[:, j], vt[j]
        pos, neg = (np.maximum(x, 0), np.maximum(y, 0)), (np.maximum(-x, 0), np.maximum(-y, 0))
        size = [np.linalg.norm(p) * np.linalg.norm(q) for p, q in (pos, neg)]
        p, q = (pos, neg)[int(size[1] > size[0])]
        scale = max(size)
        if scale > 0:
            w[:, j] = np.sqrt(s[j] * scale) * p / np.linalg.norm(p)
            h[j] = np.sqrt(s[j] * scale) * q / np.linalg.norm(q)
    mean = v.mean()
    return np.where(w < 1e-9, mean / 100, w), np.where(h < 1e-9, mean / 100, h)


def nmf(matrix: np.ndarray, k: int, rounds: int = 1000, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """``exposures (samples x k), profiles (k x contexts)`` of a samples x contexts matrix; profiles sum to 1.

    Coordinate descent on either factor in turn.
    """
    samples = matrix.shape[0]
    if samples < 2 or not 2 <= k <= samples:
        raise ValueError("de novo extraction needs two samples or more, and two to as many signatures")
    w, h = _start(matrix, k)
    last = np.inf
    for _ in range(rounds):
        for a, b, v in ((w, h, matrix), (h.T, w.T, matrix.T)):
            gram, cross = b @ b.T, v @ b.T
            for j in range(k):
                a[:, j] = np.maximum(0, a[:, j] + (cross[:, j] - a @ gram[:, j]) / max(gram[j, j], 1e-12))
        error = float(np.linalg.norm(matrix - w @ h))
        if last - error < tolerance * max(1.0, float(np.linalg.norm(matrix))):
            break
        last = error
    total = h.sum(axis=1)
    return w * total, h / np.where(total == 0, 1, total)[:, None]


def onto_simplex(y: np.ndarray) -> np.ndarray:
    """The nearest vector of nonnegative numbers that sum to 1."""
    u = np.sort(y)[::-1]
    excess = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(0, y - excess[np.flatnonzero(u > excess)[-1]])


def guided(matrix: np.ndarray, known: np.ndarray, rounds: int = 200, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Exposures of ``known`` profiles (k x contexts) and one more, which is found, and that profile."""
    residual = np.maximum(0, matrix - np.array([known.T @ nnls(known.T, row) for row in matrix])).sum(axis=0)
    novel = onto_simplex(residual / residual.sum()) if residual.sum() else np.full(matrix.shape[1], 1 / matrix.shape[1])
    last = np.inf
    for _ in range(rounds):
        basis = np.vstack([known, novel])
        exposure = np.array([nnls(basis.T, row) for row in matrix])
        rest, own = matrix - exposure[:, :-1] @ known, exposure[:, -1]
        if own @ own > 0:
            novel = onto_simplex(own @ rest / (own @ own))
        error = float(np.linalg.norm(matrix - exposure @ np.vstack([known, novel])))
        if abs(last - error) < tolerance:
            break
        last = error
    return np.array([nnls(np.vstack([known, novel]).T, row) for row in matrix]), novel


def matches(profile: np.ndarray, signatures: pd.DataFrame, top: int = 3) -> list[tuple[str, float]]:
    """The known signatures nearest to a profile."""
    order = signatures.reindex(contexts96()).fillna(0.0)
    found = [(name, cosine(profile, order[name].to_numpy(float))) for name in order.columns]
    return sorted(found, key=lambda x: -x[1])[:top]


def metrics(matrix: np.ndarray, again: np.ndarray) -> dict[str, float]:
    size = float(np.linalg.norm(matrix))
    return {"cosine": cosine(matrix.ravel(), again.ravel()), "relative_error_pct": float(np.linalg.norm(matrix - again)) / size * 100 if size else 0.0}


def tidy(exposures: np.ndarray, samples: list[str], names: list[str]) -> pd.DataFrame:
    """A row for each sample and signature."""
    total = exposures.sum(axis=1, keepdims=True)
    share = np.divide(exposures, total, out=np.zeros_like(exposures), where=total > 0)
    rows = [(s, n, exposures[i, j], share[i, j]) for i, s in enumerate(samples) for j, n in enumerate(names)]
    return pd.DataFrame(rows, columns=["sample", "signature", "exposure", "share"])
