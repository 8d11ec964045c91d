"""Training of a linear adapter on triplets and the choice among adapters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.operators.descriptors import LinearAdapter


def triplet_loss(adapter: LinearAdapter, anchor: np.ndarray, positive: np.ndarray, negative: np.ndarray, margin: float) -> np.ndarray:
    """Hinge on cosines: ``max(0, margin - cos(a, p) + cos(a, n))``."""
    a, p, n = adapter(anchor), adapter(positive), adapter(negative)
    return np.maximum(0.0, margin - (a * p).sum(1) + (a * n).sum(1))


def mini_recall(adapter: LinearAdapter, queries: np.ndarray, references: np.ndarray, positives: Sequence[set[int]]) -> float:
    """K7: share of queries with a positive whose nearest reference is one."""
    best = (adapter(queries) @ adapter(references).T).argmax(1)
    judged = [int(b) in p for b, p in zip(best, positives) if p]
    return float(np.mean(judged)) if judged else 0.0


def train_adapter(
    anchors: np.ndarray, positives: np.ndarray, negatives: np.ndarray, validate, epochs: int = 10, batch: int = 256, rate: float = 1e-3, margin: float = 0.1,
    decay: float = 1e-4, patience: int = 3, min_delta: float = 1e-3, seed: int = 0,
) -> tuple[LinearAdapter, list[float]]:
    """Start from the identity, AdamW on the triplet hinge, stop early on ``validate(adapter)``.

    Epoch 0 is the identity; a later epoch replaces the best only if it gains ``min_delta``.
    Runs on the driver over a bounded sample of triplets. Returns the best adapter and the
    validation values by epoch.
    """
    dim = anchors.shape[1]
    w, b = np.eye(dim), np.zeros(dim)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    best, history, waited, step = LinearAdapter(w.copy(), b.copy()), [], 0, 0
    history.append(validate(best))
    top, rng = history[0], np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(anchors))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = [anchors[rows], positives[rows], negatives[rows]]
            raw = [v @ w.T + b for v in x]
            size = [np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in raw]
            a, p, n = (v / s for v, s in zip(raw, size))
            active = ((margin - (a * p).sum(1) + (a * n).sum(1)) > 0)[:, None] / len(rows)
            slopes = [(n - p) * active, -a * active, a * active]
            # Back through the normalisation: only the part across the unit vector counts.
            slopes = [(g - u * (g * u).sum(1, keepdims=True)) / s for g, u, s in zip(slopes, (a, p, n), size)]
            gw, gb = sum(g.T @ v for g, v in zip(slopes, x)), sum(g.sum(0) for g in slopes)
            step += 1
            for k, (value, slope) in enumerate(((w, gw), (b, gb))):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                value -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * value)
        history.append(validate(LinearAdapter(w.copy(), b.copy())))
        if history[-1] > top + min_delta:
            top, best, waited = history[-1], LinearAdapter(w.copy(), b.copy()), 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best, history


def adapter_verdict(before: Column, after: Column, min_delta: float = 1e-3) -> Column:
    """``better``, ``worse`` or ``same`` by the change of recall; null if either is."""
    gain = after - before
    return F.when(gain > min_delta, "better").when(gain < -min_delta, "worse").when(gain.isNotNull(), "same")
