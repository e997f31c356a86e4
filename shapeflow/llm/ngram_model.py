"""Hashed features and logistic regression, shared by the quality rules and the toxicity scorer.

Features and scores are computed inside tasks, in Arrow batches; only the weights, of a
fixed number of buckets, travel to the workers.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Odd multipliers of the hashes of 32-bit codes.
MIX_A, MIX_B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def code_buckets(codes: np.ndarray, bits: int) -> np.ndarray:
    """Multiplicative hash of uint32 codes to ``bits`` bits."""
    codes = codes.astype(np.uint32, copy=False)
    return ((codes ^ (codes >> np.uint32(15))) * MIX_A) >> np.uint32(32 - bits)


def code_bucket(code: int, bits: int) -> int:
    """``code_buckets`` of one code."""
    return ((code ^ code >> 15) * int(MIX_A) & 0xFFFFFFFF) >> (32 - bits)


def char_codes(data: bytes) -> np.ndarray:
    """Every four consecutive bytes as one uint32."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, dtype=np.uint32)
    return b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))


def fit_logistic(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, target: np.ndarray, size: int, l2: float = 1e-5, steps: int = 120, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on a sparse matrix given as (row, bucket, value) triples sorted by row.

    ``target`` may be soft (probabilities). Adam on the whole (bounded) sample; the order of
    all sums is fixed, so the same sample gives the same weights.
    """
    used, place = np.unique(buckets, return_inverse=True)
    w, b, n = np.zeros(len(used)), 0.0, max(1, len(target))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, values * w[place], minlength=len(target)) + b
        gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / n
        g, gb = np.bincount(place, values * gap[rows], minlength=len(used)) + l2 * w, gap.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    full = np.zeros(size, dtype=np.float32)
    full[used] = w
    return full, float(b)


def fit_platt(z: np.ndarray, target: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and intercept that turn raw scores into probabilities (Newton's method, slightly damped)."""
    if not len(z) or not 0 < target.sum() < len(z):
        return 1.0, 0.0
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        ga, gb = ((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * b
        haa, hab, hbb = (w * z * z).sum() + 1e-3, (w * z).sum(), w.sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - 0.5 * da, b - 0.5 * db
        if abs(da) + abs(db) < 1e-10:
            break
    return float(max(a, 1e-3)), float(b)


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))
