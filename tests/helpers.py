"""Small frames and plain-Python counterparts."""

from __future__ import annotations

import numpy as np


def series(spark, lists, name="z"):
    """{key: [values]} → rows (key, n, value)."""
    rows = [(k, n, None if v is None else float(v)) for k, vs in lists.items() for n, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"key string, n long, {name} double")


def by_key(df, *columns):
    """Rows as sorted tuples per key."""
    out = {}
    for row in df.select("key", *columns).collect():
        out.setdefault(row[0], []).append(tuple(row[1:]) if len(columns) > 1 else row[1])
    return {k: sorted(v) for k, v in out.items()}


def maxima(z):
    """Middle positions (rounded down) of runs that rise and then fall."""
    found, i = [], 1
    while i < len(z) - 1:
        if z[i] > z[i - 1]:
            j = i
            while j + 1 < len(z) and z[j + 1] == z[i]:
                j += 1
            if j + 1 < len(z) and z[j + 1] < z[i]:
                found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    return found


def greedy(candidates, d):
    """candidates: [(position, height)]; highest first, later one of equals."""
    kept = []
    for p, h in sorted(candidates, key=lambda c: (c[1], c[0]), reverse=True):
        if all(abs(p - q) >= d for q in kept):
            kept.append(p)
    return sorted(kept)


def butterworth(x, cutoff=6.0, fs=100.0):
    """Recursive form of the zero-phase filter, with steady-state start and odd padding of 9 rows."""
    k = np.tan(np.pi * cutoff / fs)
    scale = 1 + np.sqrt(2) * k + k * k
    b0, b1, b2 = k * k / scale, 2 * k * k / scale, k * k / scale
    a1, a2 = 2 * (k * k - 1) / scale, (1 - np.sqrt(2) * k + k * k) / scale
    x = np.asarray(x, float)
    e = np.concatenate([2 * x[0] - x[9:0:-1], x, 2 * x[-1] - x[-2:-11:-1]])

    def forward(v):
        y = np.empty_like(v)
        x1 = x2 = y1 = y2 = v[0]
        for i, cur in enumerate(v):
            y[i] = b0 * cur + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x2, x1, y2, y1 = x1, cur, y1, y[i]
        return y

    return forward(forward(e)[::-1])[::-1][9:-9]
