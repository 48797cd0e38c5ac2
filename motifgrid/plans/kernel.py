"""The tile kernel: all window pairs of two blocks, folded to the best partner of each row and column.

Whole values come centred on a whole number (``prepared``, or the caller's plan):
distances don't see that, and sums stay small. Where ``exact_bound`` holds, window
sums are 64-bit integers (wrapping running sums have exact differences) and every
product sum stays below 2^53 as a double, so results are exact and don't depend
on tiling. Their covariances run down the diagonals: the change from one cell to
the next is a product of two matrices of rank 4, so a cell costs the same for any
window. General doubles take a product of normalised windows (nothing cancels)
or, for long windows, the running form over values centred in each block.

Strips of ``STRIP`` rows keep a tile's work in the processor's cache.
"""

from __future__ import annotations

import numpy as np

#: Rows of a strip, and window length from which general doubles take the running form.
STRIP, LONG_WINDOW = 16, 512


def exact_bound(m: int, top: int) -> bool:
    """Whether windows of whole values up to ``top`` in size have exact sums of products in doubles.

    The largest intermediate value is a change of covariances, under
    ``(2 * m * top)^2`` in all its partial sums.
    """
    return (2 * m * int(top)) ** 2 <= 2**53


def prepared(values: np.ndarray, m: int) -> tuple[np.ndarray, bool]:
    """A series in memory, centred, and whether it is exact: whole values (64-bit integers or doubles) in a small range."""
    x = np.asarray(values)
    if x.dtype.kind in "iu":
        if not len(x):
            return x.astype(float), True
        low, high = int(x.min()), int(x.max())
    else:
        there = x[np.isfinite(x)]
        x = np.where(np.isfinite(x), x, np.nan)
        if not len(there):
            return x, True
        low, high = float(there.min()), float(there.max())
        if not (np.abs(there).max() < 2**53 and (there == np.round(there)).all()):
            return x - there.mean(), False
        low, high = int(low), int(high)
    centre = (low + high) // 2
    out = (x - centre).astype(float) if high - low < 2**62 else x.astype(float) - float(centre)
    return out, exact_bound(m, high - centre)


def sliding(v: np.ndarray, m: int) -> np.ndarray:
    """Sums over windows of whole numbers: running sums may wrap, their differences are exact."""
    run = np.concatenate([[0], np.cumsum(v)])
    return run[m:] - run[:-m]


def stats(a: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and ``m`` times the deviation of each full window of whole values; NaN where a value is missing."""
    if len(a) < m:
        return np.zeros(0), np.zeros(0)
    bad = np.isnan(a)
    x = np.where(bad, 0.0, a).astype(np.int64)
    s, q, b = sliding(x, m), sliding(x * x, m), sliding(bad.astype(np.int64), m)
    sd = np.sqrt((m * q - s * s).astype(float))
    return np.where(b > 0, np.nan, s.astype(float)), np.where(b > 0, np.nan, sd)


def centred_stats(a: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for general doubles, in two passes over the windows, so nothing cancels."""
    if len(a) < m:
        return np.zeros(0), np.zeros(0)
    w = np.lib.stride_tricks.sliding_window_view(a, m)
    s, sd = np.empty(len(w)), np.empty(len(w))
    for at in range(0, len(w), 4096):
        part = w[at : at + 4096]
        s[at : at + 4096] = part.sum(axis=1)
        dev = part - part.mean(axis=1, keepdims=True)
        sd[at : at + 4096] = np.sqrt(m * (dev * dev).sum(axis=1))
        flat = part.max(axis=1) == part.min(axis=1)
        sd[at : at + 4096][flat] = 0.0
    return s, sd


def correlate(q: np.ndarray, m: int, s_i, d_i, s_j, d_j) -> np.ndarray:
    """Correlations of a strip, in place; constant windows by rule, missing ones as NaN."""
    q *= m
    q -= s_i[:, None] * s_j[None, :]
    scale = d_i[:, None] * d_j[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        q /= scale
    flat_i, flat_j = d_i == 0, d_j == 0
    if flat_i.any() or flat_j.any():
        q[flat_i, :] = np.where(np.isnan(d_j), np.nan, 0.0)
        q[:, flat_j] = np.where(np.isnan(d_i), np.nan, 0.0)[:, None]
        q[np.ix_(flat_i, flat_j)] = 1.0
    return q


def covariances(x: np.ndarray, y: np.ndarray, s_i: np.ndarray, s_j: np.ndarray, m: int):
    """Strips ``(first row, m * dot product - product of sums)`` of the windows of x with those of y; a strip's array is used again."""
    rows, columns = len(s_i), len(s_j)
    wx, wy = np.lib.stride_tricks.sliding_window_view(x, m)[:rows], np.lib.stride_tricks.sliding_window_view(y, m)[:columns]
    edge = m * (wx @ wy[0]) - s_i * s_j[0]
    row = m * (wy @ wx[0]) - s_i[0] * s_j
    # what a cell has more than the one before it on its diagonal: a value comes, a value goes, the sums change
    change_i = np.stack([m * x[m : m + rows - 1], -m * x[: rows - 1], -s_i[1:], s_i[:-1]], axis=1)
    change_j = np.stack([y[m : m + columns - 1], y[: columns - 1], s_j[1:], s_j[:-1]])
    out, change = np.empty((STRIP, columns)), np.empty((STRIP, columns - 1))
    for at in range(0, rows, STRIP):
        k = min(STRIP, rows - at)
        first = 1 if at == 0 else 0
        if k > first:
            np.matmul(change_i[at + first - 1 : at + k - 1], change_j, out=change[: k - first])
        for r in range(k):
            if at + r:
                np.add((row if r == 0 else out[r - 1])[:-1], change[r - first], out=out[r, 1:])
                out[r, 0] = edge[at + r]
            else:
                out[0] = row
        row = out[k - 1].copy()
        yield at, out[:k]


def normalised(a: np.ndarray, m: int, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Windows of length 1 around 0; constant and incomplete ones are all 0."""
    w = np.lib.stride_tricks.sliding_window_view(a, m)[: len(s)] - (s / m)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        w *= (np.sqrt(m) / d)[:, None]
    w[~np.isfinite(w).all(axis=1)] = 0.0
    return w


def correlations(x: np.ndarray, y: np.ndarray, m: int, exact: bool):
    """Strips ``(first row, correlations)``; constant windows by rule, pairs with an incomplete window as minus infinity."""
    if exact or m >= LONG_WINDOW:
        if not exact:
            x, y = (a - (np.nanmean(a) if np.isfinite(a).any() else 0.0) for a in (x, y))
        (s_i, d_i), (s_j, d_j) = ((stats if exact else centred_stats)(a, m) for a in (x, y))
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        sums = [sliding(a.astype(np.int64), m).astype(float) if exact else np.convolve(a, np.ones(m), "valid") for a in (x, y)]
        strips, scale = covariances(x, y, *sums, m), np.empty((STRIP, len(s_j)))
    else:
        (s_i, d_i), (s_j, d_j) = centred_stats(x, m), centred_stats(y, m)
        zi, zj = normalised(x, m, s_i, d_i), np.ascontiguousarray(normalised(y, m, s_j, d_j).T)
        strips, scale = ((at, zi[at : at + STRIP] @ zj) for at in range(0, len(s_i), STRIP)), None
    odd = [(np.flatnonzero(d == 0), np.flatnonzero(np.isnan(d))) for d in (d_i, d_j)]
    for at, r in strips:
        k = len(r)
        if scale is not None:
            np.multiply.outer(d_i[at : at + k], d_j, out=scale[:k])
            with np.errstate(divide="ignore", invalid="ignore"):
                np.divide(r, scale[:k], out=r)
        if any(len(v) for pair in odd for v in pair):
            flat_i, bad_i = ((v[(v >= at) & (v < at + k)] - at) for v in odd[0])
            flat_j, bad_j = odd[1]
            r[flat_i, :] = 0.0
            r[:, flat_j] = 0.0
            r[np.ix_(flat_i, flat_j)] = 1.0
            r[bad_i, :] = -np.inf
            r[:, bad_j] = -np.inf
        yield at, r


def by_rule(r: np.ndarray, d_i: np.ndarray, d_j: np.ndarray) -> np.ndarray:
    """Correlations with constant windows (deviation 0) set by rule and incomplete ones (NaN) to minus infinity, in place."""
    r[d_i == 0, :] = 0.0
    r[:, d_j == 0] = 0.0
    r[np.ix_(d_i == 0, d_j == 0)] = 1.0
    r[np.isnan(d_i), :] = -np.inf
    r[:, np.isnan(d_j)] = -np.inf
    return r


def pairwise(q: np.ndarray, m: int, s_i, d_i, s_j, d_j) -> np.ndarray:
    """Correlations of window pairs, place by place; minus infinity with an incomplete window."""
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (m * q - s_i * s_j) / (d_i * d_j)
    flat_i, flat_j = d_i == 0, d_j == 0
    r[flat_i | flat_j] = 0.0
    r[flat_i & flat_j] = 1.0
    r[np.isnan(d_i) | np.isnan(d_j)] = -np.inf
    return r


def on_diagonal(a: np.ndarray, diag: int, rows: int, m: int, whole: bool) -> np.ndarray:
    """Correlations of the first ``rows`` windows of ``a`` with those ``diag`` later; minus infinity with an incomplete window.

    ``whole``: whole values whose windows' sums fit 64 bits (running sums may wrap).
    """
    x, y = a[: rows + m - 1], a[diag : diag + rows + m - 1]
    if not whole:
        (s_i, d_i), (s_j, d_j) = centred_stats(x, m), centred_stats(y, m)
        r = np.empty(rows)
        for at in range(0, rows, 4096):  # so that windows are copied a few at a time
            part = slice(at, min(at + 4096, rows))
            ends = slice(at, part.stop + m - 1)
            r[part] = np.einsum("ij,ij->i", normalised(x[ends], m, s_i[part], d_i[part]), normalised(y[ends], m, s_j[part], d_j[part]))
        r[(d_i == 0) & (d_j == 0)] = 1.0
        r[np.isnan(d_i) | np.isnan(d_j)] = -np.inf
        return r
    (u, s_i, d_i), (v, s_j, d_j) = (whole_stats(z, m) for z in (x, y))
    cov = (m * sliding(u * v, m) - s_i * s_j).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = cov / (d_i * d_j)
    flat_i, flat_j = d_i == 0, d_j == 0
    r[flat_i | flat_j] = 0.0
    r[flat_i & flat_j] = 1.0
    r[np.isnan(d_i) | np.isnan(d_j)] = -np.inf
    return r


def whole_stats(a: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole values (0 where missing), and sum (an integer) and deviation of their windows (NaN where incomplete)."""
    bad = np.isnan(a)
    x = np.where(bad, 0.0, a).astype(np.int64)
    s = sliding(x, m)
    sd = np.sqrt((m * sliding(x * x, m) - s * s).astype(float))
    return x, s, np.where(sliding(bad.astype(np.int64), m) > 0, np.nan, sd)


class Best:
    """Best correlation and least neighbour of a run of positions."""

    def __init__(self, first: int, n: int):
        self.first, self.r, self.nn = first, np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        self.updates = 0  # of the best, by ``put_at``

    def put(self, at: slice, r: np.ndarray, nn: np.ndarray) -> None:
        old_r, old_n = self.r[at], self.nn[at]
        win = (r > old_r) | ((r == old_r) & (nn < old_n) & (r > -np.inf))
        old_r[win], old_n[win] = r[win], nn[win]

    def hopeful(self, first: int, r: np.ndarray) -> np.ndarray:
        """Places of ``r`` (from position ``first``) that may change the best."""
        at = first - self.first
        return np.flatnonzero((r >= self.r[at : at + len(r)]) & (r > -np.inf))

    def put_at(self, places: np.ndarray, r: np.ndarray, nn: np.ndarray) -> None:
        """The same for chosen places, each once."""
        win = (r > self.r[places]) | (nn < self.nn[places])
        self.r[places[win]], self.nn[places[win]] = r[win], nn[win]
        self.updates += int(np.count_nonzero(win))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.r > -np.inf)
        return at + self.first, self.r[at], self.nn[at]


def cells(first_i: int, rows: int, first_j: int, columns: int, band: int) -> int:
    """Pairs of a tile outside the band: those that ``tile`` evaluates."""
    return int(np.clip(first_j + columns - 1 - band - np.arange(first_i, first_i + rows), 0, columns).sum())


def tile(x: np.ndarray, y: np.ndarray, first_i: int, first_j: int, m: int, band: int, exact: bool, row_best: Best, column_best: Best, half: str = "both") -> None:
    """Fold one tile: windows of x (from position ``first_i``) against those of y, pairs with ``j - i > band`` only.

    ``half`` limits the sides that are folded: ``right`` fills later neighbours
    of rows, ``left`` earlier neighbours of columns.
    """
    rows, columns = len(x) - m + 1, len(y) - m + 1
    if rows < 1 or columns < 1 or first_j + columns - 1 - first_i <= band:
        return
    numbers = np.arange(columns) + first_j
    for at, r in correlations(x, y, m, exact):
        k = len(r)
        i0 = first_i + at
        if first_j - (i0 + k - 1) <= band:  # the strip touches the band
            r[numbers[None, :] - (np.arange(k) + i0)[:, None] <= band] = -np.inf
        if half != "left":
            top = r.max(axis=1)
            places = row_best.hopeful(i0, top)
            if len(places):
                row_best.put_at(places + i0 - row_best.first, top[places], r[places].argmax(axis=1) + first_j)
        if half != "right":
            top = r.max(axis=0)
            places = column_best.hopeful(first_j, top)
            if len(places):
                column_best.put_at(places + first_j - column_best.first, top[places], r[:, places].argmax(axis=0) + i0)
