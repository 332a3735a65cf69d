"""Changepoint searches over a matrix of n rows.

A cost says how badly one constant regime describes rows a..b. Searches return the ends
of all regimes but the last, ascending. Regimes have at least ``min_size`` rows, and
boundaries lie on multiples of ``jump``.
"""

from __future__ import annotations

import numpy as np


class Cost:
    """cost(a, b) of rows a..b (b not included); least is the smallest size it is defined for."""

    least = 1

    def __init__(self, x: np.ndarray):
        self.x = np.asarray(x, dtype=float).reshape(len(x), -1)
        self.n = len(self.x)

    def __call__(self, a: int, b: int) -> float:
        raise NotImplementedError

    def many(self, starts: np.ndarray, b: int) -> np.ndarray:
        return np.array([self(int(a), b) for a in starts])


class L2(Cost):
    """Squared deviations from the mean, from running sums."""

    def __init__(self, x):
        super().__init__(x)
        self.x = self.x - self.x.mean(axis=0)  # keeps the sums small
        self.s = np.vstack([np.zeros(self.x.shape[1]), np.cumsum(self.x, axis=0)])
        self.q = np.r_[0.0, np.cumsum((self.x**2).sum(axis=1))]

    def __call__(self, a, b):
        d = self.s[b] - self.s[a]
        return float(self.q[b] - self.q[a] - d @ d / (b - a))

    def many(self, starts, b):
        d = self.s[b] - self.s[starts]
        return self.q[b] - self.q[starts] - (d * d).sum(axis=1) / (b - starts)


class Mahalanobis(L2):
    """L2 in the metric of the inverse covariance."""

    def __init__(self, x):
        x = np.asarray(x, dtype=float).reshape(len(x), -1)
        cov = np.atleast_2d(np.cov(x.T, ddof=0)) if len(x) > 1 else np.eye(x.shape[1])
        values, vectors = np.linalg.eigh(cov)
        scale = np.where(values > 1e-12 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        super().__init__((x - x.mean(axis=0)) @ vectors * scale)


class Rank(Mahalanobis):
    """L2 of the centred average ranks, in their covariance's metric."""

    least = 2

    def __init__(self, x):
        x = np.asarray(x, dtype=float).reshape(len(x), -1)
        super().__init__(np.column_stack([average_ranks(c) for c in x.T]) - (len(x) + 1) / 2)


class L1(Cost):
    """Absolute deviations from the median."""

    least = 2

    def __call__(self, a, b):
        part = self.x[a:b]
        return float(np.abs(part - np.median(part, axis=0)).sum())


class Normal(Cost):
    """Log-likelihood of a normal regime: rows times the log-determinant of its covariance."""

    least = 2

    def __init__(self, x):
        super().__init__(x)
        self.x = self.x - self.x.mean(axis=0)
        d = self.x.shape[1]
        self.s = np.vstack([np.zeros(d), np.cumsum(self.x, axis=0)])
        self.o = np.concatenate([np.zeros((1, d, d)), np.cumsum(self.x[:, :, None] * self.x[:, None, :], axis=0)])

    def __call__(self, a, b):
        m = (self.s[b] - self.s[a]) / (b - a)
        cov = (self.o[b] - self.o[a]) / (b - a) - np.outer(m, m) + 1e-6 * np.eye(len(m))
        return float((b - a) * np.linalg.slogdet(cov)[1])


class Linear(Cost):
    """Residuals of the first column regressed on the others."""

    least = 2

    def __call__(self, a, b):
        y, x = self.x[a:b, 0], self.x[a:b, 1:]
        if not x.shape[1]:
            return float(((y - y.mean()) ** 2).sum())
        fit, *_ = np.linalg.lstsq(x, y, rcond=None)
        return float(((y - x @ fit) ** 2).sum())


class Autoregressive(Cost):
    """Residuals of each row regressed on the rows before it."""

    least = 5
    order = 4

    def __init__(self, x):
        super().__init__(x)
        p, first = self.order, self.x[:, :1]
        padded = np.vstack([np.repeat(first[:1], p, axis=0), first])
        self.lags = np.column_stack([padded[k : k + self.n] for k in range(p)] + [np.ones(self.n)])

    def __call__(self, a, b):
        y, x = self.x[a:b, 0], self.lags[a:b]
        fit, *_ = np.linalg.lstsq(x, y, rcond=None)
        return float(((y - x @ fit) ** 2).sum())


class Rbf(Cost):
    """Spread in the feature space of a Gaussian kernel whose width is the median distance; sums come from the running sums of the Gram matrix."""

    def __init__(self, x, gamma: float | None = None):
        super().__init__(x)
        sq = (self.x**2).sum(axis=1)
        # One matrix of all pairs is held, worked on in place, and half of one for the median.
        self.g = np.zeros((self.n + 1, self.n + 1))
        d = self.g[1:, 1:]
        for k in range(0, self.n, 1024):
            d[k : k + 1024] = np.maximum(sq[k : k + 1024, None] + sq[None, :] - 2 * self.x[k : k + 1024] @ self.x.T, 0)
        if gamma is None:
            middle = np.median(np.concatenate([d[k, k + 1 :] for k in range(self.n)])) if self.n > 1 else 0.0
            gamma = 1 / middle if middle > 0 else 1.0
        np.multiply(d, -gamma, out=d)
        np.clip(d, -1e2, -1e-2, out=d)
        np.exp(d, out=d)
        np.fill_diagonal(d, 1.0)
        np.cumsum(d, axis=0, out=d)
        np.cumsum(d, axis=1, out=d)

    def __call__(self, a, b):
        g = self.g
        return float((b - a) - (g[b, b] - g[a, b] - g[b, a] + g[a, a]) / (b - a))

    def many(self, starts, b):
        g = self.g
        return (b - starts) - (g[b, b] - g[starts, b] - g[b, starts] + g[starts, starts]) / (b - starts)


COSTS = {"l1": L1, "l2": L2, "rbf": Rbf, "normal": Normal, "linear": Linear, "ar": Autoregressive, "rank": Rank, "mahalanobis": Mahalanobis}


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1; equal values share their mean rank."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    return (last - (n - 1) / 2)[at]


def _grid(n: int, jump: int) -> np.ndarray:
    return np.array([*range(jump, n, jump), n])


def pelt(cost: Cost, penalty: float, min_size: int = 2, jump: int = 5) -> list[int]:
    """The regimes with the least cost plus penalty for each; starts that can never be best again are dropped."""
    return pelt_many(cost, [penalty], min_size, jump)[0]


def pelt_many(cost: Cost, penalties: list[float], min_size: int = 2, jump: int = 5) -> list[list[int]]:
    """The same for each of several penalties, in one pass: what a regime costs is worked out once for all of them."""
    n, size = cost.n, max(min_size, cost.least)
    many = len(penalties)
    if n < 2 * size:
        return [[] for _ in penalties]
    penalty = np.asarray(penalties, float)
    places = np.r_[0, _grid(n, jump)]
    best = np.full((many, len(places)), np.inf)
    before = np.full((many, len(places)), -1)
    alive = np.zeros((many, len(places)), bool)
    best[:, 0], alive[:, 0] = -penalty, True
    rows = np.arange(many)
    for j in range(1, len(places)):
        last = int(np.searchsorted(places, places[j] - size, side="right"))
        starts = np.flatnonzero(alive[:, :last].any(axis=0))
        if not len(starts):
            continue
        total = np.where(alive[:, starts], best[:, starts] + cost.many(places[starts], int(places[j])), np.inf)
        k = total.argmin(axis=1)
        least = total[rows, k]
        found = np.isfinite(least)
        best[found, j] = least[found] + penalty[found]
        before[found, j] = starts[k[found]]
        alive[:, starts] &= ~found[:, None] | (total <= best[:, j, None])
        alive[found, j] = True
    out = []
    for q in range(many):
        cuts, at = [], len(places) - 1
        while before[q, at] >= 0:
            at = int(before[q, at])
            if at:
                cuts.append(int(places[at]))
        out.append(cuts[::-1])
    return out


def dynamic(cost: Cost, n_bkps: int, min_size: int = 2, jump: int = 5) -> list[int]:
    """The best regimes with exactly n_bkps boundaries between them; fewer if so many do not fit."""
    n, size = cost.n, max(min_size, cost.least)
    grid = [0, *_grid(n, jump).tolist()]
    best = [{0: (0.0, None)}]
    for k in range(n_bkps + 1):
        row = {}
        for b in grid[1:]:
            options = [(v + cost(a, b), a) for a, (v, _) in best[-1].items() if b - a >= size]
            if options:
                row[b] = min(options)
        best.append(row)
    for k in range(n_bkps + 1, 0, -1):
        if n in best[k]:
            out, at = [], n
            for j in range(k, 0, -1):
                at = best[j][at][1]
                if at:
                    out.append(at)
            return sorted(out)
    return []


def _gain(cost: Cost, a: int, b: int, size: int, jump: int) -> tuple[float, int] | None:
    cuts = [c for c in range(jump * (a // jump + 1), b, jump) if c - a >= size and b - c >= size]
    if not cuts:
        return None
    whole = cost(a, b)
    return max((whole - cost(a, c) - cost(c, b), -c) for c in cuts)


def binary(cost: Cost, n_bkps: int | None = None, penalty: float | None = None, min_size: int = 2, jump: int = 5) -> list[int]:
    """Split where it gains most, again and again, to n_bkps boundaries or while the gain exceeds the penalty."""
    size = max(min_size, cost.least)
    open_, out = {(0, cost.n): _gain(cost, 0, cost.n, size, jump)}, []
    while open_:
        (a, b), found = max(open_.items(), key=lambda kv: (kv[1] is not None, kv[1] or (0.0, 0)))
        if found is None or (n_bkps is not None and len(out) >= n_bkps) or (n_bkps is None and found[0] <= (penalty or 0.0)):
            break
        c = -found[1]
        del open_[a, b]
        out.append(c)
        open_[a, c], open_[c, b] = _gain(cost, a, c, size, jump), _gain(cost, c, b, size, jump)
    return sorted(out)


def bottom_up(cost: Cost, n_bkps: int | None = None, penalty: float | None = None, min_size: int = 2, jump: int = 5) -> list[int]:
    """Start from the finest grid and merge the neighbours whose merge costs least."""
    size = max(min_size, cost.least)
    step = jump * -(-size // jump)
    ends = list(range(step, cost.n - size + 1, step))
    parts = list(zip([0, *ends], [*ends, cost.n]))
    loss = lambda p, q: cost(p[0], q[1]) - cost(*p) - cost(*q)
    losses = [loss(p, q) for p, q in zip(parts, parts[1:])]
    while losses:
        k = int(np.argmin(losses))
        if (n_bkps is not None and len(losses) <= n_bkps) or (n_bkps is None and losses[k] > (penalty or 0.0)):
            break
        parts[k : k + 2] = [(parts[k][0], parts[k + 1][1])]
        del losses[k]
        for j in (k - 1, k):
            if 0 <= j < len(losses):
                losses[j] = loss(parts[j], parts[j + 1])
    return [b for _, b in parts[:-1]]


def window(cost: Cost, width: int = 100, n_bkps: int | None = None, penalty: float | None = None, min_size: int = 2, jump: int = 5) -> list[int]:
    """Peaks of how much worse two half windows are together than apart, the highest first."""
    half = max(width // 2, min_size, cost.least)
    centres = [c for c in range(jump, cost.n, jump) if half <= c <= cost.n - half]
    score = {c: cost(c - half, c + half) - cost(c - half, c) - cost(c, c + half) for c in centres}
    out: list[int] = []
    for c in sorted(centres, key=lambda c: (-score[c], c)):
        if (n_bkps is not None and len(out) >= n_bkps) or (n_bkps is None and score[c] <= (penalty or 0.0)):
            break
        if all(abs(c - o) >= half for o in out):
            out.append(c)
    return sorted(out)


def detect(x: np.ndarray, method: str = "pelt", cost: str = "rbf", penalty: float | None = None, n_bkps: int | None = None, min_size: int = 2, jump: int = 5, width: int = 100) -> list[int]:
    """Breakpoints of a matrix by any search and cost; without a penalty, log(n)."""
    if len(x) < 2:
        return []
    c = COSTS[cost](x)
    pen = float(np.log(len(x))) if penalty is None else float(penalty)
    if method in ("pelt", "kernelcpd"):
        if n_bkps is not None and method == "kernelcpd":
            return dynamic(c, n_bkps, min_size, jump)
        return pelt(c, pen, min_size, jump)
    if method == "dynp":
        if n_bkps is None:
            raise ValueError("dynp needs n_bkps")
        return dynamic(c, n_bkps, min_size, jump)
    search = {"binseg": binary, "bottomup": bottom_up}.get(method)
    if search:
        return search(c, n_bkps, pen, min_size, jump)
    if method == "window":
        return window(c, width, n_bkps, pen, min_size, jump)
    raise ValueError(f"unknown method {method!r}")


def signal_matrix(x: np.ndarray, normalise: bool = True) -> np.ndarray:
    """Missing and infinite values become their column's mean; constant columns go; the rest is z-scored (population)."""
    x = np.array(x, dtype=float)
    x[~np.isfinite(x)] = np.nan
    some = ~np.isnan(x).all(axis=0) if len(x) else np.ones(x.shape[1], bool)
    x = x[:, some]
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x) if x.size else x
    sd = x.std(axis=0) if len(x) else np.zeros(0)
    x, sd = x[:, sd > 1e-12], sd[sd > 1e-12]
    return (x - x.mean(axis=0)) / sd if normalise and x.size else x


def default_penalty(x: np.ndarray, normalised: bool) -> float:
    n = max(len(x), 2)
    return float(np.log(n)) if normalised else float(np.log(n) * np.var(x) * x.shape[1])


def penalty_grid(n: int, points: int = 12) -> np.ndarray:
    """Penalties from low to high, evenly spaced in their logarithm."""
    low, high = max(0.2 * np.log(n), 0.5), 5 * np.log(n)
    return np.unique(np.geomspace(low, max(high, low), points))


def suppress_recrossings(labels: np.ndarray, min_dwell: int = 1) -> np.ndarray:
    """Fill the middle of the first run pattern A-B-A whose B is shorter than min_dwell, and start again until none is left."""
    out = np.array(labels).copy()
    while True:
        edge = np.flatnonzero(out[1:] != out[:-1]) + 1
        starts, stops = np.r_[0, edge], np.r_[edge, len(out)]
        for k in range(1, len(starts) - 1):
            if stops[k] - starts[k] < min_dwell and out[starts[k - 1]] == out[starts[k + 1]]:
                out[starts[k] : stops[k]] = out[starts[k - 1]]
                break
        else:
            return out
