"""Fits, assignment and tests in numpy only."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np


def least_squares(model: Callable, x: np.ndarray, y: np.ndarray, start: list[float], low=None, high=None, steps: int = 200) -> tuple[np.ndarray, float]:
    """Bounded Levenberg-Marquardt with numerical derivatives: parameters and R2."""
    p = np.array(start, float)
    low = np.full(len(p), -np.inf) if low is None else np.array(low, float)
    high = np.full(len(p), np.inf) if high is None else np.array(high, float)
    p, damp = np.clip(p, low, high), 1e-2
    rest = y - model(x, *p)
    for _ in range(steps):
        j = np.empty((len(x), len(p)))
        for k in range(len(p)):
            h = 1e-6 * max(1e-3, abs(p[k]))
            q = p.copy()
            q[k] = p[k] + h if p[k] + h <= high[k] else p[k] - h
            j[:, k] = (model(x, *q) - model(x, *p)) / (q[k] - p[k])
        a, g = j.T @ j, j.T @ rest
        for _ in range(20):
            step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), g, rcond=None)[0]
            q = np.clip(p + step, low, high)
            new = y - model(x, *q)
            if np.isfinite(new).all() and new @ new < rest @ rest:
                break
            damp *= 4
        else:
            break
        small = np.abs(q - p).max() < 1e-10 * max(1.0, np.abs(p).max())
        p, rest, damp = q, new, max(damp / 6, 1e-12)
        if small:
            break
    total = ((y - y.mean()) ** 2).sum()
    return p, float(1 - rest @ rest / total) if total > 0 else float("nan")


def recovery(t, a, b, half):
    """Fluorescence recovery (a + b x) / (1 + x), x = t / half."""
    x = t / half
    return (a + b * x) / (1 + x)


def fit_recovery(t: np.ndarray, v: np.ndarray) -> dict:
    """a, b, half time, mobile fraction (b - a) / (1 - a) and R2 of a normalised recovery."""
    span = max(float(np.ptp(t)), 1e-9)
    p, r2 = least_squares(recovery, t, v, [float(v[0]), float(v[-1]), span / 5], [-0.5, -0.5, span * 1e-6], [2.0, 3.0, span * 100])
    return {"a": p[0], "b": p[1], "half": p[2], "mobile": (p[1] - p[0]) / (1 - p[0]) if p[0] < 1 else float("nan"), "r2": r2}


def decay(t, top, tau, floor):
    return top * np.exp(-t / tau) + floor


def fit_decay(t: np.ndarray, v: np.ndarray) -> dict:
    span = max(float(np.ptp(t)), 1e-9)
    p, r2 = least_squares(decay, t, v, [float(v[0] - v[-1]), span / 3, float(v[-1])], [-np.inf, span * 1e-4, -np.inf], [np.inf, span * 1e4, np.inf])
    return {"top": p[0], "tau": p[1], "floor": p[2], "r2": r2}


def two_decays(t, a, b, c, d, floor):
    return a * np.exp(-t / b) + c * np.exp(-t / d) + floor


def fit_two_decays(t: np.ndarray, v: np.ndarray) -> dict:
    """Two exponentials and a floor, the faster one first."""
    span = max(float(np.ptp(t)), 1e-9)
    p, r2 = least_squares(two_decays, t - t[0], v, [float(v[0]), 0.1 * span, 0.2 * float(v[0]), 0.4 * span, float(v[-1])], [0, span * 1e-6, 0, span * 1e-6, 0], [np.inf, span, np.inf, span, np.inf])
    (a, b), (c, d) = sorted(((p[0], p[1]), (p[2], p[3])), key=lambda x: x[1])
    return {"a": a, "tau_a": b, "c": c, "tau_c": d, "floor": p[4], "r2": r2}


def relaxation(t, start, tau):
    return 1 + (start - 1) * np.exp(-t / tau)


def fit_relaxation(t: np.ndarray, v: np.ndarray) -> dict:
    """Aspect ratio of a merging droplet relaxing to 1; nothing to fit unless it starts above 1."""
    if not v[0] > 1:
        return dict.fromkeys(("start", "tau", "r2"))
    span = max(float(np.ptp(t)), 1e-9)
    p, r2 = least_squares(relaxation, t - t[0], v, [float(v[0]), span / 3], [1.0, 1e-4], [20.0, span * 10])
    return {"start": p[0], "tau": p[1], "r2": r2}


def fit_confinement(t: np.ndarray, v: np.ndarray) -> dict:
    """Whether a displacement curve is better told by a confined domain (plateau L2) than by a power law: the difference of
    their corrected Akaike criteria, above 2."""
    first = max(float(v[0] / (4 * t[0])), 1e-6)
    models = (
        (lambda t, d, a, off: 4 * d * t**a + 4 * off, [first, 1.0, 0.0], [0, 0, -np.inf]),
        (lambda t, l2, d, off: l2 * (1 - np.exp(-4 * d * t / max(l2, 1e-12))) + 4 * off, [max(float(v.max()), 1e-9), first, 0.0], [0, 0, -np.inf]),
    )
    scores, found = [], []
    for model, start, low in models:
        p, _ = least_squares(model, t, v, start, low)
        rss = max(float(((v - model(t, *p)) ** 2).sum()), 1e-300)
        n = len(t)
        scores.append(n * math.log(rss / n) + 6 + (24 / (n - 4) if n > 4 else math.inf))
        found.append(p)
    gap = scores[0] - scores[1]
    return {"gap": gap, "confined": float(gap > 2), "plateau": found[1][0], "size": math.sqrt(max(found[1][0], 0.0)), "exponent": found[0][1]}


def gaussian_spot(xy, top, cy, cx, sigma, floor):
    y, x = xy
    return top * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * sigma**2)) + floor


def fit_spot(patch: np.ndarray) -> dict:
    y, x = (c.ravel().astype(float) for c in np.indices(patch.shape))
    v = patch.ravel().astype(float)
    k = int(np.argmax(v))
    xy = np.array([y, x])
    model = lambda q, *p: gaussian_spot(xy, *p)
    p, r2 = least_squares(model, y, v, [np.ptp(v), y[k], x[k], 1.5, v.min()], [0, -1, -1, 0.3, -np.inf], [np.inf, patch.shape[0], patch.shape[1], max(patch.shape), np.inf])
    return {"top": p[0], "cy": p[1], "cx": p[2], "sigma": p[3], "floor": p[4], "r2": r2}


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Optimal assignment of a rectangular cost matrix by shortest augmenting paths with potentials."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        far, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            now = c[i0 - 1] - u[i0] - v[1:]
            closer = free & (now < far[1:])
            far[1:][closer], way[1:][closer] = now[closer], j0
            j1 = int(np.argmin(np.where(free, far[1:], np.inf))) + 1
            delta = far[j1]
            u[match[used]] += delta
            v[used] -= delta
            far[1:][free] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def sparse_assignment(edges: list[list[tuple[int, float]]], columns: int, skip: float) -> list[int]:
    """Optimal assignment of rows to some of their (column, cost) edges, or to none (-1) at the cost `skip`; columns may stay
    free. Shortest augmenting paths row by row, each ending at a free column or at a row that stays without one."""
    v, match, of = [0.0] * columns, [-1] * columns, [-1] * len(edges)
    u = [0.0] * len(edges)
    for start in range(len(edges)):
        far, way, done, settled, heap = {}, {}, set(), [], []
        row, base, end, last = start, 0.0, skip, (-1, start)
        while True:
            low = base - u[row]
            if low + skip < end:
                end, last = low + skip, (-1, row)
            for j, c in edges[row]:
                d = low + c - v[j]
                if j not in done and d < end and d < far.get(j, math.inf):
                    far[j], way[j] = d, row
                    heapq.heappush(heap, (d, j))
            while heap and (heap[0][1] in done or heap[0][0] > far[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end:
                break
            base, j = heapq.heappop(heap)
            if match[j] < 0:
                end, last = base, (j, way[j])
                break
            settled.append((j, base))
            done.add(j)
            row = match[j]
        for j, d in settled:
            v[j] -= end - d
            u[match[j]] += end - d
        u[start] += end
        j, row = last
        while True:
            before = of[row]
            of[row] = j
            if j >= 0:
                match[j] = row
            if row == start:
                break
            j, row = before, way[before]
    return of


def sparse_transport(edges: list[list[tuple[int, float]]], supply: list[int], capacity: list[int], skip: float) -> list[dict[int, int]]:
    """`sparse_assignment` of classes of equal rows and columns: how many of each class of rows go to each column class; the
    others go to none, at the cost `skip` each. A path carries as many rows as its narrowest step has. edges: lists, or arrays
    (starts of each row's edges and their end, columns, costs).

    Each class first takes what is free of its cheapest column, at its price; only what is left of it looks for a path."""
    if not isinstance(edges, tuple):
        flat = [e for row in edges for e in row]
        edges = np.cumsum([0, *map(len, edges)]), np.array([j for j, _ in flat], np.int64), np.array([c for _, c in flat], float)
    starts, js, cs = edges
    n, pairs, at = len(starts) - 1, list(zip(js.tolist(), cs.tolist(), strict=True)), starts.tolist()
    edges = [pairs[a:b] for a, b in zip(at, at[1:])]
    v, u, free = [0.0] * len(capacity), [skip] * n, list(capacity)
    flow, users, rest = [{} for _ in range(n)], [{} for _ in capacity], list(supply)
    some = np.flatnonzero(np.diff(starts))
    best = np.minimum.reduceat(cs, starts[some]) if len(some) else cs
    for row, low in zip(some.tolist(), best.tolist(), strict=True):
        if low < skip:
            u[row] = low
            j = next(j for j, c in edges[row] if c == low)
            many = min(rest[row], free[j])
            if many:
                flow[row][j], users[j][row] = many, None
                rest[row] -= many
                free[j] -= many
    for start in range(n):
        left = rest[start] if u[start] < skip else 0
        while left:
            far, way, done, heap = {}, {}, {}, []
            reached, via, todo, end, last = {start: 0.0}, {}, [start], math.inf, (-1, start)
            while True:
                for row in todo:
                    low = reached[row] - u[row]
                    if low + skip < end:
                        end, last = low + skip, (-1, row)
                    for j, c in edges[row]:
                        d = low + c - v[j]
                        if j not in done and d < end and d < far.get(j, math.inf):
                            far[j], way[j] = d, row
                            heapq.heappush(heap, (d, j))
                while heap and (heap[0][1] in done or heap[0][0] > far[heap[0][1]]):
                    heapq.heappop(heap)
                if not heap or heap[0][0] >= end:
                    break
                base, j = heapq.heappop(heap)
                if free[j]:
                    end, last = base, (j, way[j])
                    break
                done[j] = base
                todo = [row for row in users[j] if row not in reached]
                for row in todo:
                    reached[row], via[row] = base, j
            for j, d in done.items():
                v[j] -= end - d
            for row, d in reached.items():
                u[row] += end - d
            (j, row), many = last, left
            if j >= 0:
                many = min(many, free[j])
            while row != start:
                many = min(many, flow[row][via[row]])
                row = way[via[row]]
            j, row = last
            if j >= 0:
                free[j] -= many
            while True:
                if j >= 0:
                    flow[row][j] = flow[row].get(j, 0) + many
                    users[j][row] = None
                if row == start:
                    break
                j = via[row]
                flow[row][j] -= many
                if not flow[row][j]:
                    del flow[row][j], users[j][row]
                row = way[j]
            left -= many
    return flow


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def incomplete_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 1000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-15:
                break
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for k in range(1, 1000):
        n = -k * (k - a)
        b += 2
        d = 1 / (n * d + b or 1e-300)
        c = b + n / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def t_p(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_p(x: float, df: float) -> float:
    return 1 - incomplete_gamma(df / 2, x / 2)


def pearson_p(r: float, n: int) -> float:
    return 0.0 if abs(r) >= 1 else t_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def ranks(v: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def compare(groups: list[np.ndarray], parametric: bool = False) -> tuple[str, float, float]:
    """Test, statistic and p of replicate values: Welch or Mann-Whitney for two groups, one-way or rank variance for more.
    Refused below two replicates a group."""
    if len(groups) < 2 or min(map(len, groups)) < 2:
        raise ValueError("at least two groups of two replicates each are needed")
    if len(groups) == 2:
        a, b = groups
        if parametric:
            va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
            if va + vb == 0:
                return "welch", float("nan"), float("nan")
            t = (a.mean() - b.mean()) / math.sqrt(va + vb)
            return "welch", float(t), t_p(t, (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))
        both = np.r_[a, b]
        r, n = ranks(both), len(both)
        u = r[: len(a)].sum() - len(a) * (len(a) + 1) / 2
        ties = np.unique(both, return_counts=True)[1]
        var = len(a) * len(b) / 12 * (n + 1 - (ties**3 - ties).sum() / (n * (n - 1)))
        z = max(0.0, abs(u - len(a) * len(b) / 2) - 0.5) / math.sqrt(var) if var > 0 else 0.0
        return "mann-whitney", float(u), math.erfc(z / math.sqrt(2))
    all_ = np.concatenate(groups)
    n, k = len(all_), len(groups)
    if parametric:
        between = sum(len(g) * (g.mean() - all_.mean()) ** 2 for g in groups) / (k - 1)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (n - k)
        f = between / within if within > 0 else float("inf")
        return "anova", float(f), f_p(f, k - 1, n - k)
    r, at, h = ranks(all_), 0, 0.0
    for g in groups:
        h += r[at : at + len(g)].sum() ** 2 / len(g)
        at += len(g)
    ties = np.unique(all_, return_counts=True)[1]
    h = (12 / (n * (n + 1)) * h - 3 * (n + 1)) / (1 - (ties**3 - ties).sum() / (n**3 - n))
    return "kruskal", float(h), chi2_p(h, k - 1)
