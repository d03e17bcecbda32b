"""Table counts of Pitman-Yor restaurants: the conditional distribution of how many tables serve a dish.

In a restaurant of discount d and strength s, a dish with c customers that takes t tables has, given the rest (`others`
tables of other dishes, the parent's chance p of the dish for each new table), a probability in proportion to
S_d(c, t) * (s + d * others) ... (s + d * (others + t - 1)) * p ** t, where S_d are generalised Stirling numbers: all seatings
of the customers at t tables, added up. t is drawn from that at once, which leaves it as a Gibbs sampler would that moves
customers one by one without end.

Up to MOST customers S_d comes from its recursion. Beyond, it comes from the law of the number of tables in a restaurant of
strength q: S_d(c, t) is, up to a factor known in closed form, the chance that c customers take t tables there, for any q.
With the q whose mean is t that chance is the height of a normal curve, so the ratio of neighbouring terms is 1 / (q + d t),
and t is drawn from the normal curve around the place where the terms stop growing.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MOST = 1024
_CELLS = 1 << 20


@lru_cache(maxsize=4)
def log_stirling(d: float, most: int = MOST) -> np.ndarray:
    """log S_d(c, t) at [c, t] for t <= c <= most; S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf, dtype=np.float32)
    row = np.full(most + 1, -np.inf)
    row[0] = 0.0
    out[0] = row
    t = np.arange(most + 1)
    for c in range(most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(c > d * t, np.log(np.maximum(c - d * t, 1e-300)), -np.inf) + row
        row = np.logaddexp(stay, np.concatenate(([-np.inf], row[:-1])))
        out[c + 1] = row
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0."""
    small = x < 8
    y = np.where(small, x + 8, x)
    z = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    if small.any():
        shift = np.ones_like(x)
        for k in range(8):
            shift *= np.where(small, x + k, 1.0)
        out = out - np.where(small, np.log(np.maximum(shift, 1e-300)), 0.0)
    return out


def mean_tables(c: np.ndarray, q: np.ndarray, d: float) -> np.ndarray:
    """Expected number of tables of c customers at strength q > -d."""
    return (np.exp(log_gamma(q + d + c) + log_gamma(q + 1) - log_gamma(q + d) - log_gamma(q + c)) - q) / d


def _many(rng: np.random.Generator, c: np.ndarray, a: np.ndarray, p: np.ndarray, d: float) -> np.ndarray:
    """Draws for many customers; a: (s + d * others) * p."""
    low, high = np.full(len(c), -d * (1 - 1e-9)), np.maximum(a, 1e-6)
    for _ in range(60):
        q = (low + high) / 2
        over = q + d * (1 - p) * mean_tables(c, q, d) > a
        low, high = np.where(over, low, q), np.where(over, q, high)
    q = (low + high) / 2
    t, step = mean_tables(c, q, d), 1e-4 * (q + d) + 1e-9
    slope = np.maximum((mean_tables(c, q + step, d) - t) / step, 1e-9)
    spread = np.sqrt(np.maximum(q + d * t, 1e-9) / (1 / slope + d * (1 - p)))
    return np.clip(np.rint(t + spread * rng.standard_normal(len(c))), 1, c)


def weight_above(customers: np.ndarray, tables: np.ndarray, d: float, base: float) -> np.ndarray:
    """A dish's weight in the parent, before it is divided: its customers there less a discount for each table, and what the base adds."""
    return np.maximum(customers - d * np.minimum(tables, customers), 0) + base


def draw(rng: np.random.Generator, c: np.ndarray, others: np.ndarray, s: float, d: float, p: np.ndarray, above: tuple[np.ndarray, np.ndarray, float, float] | None = None) -> np.ndarray:
    """Tables of each dish with c >= 1 customers. above: the dish's customers and tables in the parent without these tables, the parent's discount and base; each new table is a customer there and makes the dish likelier."""
    out = np.ones(len(c))
    big = np.flatnonzero(c > MOST)
    if len(big):
        out[big] = _many(rng, c[big].astype(np.float64), (s + d * others[big]) * p[big], p[big], d)
    table = log_stirling(d)
    order = np.argsort(c, kind="stable")
    order = order[(c[order] > 1) & (c[order] <= MOST)]
    if not len(order):
        return out
    cut = np.flatnonzero(np.append(True, c[order][1:] != c[order][:-1])).tolist()
    for lo, hi in zip(cut, [*cut[1:], len(order)], strict=True):
        n = int(c[order[lo]])
        k = np.arange(n)
        for at in np.array_split(order[lo:hi], max(1, (hi - lo) * n // _CELLS)):
            new = np.log(s + d * (others[at][:, None] + k)) + np.log(p[at])[:, None]
            if above is not None:
                m, t0 = above[0][at][:, None], above[1][at][:, None]
                new += np.log(weight_above(m + k, t0, *above[2:]) / weight_above(m, t0, *above[2:]))
            logit = table[n, 1 : n + 1] + np.cumsum(new, axis=1)
            weight = np.cumsum(np.exp(logit - logit.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (weight < rng.random(len(at))[:, None] * weight[:, -1:]).sum(axis=1)
    return out
