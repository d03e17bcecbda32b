"""Deep SARSA on streams in numpy: network, sparse start, bounded step, running statistics, and the router that uses them."""

from __future__ import annotations

import numpy as np

from ballast.operators.routers import Learner

HIDDEN, RATE, GAMMA, LAMBDA, KAPPA, SPARSITY = 64, 0.01, 0.99, 0.0, 0.01, 0.6
KEY_BITS = 16


def sparse_uniform(rng: np.random.Generator, n_out: int, n_in: int, sparsity: float = SPARSITY) -> np.ndarray:
    """Uniform within 1 / sqrt(n_in), then the given share of each row's entries set to zero."""
    return sparse_start(rng, (n_out, n_in), sparsity)


def sparse_start(rng: np.random.Generator, shape: tuple[int, ...], sparsity: float = SPARSITY, normal: bool = False) -> np.ndarray:
    """Weights of a linear (two axes) or convolutional (four) layer: uniform or normal, scaled by the inputs of an output."""
    if len(shape) not in (2, 4):
        raise ValueError("weights have two or four axes")
    n_in = int(np.prod(shape[1:]))
    w = (rng.standard_normal((shape[0], n_in)) if normal else rng.uniform(-1, 1, (shape[0], n_in))) / np.sqrt(n_in)
    for row in w:
        row[rng.choice(n_in, int(np.ceil(sparsity * n_in)), replace=False)] = 0
    return w.reshape(shape)


class RunningStats:
    """Mean and sample variance by Welford's update; the variance is 1 until there are two values."""

    def __init__(self, shape: tuple[int, ...] = ()):
        self.n, self.mean, self.m2 = 0, np.zeros(shape), np.zeros(shape)

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        delta = x - self.mean
        self.mean = self.mean + delta / self.n
        self.m2 = self.m2 + delta * (x - self.mean)

    @property
    def var(self) -> np.ndarray:
        return self.m2 / (self.n - 1) if self.n > 1 else np.ones_like(self.mean)

    def normalise(self, x: np.ndarray, eps: float = 1e-8) -> np.ndarray:
        self.add(x)
        return (x - self.mean) / np.sqrt(self.var + eps)


class RewardScale:
    """Rewards over the deviation of their discounted sum."""

    def __init__(self, gamma: float = GAMMA):
        self.gamma, self.trace, self.stats = gamma, 0.0, RunningStats()

    def __call__(self, reward: float, done: bool = False, eps: float = 1e-8) -> float:
        self.trace = self.gamma * self.trace * (not done) + reward
        self.stats.add(np.float64(self.trace))
        return float(reward / np.sqrt(self.stats.var + eps))


class StepBound:
    """Eligibility traces with a step that can't overshoot. adaptive: each entry over the root of its second moment."""

    def __init__(self, shapes: list[tuple[int, ...]], rate: float = RATE, gamma: float = GAMMA, lam: float = LAMBDA, kappa: float = KAPPA, adaptive: bool = False, beta: float = 0.999, eps: float = 1e-8):
        self.rate, self.decay, self.kappa = rate, gamma * lam, kappa
        self.traces = [np.zeros(s) for s in shapes]
        self.beta, self.eps, self.n = beta, eps, 0
        self.moments = [np.zeros(s) for s in shapes] if adaptive else None

    def _directions(self, delta: float) -> list[np.ndarray]:
        if self.moments is None:
            return self.traces
        self.n += 1
        for v, e in zip(self.moments, self.traces, strict=True):
            v += (1 - self.beta) * ((delta * e) ** 2 - v)
        return [e / np.sqrt(v / (1 - self.beta**self.n) + self.eps) for v, e in zip(self.moments, self.traces, strict=True)]

    def apply(self, params: list[np.ndarray], grads: list[np.ndarray], delta: float, reset: bool = False) -> float:
        for e, g in zip(self.traces, grads, strict=True):
            e *= self.decay
            e += g
        ways = self._directions(delta)
        total = sum(float(np.abs(x).sum()) for x in ways)
        step = self.rate / max(1.0, max(abs(delta), 1.0) * total * self.kappa * self.rate)
        for w, x in zip(params, ways, strict=True):
            w += delta * step * x
        if reset:
            for e in self.traces:
                e[:] = 0
        return step


def _norm(x: np.ndarray) -> tuple[np.ndarray, float]:
    d = x - x.mean()
    s = np.sqrt((d * d).mean() + 1e-5)
    return d / s, s


class QNetwork:
    """Linear, leaky ReLU, layer norm, twice, then linear: a value for each action."""

    def __init__(self, n_in: int, n_out: int, rng: np.random.Generator):
        sizes = [(HIDDEN, n_in), (HIDDEN, HIDDEN), (n_out, HIDDEN)]
        self.params = [x for o, i in sizes for x in (sparse_uniform(rng, o, i), np.zeros(o))]

    def values(self, s: np.ndarray) -> tuple[np.ndarray, list]:
        w1, b1, w2, b2, w3, b3 = self.params
        a1 = w1 @ s + b1
        h1, s1 = _norm(np.where(a1 > 0, a1, 0.01 * a1))
        a2 = w2 @ h1 + b2
        h2, s2 = _norm(np.where(a2 > 0, a2, 0.01 * a2))
        return w3 @ h2 + b3, [s, a1, h1, s1, a2, h2, s2]

    def gradient(self, kept: list, action: int) -> list[np.ndarray]:
        """Of the action's value, by each parameter."""
        s, a1, h1, s1, a2, h2, s2 = kept
        _, _, w2, _, w3, b3 = self.params
        g3 = np.zeros_like(w3)
        g3[action] = h2
        e3 = np.zeros_like(b3)
        e3[action] = 1
        d2 = w3[action]
        d2 = (d2 - d2.mean() - h2 * (d2 * h2).mean()) / s2 * np.where(a2 > 0, 1, 0.01)
        d1 = w2.T @ d2
        d1 = (d1 - d1.mean() - h1 * (d1 * h1).mean()) / s1 * np.where(a1 > 0, 1, 0.01)
        return [np.outer(d1, s), d1, np.outer(d2, h1), d2, g3, e3]

    def save(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.params]).astype(np.float32).tobytes()

    def load(self, data: bytes) -> None:
        flat, at = np.frombuffer(data, np.float32).astype(np.float64), 0
        for p in self.params:
            p[:] = flat[at : at + p.size].reshape(p.shape)
            at += p.size


class Sarsa:
    """watch: count the updates after which the error has changed its sign, in `overshoots`."""

    def __init__(self, n_in: int, n_out: int, seed: int = 3, start: float = 0.1, end: float = 0.01, steps: int = 500_000, adaptive: bool = False, watch: bool = False):
        self.rng = np.random.default_rng(seed)
        self.net = QNetwork(n_in, n_out, self.rng)
        self.bound = StepBound([p.shape for p in self.net.params], adaptive=adaptive)
        self.watch, self.overshoots = watch, 0
        self.start, self.end, self.steps, self.t, self.n_out = start, end, steps, 0, n_out

    @property
    def eps(self) -> float:
        return max(self.end, self.start + (self.end - self.start) * self.t / self.steps)

    def act(self, s: np.ndarray, explore=None) -> int:
        self.t += 1
        if self.rng.random() < self.eps:
            return explore() if explore else int(self.rng.integers(self.n_out))
        return int(np.argmax(self.net.values(s)[0]))

    def update(self, s: np.ndarray, a: int, r: float, s2: np.ndarray, a2: int, done: bool = False) -> float:
        q, kept = self.net.values(s)
        after = 0.0 if done else GAMMA * self.net.values(s2)[0][a2]
        delta = float(r + after - q[a])
        self.bound.apply(self.net.params, self.net.gradient(kept, a), delta, done)
        if self.watch:
            after = 0.0 if done else GAMMA * self.net.values(s2)[0][a2]
            self.overshoots += delta * float(r + after - self.net.values(s)[0][a]) < 0
        return delta


class SarsaRouter(Learner):
    """Hot keys by a deep SARSA agent, cold keys by hash."""

    def __init__(self, p: int, size: int, slide: int, seed: int = 3):
        super().__init__(p, size, slide, seed)
        self.agent = Sarsa(p + 1 + KEY_BITS, p, seed)

    def state(self, key: int) -> np.ndarray:
        bits = [(key >> i) & 1 for i in range(KEY_BITS)]
        return np.array([*self.panes.load, len(self.panes.workers_of(key)) / self.p, *bits], dtype=float)

    def route(self, key: int, ts: int) -> tuple[int, bool]:
        hot = self.is_hot(key, ts)
        self.panes.advance(ts)
        if not hot:
            w = key % self.p
            self.panes.add(key, w)
            return w, False
        s = self.state(key)
        w = self.agent.act(s, lambda: self.explore(key))
        self.panes.add(key, w)
        s2 = self.state(key)
        self.agent.update(s, w, self.reward(key, w), s2, self.agent.act(s2))
        return w, True
