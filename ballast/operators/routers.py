"""Partitioners whose choice depends on earlier choices: one small state machine for each, for batch and stream alike.

A router sees one agent's records in order of ts and keeps its state between batches, so rows are streamed and never
gathered. Feedback makes each agent sequential; agents run side by side.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.windows import checked
from ballast.operators.hotkeys import multipliers, sketch_size
from ballast.operators.static import GOLDEN
from ballast.shared import ship


def two_hashes(key: int, p: int) -> tuple[int, int]:
    x = (key + 1) * GOLDEN
    return key % p, int(np.floor(p * (x - int(x)))) % p


class Panes:
    """Load, keys and assignments of each worker over the current pane and the size / slide before it."""

    def __init__(self, p: int, size: int, slide: int, expire: bool = True):
        self.p, self.slide, self.m, self.expire = p, slide, checked(size, slide), expire
        self.pane, self.load = 0, [0] * p
        self.keys: list[Counter] = [Counter() for _ in range(p)]
        self.now: Counter = Counter()
        self.past: deque[tuple[int, Counter]] = deque()

    def advance(self, ts: int) -> None:
        pane = ts // self.slide
        if pane == self.pane or not self.expire:
            return
        if self.now:
            self.past.append((self.pane, self.now))
        self.pane, self.now = pane, Counter()
        while self.past and self.past[0][0] < pane - self.m:
            for (key, w), n in self.past.popleft()[1].items():
                self.load[w] -= n
                own = self.keys[w]
                own[key] -= n
                if not own[key]:
                    del own[key]

    def add(self, key: int, w: int) -> None:
        self.load[w] += 1
        self.keys[w][key] += 1
        self.now[key, w] += 1

    def workers_of(self, key: int) -> list[int]:
        return [w for w in range(self.p) if key in self.keys[w]]


class TwoChoices:
    """The less loaded of two hashed workers; ties to the second."""

    def __init__(self, p: int, size: int, slide: int):
        self.p, self.panes = p, Panes(p, size, slide)

    def choose(self, key: int, a: int, b: int) -> int:
        return a if self.panes.load[a] < self.panes.load[b] else b

    def route(self, key: int, ts: int) -> tuple[int, bool]:
        self.panes.advance(ts)
        w = self.choose(key, *two_hashes(key, self.p))
        self.panes.add(key, w)
        return w, True


class FewerKeys(TwoChoices):
    """Of two hashed workers that with fewer distinct keys; ties to the second."""

    def choose(self, key: int, a: int, b: int) -> int:
        return a if len(self.panes.keys[a]) < len(self.panes.keys[b]) else b


class Affine(TwoChoices):
    """A worker that has had the key, the first hashed before the second, else the less loaded. Nothing expires, so keys stick."""

    def __init__(self, p: int, size: int, slide: int):
        super().__init__(p, size, slide)
        self.panes.expire = False

    def choose(self, key: int, a: int, b: int) -> int:
        if key in self.panes.keys[a]:
            return a
        return b if key in self.panes.keys[b] else super().choose(key, a, b)


class CountMin:
    """A count-min sketch of one interval, with the cells of hotkeys.count_min."""

    def __init__(self, eps: float = 0.05, confidence: float = 0.9, seed: int = 33):
        self.width, depth = sketch_size(eps, confidence)
        self.factors = multipliers(depth, seed)
        self.cells = [[0] * self.width for _ in range(depth)]

    def add(self, key: int) -> int:
        """Count the key once more and estimate its count."""
        least = None
        for row, a in zip(self.cells, self.factors, strict=True):
            at = key * a % ((1 << 31) - 1) % self.width
            row[at] += 1
            least = row[at] if least is None else min(least, row[at])
        return least or 0


class HotTest:
    """Counts by interval. Hot: more than the last interval's total / (scale * p). roll_first: a boundary record opens the new interval.

    After an interval of at least `tracked` distinct keys the next one counts in a sketch, so memory is bounded by `tracked`
    and one interval.
    """

    def __init__(self, p: int, interval: int, scale: int = 1, roll_first: bool = True, tracked: int = 10_000):
        self.share, self.interval, self.roll_first, self.tracked = scale * p, interval, roll_first, tracked
        self.next, self.total, self.least = interval, 0, float("inf")
        self.counts: Counter = Counter()
        self.sketch: CountMin | None = None
        self.known: set[int] = set()  # distinct keys of an interval that counts in a sketch, up to `tracked`

    def _roll(self, ts: int) -> None:
        while ts >= self.next:
            self.least = self.total // self.share
            self.sketch = CountMin() if max(len(self.counts), len(self.known)) >= self.tracked else None
            self.total, self.counts, self.known = 0, Counter(), set()
            self.next += self.interval

    def _count(self, key: int) -> int:
        if self.sketch is None:
            self.counts[key] += 1
            return self.counts[key]
        if len(self.known) < self.tracked:
            self.known.add(key)
        return self.sketch.add(key)

    def __call__(self, key: int, ts: int) -> int:
        """Until when the key is hot, or 0."""
        if self.roll_first:
            self._roll(ts)
        self.total += 1
        until = self.next + self.interval if self._count(key) > self.least else 0
        if not self.roll_first:
            self._roll(ts)
        return until


class Greedy:
    """Hot keys to the worker of best affinity less relative load, cold keys by hash."""

    def __init__(self, p: int, size: int, slide: int):
        self.p, self.panes, self.test, self.until = p, Panes(p, size, slide), HotTest(p, slide, 100, False), {}

    def route(self, key: int, ts: int) -> tuple[int, bool]:
        if until := self.test(key, ts):
            self.until[key] = until
        hot = self.until.get(key, 0) > ts
        if not hot:
            self.until.pop(key, None)
        self.panes.advance(ts)
        w = key % self.p
        if hot:
            load, mean = self.panes.load, sum(self.panes.load) / self.p
            w = max(range(self.p), key=lambda i: (0.5 * (key in self.panes.keys[i]) - (0.5 * (load[i] - mean) / mean if mean else 0), -i))
        self.panes.add(key, w)
        return w, hot


class Learner:
    """What the learned routers share: hot keys with expiry, sliding state and the reward."""

    def __init__(self, p: int, size: int, slide: int, seed: int = 3):
        self.p, self.panes, self.test = p, Panes(p, size, slide), HotTest(p, slide)
        self.until: dict[int, int] = {}
        self.split_keys: set[int] = set()
        self.max_split = 2
        self.rng = np.random.default_rng(seed)

    def is_hot(self, key: int, ts: int) -> bool:
        if until := self.test(key, ts):
            self.until[key] = max(until, self.until.get(key, 0))
            return True
        if key in self.until and ts > self.until[key]:
            self.forget(key)
        return key in self.until

    def forget(self, key: int) -> None:
        del self.until[key]

    def reward(self, key: int, w: int) -> float:
        """After the record is added. Keys that reach the most workers allowed are held to them; once most are, more are allowed."""
        load, mean = self.panes.load[w], sum(self.panes.load) / self.p
        kf = len(self.panes.workers_of(key))
        if kf == self.max_split:
            self.split_keys.add(key)
        if self.until and len(self.split_keys) >= 0.7 * len(self.until) and self.max_split < 6:
            self.split_keys.clear()
            self.max_split += 1
        return -(0.5 * (load - mean) / max(load, mean) + 0.5 * kf / self.p)

    def explore(self, key: int) -> int:
        if key in self.split_keys:
            if own := self.panes.workers_of(key):
                return own[int(self.rng.integers(len(own)))]
            self.split_keys.discard(key)
        return int(self.rng.integers(self.p))


class Bandit(Learner):
    """An epsilon-greedy contextual bandit: one value for each hot key and worker."""

    def __init__(self, p: int, size: int, slide: int, seed: int = 3, rate: float = 0.1, eps: float = 0.1):
        super().__init__(p, size, slide, seed)
        self.rate, self.eps, self.q, self.counts = rate, eps, {}, Counter()

    def forget(self, key: int) -> None:
        super().forget(key)
        self.q.pop(key, None)

    def route(self, key: int, ts: int) -> tuple[int, bool]:
        hot = self.is_hot(key, ts)
        self.panes.advance(ts)
        w = key % self.p
        if hot:
            q = self.q.setdefault(key, [-2.0] * self.p)
            if self.rng.random() < self.eps:
                w = self.explore(key)
            elif max(q) > q[w]:
                w = q.index(max(q))
        self.panes.add(key, w)
        if hot:
            self.counts[key] += 1
            q[w] += self.rate * (self.reward(key, w) - q[w])
        return w, hot


ROUTERS: dict[str, Callable] = {"two_choices": TwoChoices, "cm": FewerKeys, "cam": Affine, "dagreedy": Greedy, "bandit": Bandit}


def _sarsa(p: int, size: int, slide: int):
    from ballast.operators.sarsa import SarsaRouter

    return SarsaRouter(p, size, slide)


ROUTERS["sarsa"] = _sarsa
#: Routers that send each key to one worker only.
KEY_DISJOINT = {"hashing", "cam"}


def route_rows(batches: Iterator[pa.RecordBatch], make: Callable) -> Iterator[pa.RecordBatch]:
    """Rows by (agent, ts); an agent's state lasts as long as its rows come."""
    agent, router = None, None
    for batch in batches:
        agents, ts, keys = (batch.column(i).to_pylist() for i in range(3))
        workers, hots = [], []
        for a, t, k in zip(agents, ts, keys, strict=True):
            if router is None or a != agent:
                agent, router = a, make()
            w, hot = router.route(k, t)
            workers.append(w)
            hots.append(hot)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(workers, pa.int32()), pa.array(hots, pa.bool_())], names=[*batch.schema.names, "worker", "is_hot"])


def register(name: str, make: Callable, key_disjoint: bool = False) -> None:
    """Add a partitioner under a new name: make(p, size, slide) gives an object with route(key, ts) -> (worker, is_hot). key_disjoint: it sends each key to one worker only."""
    if name in ROUTERS or name in ("hashing", "shuffling"):
        raise ValueError(f"partitioner {name} exists")
    ROUTERS[name] = make
    if key_disjoint:
        KEY_DISJOINT.add(name)


def routed(df: DataFrame, name: str, p: int, size: int, slide: int, agents: int | None = None) -> DataFrame:
    """df (agent_id, ts, key, str) with worker and is_hot. Records without a key are dropped, as they have no route.

    Agents are dealt to `agents` tasks, or to as many as a shuffle has partitions; one agent's rows stay in one task.
    """
    if name not in ROUTERS:
        raise ValueError(f"unknown partitioner {name}")
    ship(df.sparkSession)
    n = agents or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = df.select("agent_id", "ts", "key", "str").where("key is not null and ts is not null").repartition(n, "agent_id").sortWithinPartitions("agent_id", "ts")
    make = ROUTERS[name]
    return rows.mapInArrow(lambda b: route_rows(b, lambda: make(p, size, slide)), "agent_id int, ts long, key int, str string, worker int, is_hot boolean")
