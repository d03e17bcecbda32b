"""Windowed correlation clustering of strings: greedy partial clusters on each worker, then an incremental merge.

Similarities are 1 less normalised edit distance; the weight of a pair is 2 * similarity - 1. Within a group results
depend on arrival, so rows are taken by ts. Each distinct pair of strings of a group is compared once, and sums of weights
are kept up to date, not added up again for each test. They are integers: adding and taking away leaves no error.

A group is a few rows and there are very many, so a task streams through its sorted groups in Arrow batches; Spark's
grouped functions would start anew for each.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.text import similarity
from ballast.functions.windows import pane_of, sliding
from ballast.shared import ship

#: The weight of equal strings; what a sum must exceed to count as positive in the merge, and in step 1.
ONE = 1 << 60
GAIN, LEAD = ONE // 10**9, ONE // 10**12


def _distance(a: str, b: str) -> int:
    """Edit distance: a column of the table at a time, as bits of one integer that say where it goes up and down (Myers)."""
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last, out = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for y in b:
        same = places.get(y, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(across | up) & full, up & across
        out += 1 if rise & last else -1 if fall & last else 0
        rise = rise << 1 | 1
        up, down = (fall << 1 | ~(same | down | rise)) & full, rise & (same | down) & full
    return out


@lru_cache(maxsize=100_000)
def _scaled(distance: int, longest: int) -> int:
    return ONE - 2 * distance * ONE // longest


@lru_cache(maxsize=200_000)
def _unequal(a: str, b: str) -> int:
    """weight of strings a < b."""
    return _scaled(_distance(a, b), max(len(a), len(b)))


def weight(a: str, b: str) -> int:
    """2 * similarity - 1 in parts of ONE; equal strings, empty ones too, have ONE."""
    if a == b:
        return ONE
    return _unequal(a, b) if a < b else _unequal(b, a)


def similar_pairs(df: DataFrame, block: str = "block") -> DataFrame:
    """(block, key, a, b, sim) of records of one block and key with a < b by ts: an equi-join on the block."""
    x = df.select(block, "key", F.col("ts").alias("a"), F.col("str").alias("sa"))
    y = df.select(block, "key", F.col("ts").alias("b"), F.col("str").alias("sb"))
    return x.join(y, [block, "key"]).where("a < b").select(block, "key", "a", "b", F.round(similarity(F.col("sa"), F.col("sb")), 9).alias("sim"))


def greedy(strings: list[str], rule: str) -> list[int]:
    """Cluster number of each string in turn: BEST joins the most similar record's cluster, VOTE that of greatest total weight; both must be positive, ties go to the earliest."""
    clusters: list[Counter] = []
    home: dict[str, int] = {}
    out = []
    for s in strings:
        at = home.get(s, -1) if rule == "BEST" else -1  # nothing is as similar as an equal string, and its cluster is the only one to hold any
        if at < 0:
            best = 0
            for c, own in enumerate(clusters):
                score = max(weight(s, t) for t in own) if rule == "BEST" else sum(n * weight(s, t) for t, n in own.items())
                if score > best + LEAD:
                    best, at = score, c
        if at < 0:
            clusters.append(Counter())
            at = len(clusters) - 1
        clusters[at][s] += 1
        home[s] = at
        out.append(at)
    return out


def merged(strings: list[str], start: list[int]) -> list[int]:
    """Merge, split and move clusters while that raises the total weight within clusters.

    Each accepted action raises the total, so it ends. A cluster never meets itself, and neighbours are seen both ways.
    """
    names = sorted(set(strings))
    number = {s: k for k, s in enumerate(names)}
    name = [number[s] for s in strings]
    w = [[*map(_unequal, names[:a], repeat(s)), ONE] for a, s in enumerate(names)]
    for a, row in enumerate(w):
        row += [w[b][a] for b in range(a + 1, len(names))]

    own: dict[int, list[int]] = {}
    for i, c in enumerate(start):
        own.setdefault(c, []).append(i)
    fresh = max(own, default=0) + 1
    queue = deque(own)
    near: dict[int, list[int]] = {}  # of a cluster: the total weight between it and each name; lists are replaced, never changed
    for c, members in own.items():
        near[c] = w[name[members[0]]] if len(members) == 1 else [sum(x) for x in zip(*(w[name[i]] for i in members), strict=True)]
    between: dict[int, dict[int, int]] = {c: {} for c in own}  # the total weight between two clusters
    for c, members in own.items():
        mine, first, rest = between[c], name[members[0]], [name[i] for i in members[1:]]
        for other, totals in near.items():
            if other == c:
                break
            total = totals[first]
            for k in rest:
                total += totals[k]
            mine[other] = between[other][c] = total

    def move(i: int, x: int, y: int) -> None:
        k = name[i]
        for other, totals in near.items():
            if other != x:
                between[x][other] = between[other][x] = between[x][other] - totals[k]
        own[x] = [j for j in own[x] if j != i]
        near[x] = [a - b for a, b in zip(near[x], w[k], strict=True)]
        for other, totals in near.items():
            if other != y:
                between[y][other] = between[other][y] = between[y][other] + totals[k]
        own[y] = sorted([*own[y], i])
        near[y] = [a + b for a, b in zip(near[y], w[k], strict=True)]

    def try_merge(c: int) -> bool:
        mine = between[c]
        for other in own:
            if other != c and mine[other] > GAIN:
                own[c] = sorted(own[c] + own.pop(other))
                near[c] = [a + b for a, b in zip(near[c], near.pop(other), strict=True)]
                del mine[other]
                for x, total in between.pop(other).items():
                    if x != c:
                        mine[x] = between[x][c] = mine[x] + total
                        del between[x][other]
                queue.append(c)
                return True
        return False

    def try_split(c: int) -> bool:
        nonlocal fresh
        for i in own[c]:
            if ONE - near[c][name[i]] > GAIN:
                own[fresh], near[fresh], between[fresh] = [], [0] * len(names), dict.fromkeys(own, 0)
                for other in between[fresh]:
                    between[other][fresh] = 0
                move(i, c, fresh)
                for j in own[c]:
                    if len(own[c]) > 1 and near[fresh][name[j]] - near[c][name[j]] + ONE > GAIN:
                        move(j, c, fresh)
                queue.extend((c, fresh))
                fresh += 1
                return True
        return False

    def moved(i: int, x: int, y: int) -> bool:
        move(i, x, y)
        queue.extend((x, y))
        return True

    def try_move(c: int) -> bool:
        here = near[c]
        mine = [(i, name[i], here[name[i]] - ONE + GAIN) for i in own[c]] if len(own[c]) > 1 else []
        for other, theirs in own.items():
            if other != c:
                there = near[other]
                for i, k, least in mine:
                    if there[k] > least:
                        return moved(i, c, other)
                if len(theirs) > 1:
                    for i in theirs:
                        if here[name[i]] - there[name[i]] + ONE > GAIN:
                            return moved(i, other, c)
        return False

    while queue:
        c = queue.popleft()
        if c in own and not try_merge(c) and not try_split(c):
            try_move(c)
    out = [0] * len(strings)
    for members in own.values():
        for i in members:
            out[i] = members[0]
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of whole groups, with where each group starts and the last ends. Rows come sorted by their group, the first `by` columns; a group may be spread over batches."""
    held: list[pa.RecordBatch] = []
    group = None

    def started(batch: pa.RecordBatch) -> tuple[list[tuple], list[int]]:
        groups = list(zip(*(batch.column(k).to_pylist() for k in range(by)), strict=True))
        return groups, [i for i, x in enumerate(groups) if not i or x != groups[i - 1]]

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, list[int]]:
        batch = pa.concat_batches(parts)
        return batch, [*started(batch)[1], batch.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        groups, starts = started(batch)
        if held and groups[-1] == group:
            held.append(batch)
            continue
        if held or starts[-1]:
            yield joined([*held, batch.slice(0, starts[-1])])
        held, group = [batch.slice(starts[-1])], groups[-1]
    if held:
        yield joined(held)


def _first_step(rule: str):
    """Rows (ws, key, worker, ts, str, is_hot), sorted by all up to ts, as partial clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches, 3):
            ws, key, worker, ts, string, is_hot = batch.columns
            times, strings, flags = ts.to_pylist(), [s or "" for s in string.to_pylist()], is_hot.to_pylist()
            cluster, hot = [], []
            for at, end in zip(starts, starts[1:], strict=False):
                first: dict[int, int] = {}
                for i, c in enumerate(greedy(strings[at:end], rule), at):
                    cluster.append(first.setdefault(c, times[i]))
                hot += [any(flags[at:end])] * (end - at)
            yield pa.RecordBatch.from_arrays([ws, worker, key, pa.array(cluster, pa.int64()), ts, string, pa.array(hot, pa.bool_())], names=["ws", "worker", "key", "cluster", "ts", "str", "is_hot"])

    return run


def _second_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial clusters (ws, key, worker, cluster, ts, str), sorted by ws, key and ts, as clusters."""
    for batch, starts in _whole_groups(batches, 2):
        ws, key, worker, partial, ts, string = batch.columns
        times, strings, partials = ts.to_pylist(), [s or "" for s in string.to_pylist()], list(zip(worker.to_pylist(), partial.to_pylist(), strict=True))
        cluster = []
        for at, end in zip(starts, starts[1:], strict=False):
            numbers: dict[tuple, int] = {}
            start = [numbers.setdefault(x, len(numbers)) for x in partials[at:end]]
            cluster += [times[at + h] for h in merged(strings[at:end], start)]
        yield pa.RecordBatch.from_arrays([ws, key, pa.array(cluster, pa.int64()), ts, string], names=["ws", "key", "cluster", "ts", "str"])


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Groups dealt to as many tasks as shuffles have: their work isn't in proportion to their bytes, by which Spark would gather small ones in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _windowed(df: DataFrame, size: int, slide: int) -> DataFrame:
    hot = F.coalesce("is_hot", F.lit(False)) if "is_hot" in df.columns else F.lit(True)
    return sliding(df.withColumn("is_hot", hot).withColumn("pane", pane_of(F.col("ts"), slide)), size, slide).select("ws", "key", "worker", "ts", "str", "is_hot")


def _partials(rows: DataFrame, rule: str) -> DataFrame:
    if rule not in ("BEST", "VOTE"):
        raise ValueError(f"unknown rule {rule}")
    ship(rows.sparkSession)
    return rows.sortWithinPartitions("ws", "key", "worker", "ts").mapInArrow(_first_step(rule), "ws long, worker int, key int, cluster long, ts long, str string, is_hot boolean")


def _merges(partials: DataFrame) -> DataFrame:
    ship(partials.sparkSession)
    return partials.select("ws", "key", "worker", "cluster", "ts", "str").sortWithinPartitions("ws", "key", "ts").mapInArrow(_second_step, "ws long, key int, cluster long, ts long, str string")


def partial_clusters(df: DataFrame, size: int, slide: int, rule: str) -> DataFrame:
    """Step 1: df (ts, key, str, worker[, is_hot]) to (ws, worker, key, cluster, ts, str, is_hot); a cluster is named by its first ts, and a block is hot if any of its records is (all are where nothing says)."""
    return _partials(_dealt(_windowed(df, size, slide), "ws", "worker", "key"), rule)


def merge_clusters(partials: DataFrame) -> DataFrame:
    """Step 2: (ws, key, cluster, ts, str) over all workers of a window and key."""
    return _merges(_dealt(partials, "ws", "key"))


def clustered(df: DataFrame, size: int, slide: int, rule: str, key_disjoint: bool = False) -> DataFrame:
    """(ws, key, cluster, ts, str). key_disjoint: each key has one worker, so step 1 is all there is to do."""
    partials = partial_clusters(df, size, slide, rule)
    return partials.select("ws", "key", "cluster", "ts", "str") if key_disjoint else merge_clusters(partials)


def forwarded(df: DataFrame, size: int, slide: int, rule: str) -> tuple[DataFrame, DataFrame]:
    """(hot, cold) branches of (ws, key, cluster, ts, str): only keys with a hot block in the window are merged; the clusters of the others are final after step 1.

    A key has a hot block where any of its records is hot, which is known before step 1: so a branch clusters only its own
    records. Both start from the same rows, dealt by window and key, and step 2 finds them where step 1 left them.
    """
    rows = _dealt(_windowed(df, size, slide), "ws", "key").withColumn("key_is_hot", F.bool_or("is_hot").over(Window.partitionBy("ws", "key")))
    hot, cold = (_partials(rows.where(test).drop("key_is_hot"), rule) for test in ("key_is_hot", "not key_is_hot"))
    return _merges(hot), cold.select("ws", "key", "cluster", "ts", "str")
