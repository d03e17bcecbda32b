import random
import time

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ballast.functions import text, windows
from ballast.operators import clustering, cooperative, hotkeys, routers, sarsa, static, stats, wordcount
from ballast.plans.catalogue import assigned
from ballast.sources import records
from ballast.streaming import jobs


def test_split_keeps_inner_and_drops_trailing_empties(spark):
    df = spark.createDataFrame([("a b  a ",), ("",), ("   ",), (" a",)], "s string")
    assert [r[0] for r in df.select(text.split_words(F.col("s"))).collect()] == [["a", "b", "", "a"], [""], [], ["", "a"]]


def test_similarity_of_empty_strings_is_one(spark):
    df = spark.createDataFrame([("", "", 1.0), ("abcd", "abce", 0.75), ("ab", "", 0.0)], "a string, b string, s double")
    assert all(r[0] == r[1] for r in df.select(text.similarity(F.col("a"), F.col("b")), "s").collect())


def test_windows(spark):
    df = spark.range(10).select(windows.pane_of(F.col("id"), 2).alias("pane"))
    got = {r["ws"]: r["count"] for r in windows.sliding(df, 4, 2).groupBy("ws").count().collect()}
    assert got == {-2: 2, 0: 4, 2: 4, 4: 4, 6: 4, 8: 2}
    with pytest.raises(ValueError):
        windows.checked(3, 2)


def test_read_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text("x,foo\n5\n5,\n5,a b,c\n-3,a\n7,b  \n")
    got = [tuple(r) for r in records.read_lines(spark, str(tmp_path / "x.csv")).orderBy("ts").collect()]
    assert got == [(0, 0, 5, "a b"), (0, 1, -3, "a"), (0, 2, 7, "b  ")]


def test_static_choices(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (-3,)], "key int")
    assert [r[0] for r in df.select(static.second_hash(F.col("key"), 4)).collect()][:3] == [2, 0, 3]
    assert [r[0] for r in df.select(static.hashing(F.col("key"), 4)).collect()] == [0, 1, 2, 1]


def test_alternating_sources_end_with_the_shorter(spark):
    one, two = (spark.createDataFrame([(t, 1, s) for t in range(n)], "ts long, key int, str string") for n, s in ((3, "a"), (2, "b")))
    got = [(r["ts"], r["str"]) for r in records.two_sources(one, two, True, 3, 2).orderBy("ts").collect()]
    assert got == [(0, "a"), (1, "b"), (2, "a"), (3, "b")]


@pytest.mark.parametrize("seed", range(2))
def test_hot_status_equals_sequential_model(spark, seed):
    rng = random.Random(seed)
    keys = [rng.choice([0, 0, 0, 1, rng.randrange(50)]) for _ in range(600)]
    test, until, want = routers.HotTest(4, 50), {}, []
    for t, k in enumerate(keys):
        if u := test(k, t):
            until[k] = u
        elif k in until and t > until[k]:
            del until[k]
        want.append(k in until)
    df = spark.createDataFrame(list(enumerate(keys)), "ts long, key int")
    assert [r["hot"] for r in hotkeys.hot_status(df, 50, 4).orderBy("ts").collect()] == want


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-20, 20), max_size=300), st.sampled_from(sorted(routers.ROUTERS)))
def test_routers_stay_in_range_and_loads_add_up(keys, name):
    r = routers.ROUTERS[name](4, 40, 20)
    for t, k in enumerate(keys):
        w, _ = r.route(k, t)
        assert 0 <= w < 4
    if keys and name != "cam":
        pane = (len(keys) - 1) // 20
        assert sum(r.panes.load) == sum(1 for t in range(len(keys)) if pane - 2 <= t // 20 <= pane)


def test_routed_equals_the_model(spark):
    rows = [(0, t, (t * 7919) % 13 if t % 3 else 0, "a") for t in range(500)]
    df = spark.createDataFrame(rows, "agent_id int, ts long, key int, str string")
    for name in ("two_choices", "cm", "cam", "dagreedy", "bandit"):
        model = routers.ROUTERS[name](4, 80, 40)
        want = [model.route(k, t) for _, t, k, _ in rows]
        assert [(r["worker"], r["is_hot"]) for r in routers.routed(df, name, 4, 80, 40).orderBy("ts").collect()] == want
    with pytest.raises(ValueError):
        routers.routed(df, "HASHING", 4, 80, 40)


def sequential_dag(keys, p, interval, scale):
    """Hot keys by interval with plain counters: the test comes first, and the record that reaches a boundary still belongs to the old interval."""
    iv, nxt, total, least, counts, hot = 0, interval, 0, None, {}, set()
    for t, k in keys:
        total += 1
        counts[k] = counts.get(k, 0) + 1
        if least is not None and counts[k] > least:
            hot.add((iv, k))
        if t >= nxt:
            iv, nxt, least, total, counts = iv + 1, nxt + interval, total // (scale * p), 0, {}
    return hot


def test_dag_hot_keys_equal_a_sequential_model(spark):
    cases = [[(t, 777 if t in (600, 700, 1000) else t + 1000) for t in range(1400)]]
    rng = random.Random(8)
    for _ in range(2):
        ts = [t for t in range(400) if t % 50 or rng.random() < 0.5]
        cases.append([(t, rng.choice([0, 0, 1, rng.randrange(30)])) for t in ts])
    for keys, p, interval, scale in zip(cases, (2, 3, 2), (500, 50, 50), (100, 1, 2), strict=True):
        df = spark.createDataFrame(keys, "ts long, key int")
        got = {(r["iv"], r["key"]) for r in hotkeys.hot_keys(df, interval, p, scale, roll_first=False).collect()}
        assert got == sequential_dag(keys, p, interval, scale)


class Plain:
    """What a learned router must do, from records alone: nothing is kept but the list of what was routed where."""

    def __init__(self, p, size, slide, seed=3):
        import numpy as np

        self.p, self.size, self.slide, self.rng = p, size, slide, np.random.default_rng(seed)
        self.seen, self.until, self.q, self.full, self.allowed = [], {}, {}, set(), 2

    def recent(self, ts):
        return [(k, w) for t, k, w in self.seen if t // self.slide >= ts // self.slide - self.size // self.slide]

    def hot(self, key, ts):
        iv = ts // self.slide
        before = sum(1 for t, _, _ in self.seen if t // self.slide == iv - 1)
        count = 1 + sum(1 for t, k, _ in self.seen if t // self.slide == iv and k == key)
        if iv and count > before // self.p:
            self.until[key] = (iv + 2) * self.slide
        elif key in self.until and ts > self.until[key]:
            del self.until[key]
            self.q.pop(key, None)
        return key in self.until

    def reward(self, key, w, ts):
        rows = self.recent(ts)
        load, mean = sum(1 for _, x in rows if x == w), len(rows) / self.p
        kf = len({x for k, x in rows if k == key})
        if kf == self.allowed:
            self.full.add(key)
        if self.until and len(self.full) >= 0.7 * len(self.until) and self.allowed < 6:
            self.full, self.allowed = set(), self.allowed + 1
        return -(0.5 * (load - mean) / max(load, mean) + 0.5 * kf / self.p)

    def explore(self, key, ts):
        if key in self.full:
            own = sorted({x for k, x in self.recent(ts) if k == key})
            if own:
                return own[int(self.rng.integers(len(own)))]
            self.full.discard(key)
        return int(self.rng.integers(self.p))

    def bandit(self, key, ts):
        hot, w = self.hot(key, ts), key % self.p
        if hot:
            q = self.q.setdefault(key, [-2.0] * self.p)
            if self.rng.random() < 0.1:
                w = self.explore(key, ts)
            else:
                for i, x in enumerate(q):
                    w = i if x > q[w] else w
        self.seen.append((ts, key, w))
        if hot:
            q[w] += 0.1 * (self.reward(key, w, ts) - q[w])
        return w, hot

    def sarsa(self, key, ts, agent):
        import numpy as np

        hot, w = self.hot(key, ts), key % self.p
        if not hot:
            self.seen.append((ts, key, w))
            return w, False

        def state():
            rows = self.recent(ts)
            return np.array([*(sum(1 for _, x in rows if x == i) for i in range(self.p)), len({x for k, x in rows if k == key}) / self.p, *(key >> i & 1 for i in range(16))], dtype=float)

        before = state()
        w = agent.act(before, lambda: self.explore(key, ts))
        self.seen.append((ts, key, w))
        after = state()
        agent.update(before, w, self.reward(key, w, ts), after, agent.act(after))
        return w, True


def routed_rows(n, agents=1):
    return [(t % agents, t, (t * 7919) % 13 if t % 3 else (t // 97) % 3, "a") for t in range(n)]


def test_bandit_equals_plain_rules(spark):
    rows = routed_rows(900, 3)
    df = spark.createDataFrame(rows, "agent_id int, ts long, key int, str string")
    want, models = {}, [Plain(4, 120, 30) for _ in range(3)]
    for a, t, k, _ in rows:
        want[t] = models[a].bandit(k, t)
    got = {r["ts"]: (r["worker"], r["is_hot"]) for r in routers.routed(df, "bandit", 4, 120, 30).collect()}
    assert got == want and any(h for _, h in want.values()) and {m.allowed for m in models} != {2}


def test_sarsa_equals_plain_rules(spark):
    rows = routed_rows(300)
    df = spark.createDataFrame(rows, "agent_id int, ts long, key int, str string")
    model, agent = Plain(4, 120, 30), sarsa.Sarsa(4 + 1 + 16, 4, 3)
    want = [model.sarsa(k, t, agent) for _, t, k, _ in rows]
    assert [(r["worker"], r["is_hot"]) for r in routers.routed(df, "sarsa", 4, 120, 30).orderBy("ts").collect()] == want


class PlainAgent(Plain):
    """A cooperating agent within a round: hot by its own count in the round against the last round's total over all agents."""

    first, sync, least = 0, 0, float("inf")

    def hot(self, key, ts):
        if 1 + sum(1 for t, k, _ in self.seen if t >= self.first and k == key) > self.least:
            self.until[key] = max(self.first + 2 * self.sync, self.until.get(key, 0))
        elif key in self.until and ts > self.until[key]:
            del self.until[key]
            self.q.pop(key, None)
        return key in self.until


@pytest.mark.parametrize("syncs", [[30], [150], [60, 120, 30, 60]])
def test_cooperation_equals_plain_rules(spark, syncs):
    p, slide, rows = 4, 30, routed_rows(450, 2)
    df = spark.createDataFrame(rows, "agent_id int, ts long, key int, str string")
    agents, want, left, first, lengths = [PlainAgent(p, 120, slide, 3 + a) for a in range(2)], {}, [], 0, []
    while first < 450:
        left = left or list(syncs)
        sync = left.pop(0)
        lengths.append(sync)
        counts, every = [{}, {}], {}
        for x in agents:
            x.first, x.sync = first, sync
        for a, t, k, _ in rows[first : first + sync]:
            w, hot = agents[a].bandit(k, t)
            want[t] = (w, hot or sync > slide)
            every[k] = every.get(k, 0) + 1
            if hot:
                counts[a][k] = counts[a].get(k, 0) + 1
        total, table = sum(every.values()), {}
        for k in {k for a in range(2) for k in counts[a] if k in agents[a].q}:
            own = [a for a in range(2) if k in counts[a] and k in agents[a].q]
            n = sum(counts[a][k] for a in own)
            table[k] = ([sum(counts[a][k] * agents[a].q[k][i] for a in own) / n for i in range(p)], max(agents[a].until[k] for a in own))
        for k, n in every.items():
            if n > total // p:
                table.setdefault(k, ([-2.0] * p, first + 2 * sync))
        for x in agents:
            x.q, x.until, x.least = {k: list(q) for k, (q, _) in table.items()}, {k: u for k, (_, u) in table.items()}, total // p
        first += sync
    rest = iter([*lengths[1:], 30])
    got = cooperative.routed_cooperatively(df, p, 120, slide, 2, lengths[0], lambda *_: next(rest)).collect()
    assert {r["ts"]: (r["worker"], r["is_hot"]) for r in got} == want and len(got) == 450


def test_pace():
    pace = cooperative.measured_pace(50)
    assert [pace(200, *x) for x in ((1, 2), (3, 1), (2, 1), (1, 1))] == [400, 100, 200, 200] and pace(60, 3, 1) == 50


def test_cooperation_of_no_records(spark):
    df = spark.createDataFrame([(0, None, 1, "a"), (0, 1, None, "b")], "agent_id int, ts long, key int, str string")
    assert cooperative.routed_cooperatively(df, 4, 40, 20, 2).count() == 0


def test_agents_route_in_tasks_of_their_own(spark):
    df = spark.createDataFrame(routed_rows(400, 4), "agent_id int, ts long, key int, str string")
    out = routers.routed(df, "two_choices", 4, 40, 20).withColumn("part", F.spark_partition_id())
    assert out.groupBy("agent_id").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    assert out.select("part").distinct().count() > 1


def test_a_partitioner_can_be_registered(spark):
    class Last:
        def __init__(self, p, size, slide):
            self.p = p

        def route(self, key, ts):
            return self.p - 1, False

    routers.register("last", Last, True)
    try:
        df = spark.createDataFrame(routed_rows(20), "agent_id int, ts long, key int, str string")
        assert {(r["worker"], r["is_hot"]) for r in assigned(df, "last", 4, 40, 20).collect()} == {(3, False)}
        with pytest.raises(ValueError):
            routers.register("hashing", Last)
    finally:
        del routers.ROUTERS["last"]
        routers.KEY_DISJOINT.discard("last")


def edit(a, b):
    if not a or not b:
        return len(a) + len(b)
    return min(edit(a[1:], b) + 1, edit(a, b[1:]) + 1, edit(a[1:], b[1:]) + (a[0] != b[0]))


def plain_weight(a, b):
    return 1.0 if a == b else 1 - 2 * edit(a, b) / max(len(a), len(b))


names = st.lists(st.text("abc", max_size=4), min_size=1, max_size=7)


@settings(max_examples=40, deadline=None)
@given(names)
def test_best_and_vote_equal_plain_rules(strings):
    for rule, score in (("BEST", max), ("VOTE", sum)):
        groups, want = [], []
        for i, s in enumerate(strings):
            gains = [score(plain_weight(s, strings[j]) for j in g) for g in groups]
            top = max(gains, default=0)
            at = next((k for k, x in enumerate(gains) if x > 1e-12 and x > top - 1e-12), len(groups))
            groups += [[]] * (at == len(groups))
            groups[at] = [*groups[at], i]
            want.append(at)
        assert clustering.greedy(strings, rule) == want


@settings(max_examples=40, deadline=None)
@given(names, st.randoms(use_true_random=False))
def test_merge_ends_where_nothing_gains(strings, rng):
    start = [rng.randrange(3) for _ in strings]
    end = clustering.merged(strings, start)
    n = len(strings)
    w = [[plain_weight(a, b) for b in strings] for a in strings]
    total = lambda c: sum(w[i][j] for i in range(n) for j in range(i) if c[i] == c[j])
    assert total(end) >= total(start) - 1e-9 and all(end[c] == c for c in end)
    for a in set(end):
        for b in set(end) - {a}:  # no merge
            assert total([a if c == b else c for c in end]) <= total(end) + 1e-6
    for i in range(n):  # no record leaves for another cluster or for one of its own
        for b in (set(end) | {n + 1}) - {end[i]}:
            if b == n + 1 or end.count(end[i]) > 1:
                assert total([b if j == i else c for j, c in enumerate(end)]) <= total(end) + 1e-6


def test_bandit_balances_better_than_hashing(spark):
    df = records.events(spark, "/root/testdata/sf0.01")
    skew = {n: stats.imbalance(assigned(df, n), 2000, 500, 8).agg(F.avg("imbalance")).first()[0] for n in ("hashing", "bandit")}
    assert skew["bandit"] < skew["hashing"]


def test_sketch_is_never_under(spark):
    df = spark.createDataFrame([(k % 97,) for k in range(3000)], "key int")
    true = {r["key"]: r["count"] for r in df.groupBy("key").count().collect()}
    assert hotkeys.sketch_size(0.05, 0.9) == (40, 4)
    assert all(r["estimate"] >= true[r["key"]] for r in hotkeys.estimates(df, hotkeys.count_min(df)).collect())


def test_clusters():
    for rule in ("BEST", "VOTE"):
        assert clustering.greedy(["abcd", "abce", "wxyz"], rule) == [0, 0, 1]
    assert len(set(clustering.merged(["a", "a", "a"], [0, 0, 1]))) == 1
    assert len(set(clustering.merged(["abcd", "wxyz"], [0, 0]))) == 2


def test_merge_keeps_every_record(spark):
    df = spark.createDataFrame([(t, t % 2, f"name{t % 5}", t % 3) for t in range(30)], "ts long, key int, str string, worker int")
    part = clustering.partial_clusters(df, 40, 20, "BEST")
    got = clustering.merge_clusters(part).groupBy("ws").count().collect()
    assert {r["ws"]: r["count"] for r in got} == {-20: 20, 0: 30, 20: 10}


def test_gradient_of_the_network():
    import numpy as np

    net = sarsa.QNetwork(5, 3, np.random.default_rng(1))
    s = np.arange(5.0)
    q, kept = net.values(s)
    grads = net.gradient(kept, 1)
    for p, g in zip(net.params, grads, strict=True):
        i = tuple(x // 2 for x in p.shape)
        p[i] += 1e-6
        assert abs((net.values(s)[0][1] - q[1]) / 1e-6 - g[i]) < 1e-3
        p[i] -= 1e-6
    other = sarsa.QNetwork(5, 3, np.random.default_rng(2))
    other.load(net.save())
    assert np.allclose(other.values(s)[0], q, atol=1e-4)


def test_running_stats():
    import numpy as np

    x, s = np.random.default_rng(0).normal(size=50), sarsa.RunningStats()
    for v in x:
        s.add(v)
    assert np.isclose(s.mean, x.mean()) and np.isclose(s.var, x.var(ddof=1))


@pytest.mark.parametrize("two_step", [False, True])
def test_streamed_word_count_equals_batch(spark, tmp_path, two_step):
    rows = [(0, t, t % 3, f"w{t % 4} x") for t in range(60)] + [(0, 100_000, 9, "end")]
    spark.createDataFrame(rows, "agent_id int, ts long, key int, str string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("agent_id int, ts long, key int, str string").parquet(str(tmp_path / "in"))
    routed = jobs.routed_stream(stream, "two_choices", 4, 20, 10) if not two_step else stream.withColumn("worker", static.hashing(F.col("key"), 4))
    counts = jobs.two_step_stream(routed, 20, 10) if two_step else jobs.word_count_stream(routed, 20, 10)
    name = f"counts{two_step}"
    counts.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = spark.createDataFrame(rows[:-1], "agent_id int, ts long, key int, str string").withColumn("worker", F.lit(0))
    want = {tuple(r) for r in wordcount.word_count(batch, 20, 10).select("ws", "key", "word", "cnt").collect()}
    got = {tuple(r) for r in spark.table(name).where("key <> 9").collect()}
    assert got and got <= want and {x for x in want if x[0] <= 30} <= got


def test_empty_input(spark):
    df = spark.createDataFrame([], "agent_id int, ts long, key int, str string")
    assert routers.routed(df, "bandit", 4, 20, 10).count() == 0
    assert stats.load(df.withColumn("worker", F.lit(0)), 20, 10).count() == 0
    assert isinstance(hotkeys.count_min(df).toPandas(), pd.DataFrame)


def test_hot_test_counts_in_a_sketch_after_many_keys(spark):
    rng = random.Random(4)
    keys = [rng.choice([0, 1, 2, rng.randrange(300)]) for _ in range(400)]
    test, hot = routers.HotTest(4, 100, tracked=20), set()
    for t, k in enumerate(keys):
        if test(k, t):
            hot.add((t // 100, k))
        assert len(test.known) <= 20
    df = spark.createDataFrame(list(enumerate(keys)), "ts long, key int")
    assert hot == {(r["iv"], r["key"]) for r in hotkeys.hot_keys_sketched(df, 100, 4, 20).collect()}


def test_read_lines_of_a_folder_in_order_of_names(spark, tmp_path):
    (tmp_path / "b.csv").write_text("3,c\n")
    (tmp_path / "a.csv").write_text("1,a\nx,\n2,b\n" * 50)
    got = [tuple(r)[1:] for r in records.read_lines(spark, str(tmp_path), 0, 1, 2).orderBy("ts").collect()]
    assert got == [(2 * i + 1, i % 2 + 1, "ab"[i % 2]) for i in range(100)] + [(201, 3, "c")]


def test_circular_stream(spark, tmp_path):
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 7).load()
    df = spark.createDataFrame([(0, 5, "a"), (1, 6, "b"), (2, 7, "c")], "ts long, key int, str string")
    q = records.circular_stream(ticks, df, 3).writeStream.format("memory").queryName("circle").option("checkpointLocation", str(tmp_path)).start()
    while spark.table("circle").count() < 14:
        q.processAllAvailable() if q.exception() else q.awaitTermination(1)
    q.stop()
    got = [tuple(r) for r in spark.table("circle").orderBy("ts").limit(14).collect()]
    assert got == [(0, t, 5 + t % 3, "abc"[t % 3]) for t in range(14)]


def test_cooperation_goes_on_after_a_restart(spark, tmp_path):
    batches = [spark.createDataFrame([(i % 2, t, 0 if t % 2 else t % 9, "a") for i, t in enumerate(range(lo, lo + 200))], "agent_id int, ts long, key int, str string") for lo in (0, 200)]
    one, two = (jobs.Cooperation(str(tmp_path / name), 4, 100, 50, 2) for name in "ab")
    one(batches[0], 0)
    two(batches[0], 0)
    one(batches[1], 1)
    again = jobs.Cooperation(str(tmp_path / "b"), 4, 100, 50, 2)
    again(batches[1], 1)
    again(batches[1], 1)
    rows = [sorted(map(tuple, spark.read.parquet(str(tmp_path / name / "routed" / "batch=1")).collect())) for name in "ab"]
    assert rows[0] == rows[1] and len(rows[0]) == 200 and 0 in one.known.table and (one.known.table, one.known.total) == (again.known.table, again.known.total)


@pytest.mark.parametrize("adaptive", [False, True])
def test_sarsa_learns_and_a_bound_of_two_never_overshoots(adaptive):
    s = sarsa.np.array([1.0, 0.0, -1.0, 0.5])
    for kappa in (sarsa.KAPPA, 2.0):
        agent = sarsa.Sarsa(4, 2, adaptive=adaptive, watch=True)
        agent.bound.kappa = kappa
        errors = [abs(agent.update(s, 0, 1.0, s, 0, True)) for _ in range(300)]
        assert errors[-1] < errors[0] / 4
        if kappa == 2.0:
            assert agent.overshoots == 0


def test_sparse_start():
    rng = sarsa.np.random.default_rng(1)
    for shape, normal in (((3, 10), True), ((3, 2, 5, 1), False)):
        w = sarsa.sparse_start(rng, shape, 0.6, normal)
        assert w.shape == shape and [(row == 0).sum() for row in w.reshape(3, -1)] == [6] * 3
    with pytest.raises(ValueError):
        sarsa.sparse_start(rng, (3,))


def test_metrics_of_a_stream_and_of_a_batch(spark, tmp_path):
    path = jobs.metrics_path(str(tmp_path / "output"), "bandit")
    assert path.split("/")[-1].startswith("performance_metrics_bandit_")
    sink = jobs.ProgressSink(spark, path)
    spark.streams.addListener(sink)
    spark.range(30).write.parquet(str(tmp_path / "in"))
    try:
        spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            lines = open(path).read().split()
            if len(lines) > 1:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(sink)
    assert lines[0] == "timestamp,heapMemoryUsed,nonHeapMemoryUsed,recordsProcessed,throughput"
    assert any(int(x.split(",")[3]) == 30 and int(x.split(",")[2]) > 0 for x in lines[1:])
    rows, seen = jobs.counted(spark.range(17))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"recordsProcessed": 17}


def test_cold_blocks_skip_the_merge(spark):
    rows = [(t, t % 2, f"name{t % 5}", t % 3, t % 2 == 1 and t > 20) for t in range(30)]
    df = spark.createDataFrame(rows, "ts long, key int, str string, worker int, is_hot boolean")
    hot, cold = clustering.forwarded(df, 40, 20, "BEST")
    every = lambda x: sorted(map(tuple, x.collect()))
    partials = clustering.partial_clusters(df, 40, 20, "BEST")
    assert every(cold) == every(partials.where("key = 0 or ws = -20").select("ws", "key", "cluster", "ts", "str"))
    assert every(hot) == every(clustering.merge_clusters(partials.where("key = 1 and ws > -20")))
    one = df.withColumn("worker", F.lit(0))
    assert every(clustering.clustered(one, 40, 20, "BEST", True)) == every(clustering.partial_clusters(one, 40, 20, "BEST").select("ws", "key", "cluster", "ts", "str"))
    assert every(clustering.clustered(df, 40, 20, "BEST")) == every(clustering.merge_clusters(partials))


def test_merge_compares_each_pair_of_strings_once(monkeypatch):
    asked = []
    for f in ("weight", "_unequal"):
        plain = getattr(clustering, f, None)
        monkeypatch.setattr(clustering, f, lambda a, b, plain=plain: asked.append((a, b)) or plain(a, b), raising=False)
    strings = [f"{c}{n}" for c in ("bolt", "large ring", "hot plate") for n in range(10)] * 2
    end = clustering.merged(strings, list(range(60)))
    assert len(set(end)) == 3 and 0 < len(asked) <= 30 * 29 // 2


def test_groups_may_be_spread_over_batches(spark):
    rows = [(t, t // 40, f"name{t % 7}{'x' * (t % 3)}", t % 2, t // 40 % 2 == 0) for t in range(120)]
    df = spark.createDataFrame(rows, "ts long, key int, str string, worker int, is_hot boolean")
    every = lambda x: sorted(map(tuple, x.collect()))
    run = lambda: [every(x) for x in (*clustering.forwarded(df, 80, 40, "BEST"), clustering.partial_clusters(df, 80, 40, "VOTE"))]
    whole = run()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert run() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [len(x) for x in whole] == [160, 80, 240]


def test_forwarding_clusters_each_record_once_and_on_all_cores(spark):
    rows = [(t, t % 50, f"name{t % 64}", t % 8, t % 50 < 40) for t in range(400)]
    df = spark.createDataFrame(rows, "ts long, key int, str string, worker int, is_hot boolean")
    hot, cold = clustering.forwarded(df, 80, 40, "BEST")
    plan = hot.unionByName(cold)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("FlatMapGroups") == 3  # step 1 of either branch, and the merge
    assert hot.select(F.spark_partition_id()).distinct().count() == 4  # few bytes, but not one task


def test_late_records_are_dropped(spark, tmp_path):
    for i, ts in enumerate([[0, 5, 30], [2, 31, 60], [90]]):
        spark.createDataFrame([(0, t, 1, "w") for t in ts], "agent_id int, ts long, key int, str string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("agent_id int, ts long, key int, str string").parquet(str(tmp_path / "in"))
        counts = jobs.word_count_stream(stream.withColumn("worker", F.lit(0)), 10, 10)
        counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r["ws"]: r["cnt"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == 2 and got[30] == 2  # the record at 2 came after the watermark had passed its window
