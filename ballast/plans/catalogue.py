"""Named queries over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions.windows import pane_of
from ballast.operators import clustering, hotkeys, static, stats, wordcount
from ballast.operators.cooperative import routed_cooperatively
from ballast.operators.routers import KEY_DISJOINT, ROUTERS, routed
from ballast.shared import shared_dir
from ballast.sources import records

P, SIZE, SLIDE, AGENTS = 8, 2000, 500, 4
M = SIZE // SLIDE
Query = Callable[[SparkSession, str], DataFrame]


def assigned(df: DataFrame, name: str, p: int = P, size: int = SIZE, slide: int = SLIDE) -> DataFrame:
    """Route records by a partitioner's name."""
    if name == "hashing":
        return df.withColumn("worker", static.hashing(F.col("key"), p))
    if name == "shuffling":
        return df.withColumn("worker", static.shuffling(F.col("ts"), p))
    return routed(df, name, p, size, slide)


def _wc(name: str) -> Query:
    return lambda spark, d: wordcount.word_count(assigned(records.events(spark, d), name), SIZE, SLIDE, name in KEY_DISJOINT)


def _by_agents(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Records dealt to agents that each route by themselves."""
    return assigned(records.dealt(records.events(spark, d), AGENTS), name)


def _coop(spark: SparkSession, d: str) -> DataFrame:
    """Two agents take turns at the records."""
    return routed_cooperatively(records.dealt(records.events(spark, d), 2), P, SIZE, SLIDE, 2, 4 * SIZE)


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return assigned(records.events(spark, d), "hashing")


def _shuffled(spark: SparkSession, d: str) -> DataFrame:
    return assigned(records.events(spark, d), "shuffling")


def _forward(hot: bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = assigned(hotkeys.hot_status(records.events(spark, d), SLIDE, P).withColumnRenamed("hot", "is_hot"), "hashing")
        return wordcount.forwarded(e, SIZE, SLIDE)[0 if hot else 1].select("ws", "key", "word", "cnt")

    return run


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return records.parts(spark, d).withColumn("block", pane_of(F.col("ts"), SIZE)).withColumn("worker", static.shuffling(F.col("ts"), P))


def _forwarded_clusters(spark: SparkSession, d: str) -> DataFrame:
    parts = hotkeys.hot_status(_parts(spark, d), SLIDE, 100).withColumnRenamed("hot", "is_hot")
    hot, cold = clustering.forwarded(parts, SIZE, SLIDE, "BEST")
    return hot.withColumn("is_hot", F.lit(True)).unionByName(cold.withColumn("is_hot", F.lit(False)))


def _circular(spark: SparkSession, d: str) -> DataFrame:
    e = records.events(spark, d)
    return records.replayed(e, e.count(), 2, 2)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") - 1).cast("long").alias("ts"), (F.col("o_custkey") % 100).cast("int").alias("key"), F.col("o_orderstatus").alias("str"))


def _two(spark: SparkSession, d: str) -> DataFrame:
    return records.two_sources(records.events(spark, d), _orders(spark, d))


def _alternate(spark: SparkSession, d: str) -> DataFrame:
    e, orders = records.events(spark, d), _orders(spark, d)
    return records.two_sources(e, orders, True, e.count(), orders.count())


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines, every 97th with a bad key, read back."""
    e = records.events(spark, d)
    path = shared_dir(spark)
    key = F.when(F.col("ts") % 97 == 0, F.lit("x")).otherwise(F.col("key").cast("string"))
    e.select("ts", F.concat_ws(",", key, "str").alias("value")).orderBy("ts").select("value").write.text(path)
    return records.read_lines(spark, path)


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    found = stats.normalised(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "value"), "user_id", "event_id", "value")
    return found.select("user_id", "event_id", F.round(F.col("normalised") + 1e-9, 6).alias("normalised"))


def _estimates(spark: SparkSession, d: str) -> DataFrame:
    e = records.events(spark, d)
    return hotkeys.estimates(e, hotkeys.count_min(e))


def _qtables(spark: SparkSession, d: str) -> DataFrame:
    e = records.events(spark, d)
    q = F.array(*[(-((F.col("key") * 7 + F.col("ts") * (i + 3)) % 100) / 50.0) for i in range(4)])
    return stats.merge_qtables(e.select("key", q.alias("q"), (F.col("ts") % 5 + 1).alias("n"))).select("key", "action", F.round("q", 9).alias("q"))


def _welford(spark: SparkSession, d: str) -> DataFrame:
    found = stats.running_moments(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "value"), "user_id", "event_id", "value")
    return found.select("user_id", "event_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mean", "var")])  # exact halves are common; they go up in both engines


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "wc_hashing": _wc("hashing"),
        "wc_shuffling_two_step": _wc("shuffling"),
        **{f"wc_{name}": lambda s, d, name=name: wordcount.by_worker(_by_agents(s, d, name), SIZE, SLIDE) for name in ROUTERS},
        "wc_coop": lambda s, d: wordcount.by_worker(_coop(s, d), SIZE, SLIDE),
        "wc_cam_one_step": lambda s, d: wordcount.word_count(_by_agents(s, d, "cam"), SIZE, SLIDE, True),
        "wc_two_choices_two_step": lambda s, d: wordcount.word_count(_by_agents(s, d, "two_choices"), SIZE, SLIDE),
        "wc_documents": lambda s, d: records.documents(s, d).withColumn("word", F.explode(wordcount.split_words(F.col("str")))).groupBy("key", "word").agg(F.count("*").alias("cnt")),
        "wc_forward_hot_only": _forward(True),
        "wc_forward_cold_only": _forward(False),
        "rec_project": records.events,
        "source_circular": _circular,
        "source_two_files": _two,
        "source_alternate": _alternate,
        "source_lines": _lines,
        "union_streams": lambda s, d: _two(s, d).groupBy("agent_id", "key").agg(F.count("*").alias("n"), F.max("ts").alias("last")),
        "part_hashing": lambda s, d: _hashed(s, d).select("ts", "key", "worker"),
        "part_shuffling": lambda s, d: _shuffled(s, d).select("ts", "key", "worker"),
        "part_two_choice_candidates": lambda s, d: records.events(s, d).select("ts", "key", static.hashing(F.col("key"), P).alias("h1"), static.second_hash(F.col("key"), P).alias("h2")),
        "placement": lambda s, d: static.placed(_hashed(s, d), P).select("ts", "worker", F.spark_partition_id().alias("partition")),
        "load_sliding": lambda s, d: stats.load(_hashed(s, d), SIZE, SLIDE),
        "load_imbalance": lambda s, d: stats.imbalance(_hashed(s, d), SIZE, SLIDE, P),
        "load_summary": lambda s, d: stats.load_summary(_hashed(s, d), SIZE, SLIDE, P),
        "cardinality_sliding": lambda s, d: stats.cardinality(_hashed(s, d), SIZE, SLIDE),
        "fragmentation_sliding": lambda s, d: stats.fragmentation(_shuffled(s, d), SIZE, SLIDE),
        "replication_factor": lambda s, d: stats.replication(_shuffled(s, d), SIZE, SLIDE),
        "reward_static": lambda s, d: stats.rewards(_shuffled(s, d), SIZE, SLIDE, P),
        "welford_running": _welford,
        "normalised_running": _normalised,
        "qtable_merge": _qtables,
        "hot_status_per_record": lambda s, d: hotkeys.hot_status(records.events(s, d), SLIDE, P).select("ts", "key", "hot"),
        "hot_keys_exact": lambda s, d: hotkeys.hot_keys(records.events(s, d), SLIDE, P),
        "hot_keys_dag": lambda s, d: hotkeys.hot_keys(records.events(s, d), SLIDE, P, 100, roll_first=False),
        "hot_keys_sketch": lambda s, d: hotkeys.hot_keys_sketched(records.events(s, d), SLIDE, P, 100),
        "topk_keys": lambda s, d: hotkeys.top_keys(records.events(s, d), SLIDE, P),
        "cms_estimate": _estimates,
        "sim_pairs_part": lambda s, d: clustering.similar_pairs(_parts(s, d)),
        "sim_edges_positive": lambda s, d: clustering.similar_pairs(_parts(s, d)).where("sim > 0"),
        "cluster_best": lambda s, d: clustering.partial_clusters(_parts(s, d).withColumn("worker", F.lit(0)), SIZE, SLIDE, "BEST"),
        "cluster_vote": lambda s, d: clustering.partial_clusters(_parts(s, d).withColumn("worker", F.lit(0)), SIZE, SLIDE, "VOTE"),
        "cluster_merge": lambda s, d: clustering.merge_clusters(clustering.partial_clusters(_parts(s, d), SIZE, SLIDE, "BEST")),
        "cluster_one_step": lambda s, d: clustering.clustered(_parts(s, d).withColumn("worker", static.hashing(F.col("key"), P)), SIZE, SLIDE, "BEST", True),
        "cluster_forwarded": _forwarded_clusters,
        "route_coop": lambda s, d: _coop(s, d).select("agent_id", "ts", "key", "worker", "is_hot"),
    }
    for name in ROUTERS:
        found[f"route_{name}"] = lambda s, d, name=name: _by_agents(s, d, name).select("agent_id", "ts", "key", "worker", "is_hot")
    return found


_B = "(event_id * 7919) % 1000"
_REC = f"rec AS (SELECT 0 agent_id, event_id ts, CAST(CASE WHEN {_B} < 300 THEN 0 WHEN {_B} < 450 THEN 1 WHEN {_B} < 550 THEN 2 ELSE user_id + 3 END AS INTEGER) AS key, event_type || ' ' || props str FROM events)"
_WORDS = "unnest(CASE WHEN str <> '' AND trim(str) = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace(str, ' +$', ''), ' ') END) word"
_WS = f"(ts // {SLIDE} - i) * {SLIDE} ws"
_WC = f"WITH {_REC} SELECT ws, key, word, count(*) cnt FROM (SELECT key, {_WS}, {_WORDS} FROM rec, range({M}) t(i)) GROUP BY ALL"
_HASHED, _SHUFFLED = (f"WITH {_REC}, a AS (SELECT ts, key, CAST({w} AS INTEGER) worker FROM rec), n AS (SELECT {_WS}, key, worker, count(*) n FROM a, range({M}) t(i) GROUP BY ALL)" for w in (f"key % {P}", f"ts % {P}"))
_HOT = (
    f"WITH {_REC}, i AS (SELECT *, ts // {SLIDE} iv FROM rec), t AS (SELECT iv, count(*) n FROM i GROUP BY iv), "
    f"r AS (SELECT i.*, row_number() OVER (PARTITION BY iv, key ORDER BY ts) rn, (SELECT n // {P} FROM t WHERE t.iv = i.iv - 1) thr FROM i), "
    "b AS (SELECT iv, key FROM r GROUP BY iv, key HAVING max(rn) > max(thr)), "
    "h AS (SELECT ts, key, str, coalesce(rn > thr, false) OR EXISTS (SELECT 1 FROM b WHERE b.key = r.key AND b.iv = r.iv - 1) "
    f"OR (ts = r.iv * {SLIDE} AND EXISTS (SELECT 1 FROM b WHERE b.key = r.key AND b.iv = r.iv - 2)) hot FROM r)"
)
_COUNTS = f"WITH {_REC}, n AS (SELECT ts // {SLIDE} iv, key, count(*) n FROM rec GROUP BY ALL)"
_PAIRS = f"SELECT * FROM (SELECT a.p_partkey // {SIZE} block, a.p_size AS key, a.p_partkey a, b.p_partkey b, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 9) sim FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_partkey // {SIZE} = b.p_partkey // {SIZE} AND a.p_partkey < b.p_partkey)"


def _forward_sql(test: str) -> str:
    return f"{_HOT}, w AS (SELECT {_WS}, key, hot, {_WORDS} FROM h, range({M}) t(i)), k AS (SELECT (ts // {SLIDE} - i) * {SLIDE} ws, key, bool_or(hot) kh FROM h, range({M}) t(i) WHERE str = '' OR trim(str) <> '' GROUP BY ALL) SELECT ws, key, word, count(*) cnt FROM w JOIN k USING (ws, key) WHERE {test} GROUP BY ALL"


#: A record's worker from those of all before it: recursion over an agent's records, all agents side by side. The state is
#: the list of (pane * K + key * P + worker) of records that haven't expired.
_K = 1 << 40
_OF = "len(list_filter(st, lambda e: e % {p} = {h}))"
_KEYS_OF = "len(list_distinct(list_transform(list_filter(st, lambda e: e % {p} = {h}), lambda e: e % {k})))"


def _route_sql(name: str) -> str:
    """(agent_id, ts, key, worker, is_hot, str) as CTE x."""
    load, keys = (lambda h: _OF.format(p=P, h=h)), (lambda h: _KEYS_OF.format(p=P, h=h, k=_K))
    seen = lambda h: f"list_contains(list_transform(st, lambda e: e % {_K}), key * {P} + {h})"
    less = f"CASE WHEN {load('h1')} < {load('h2')} THEN h1 ELSE h2 END"
    gain = f"0.5::DOUBLE * (CASE WHEN {seen('i')} THEN 1 ELSE 0 END) - (CASE WHEN len(st) = 0 THEN 0 ELSE 0.5::DOUBLE * ({load('i')} - len(st) / {P}::DOUBLE) / (len(st) / {P}::DOUBLE) END)"
    gains = "[" + ", ".join(gain.replace("+ i)", f"+ {i})").replace("= i)", f"= {i})") for i in range(P)) + "]"
    choice = {
        "two_choices": less,
        "cm": f"CASE WHEN {keys('h1')} < {keys('h2')} THEN h1 ELSE h2 END",
        "cam": f"CASE WHEN {seen('h1')} THEN h1 WHEN {seen('h2')} THEN h2 ELSE {less} END",
        "dagreedy": f"CASE WHEN hot THEN list_position({gains}, list_max({gains})) - 1 ELSE h1 END",
    }[name]
    keep = "s.st" if name == "cam" else f"CASE WHEN r.pane = s.pane THEN s.st ELSE list_filter(s.st, lambda e: e // {_K} >= r.pane - {M}) END"
    x = "((key + 1) * 0.6180339887498949::DOUBLE)"
    # an interval's first record belongs to the one before; hot: over the last interval's total / 100 P in this one, or in the one before until this one's end
    hot = f"""d AS (SELECT *, CASE WHEN ts // {SLIDE} > 0 AND ts = min(ts) OVER (PARTITION BY a, ts // {SLIDE}) THEN ts // {SLIDE} - 1 ELSE ts // {SLIDE} END iv FROM b),
t AS (SELECT a, iv + 1 iv, count(*) // {100 * P} thr FROM d GROUP BY ALL),
q AS (SELECT d.*, row_number() OVER (PARTITION BY d.a, d.iv, key ORDER BY ts) > thr AS over FROM d LEFT JOIN t ON t.a = d.a AND t.iv = d.iv),
g AS (SELECT DISTINCT a, iv, key FROM q WHERE over),
r AS MATERIALIZED (SELECT q.*, coalesce(over, false) OR (g.key IS NOT NULL AND ts < (q.iv + 1) * {SLIDE}) hot FROM q LEFT JOIN g ON g.a = q.a AND g.key = q.key AND g.iv = q.iv - 1)"""
    return f"""WITH RECURSIVE {_REC}, b AS (SELECT ts % {AGENTS} a, ts // {AGENTS} o, ts, ts // {SLIDE} pane, key, str, key % {P} h1, CAST(floor({P} * ({x} - trunc({x}))) AS BIGINT) % {P} h2 FROM rec),
{hot if name == "dagreedy" else "r AS MATERIALIZED (SELECT *, true hot FROM b)"},
s AS (SELECT DISTINCT a, CAST(-1 AS BIGINT) o, CAST(0 AS BIGINT) pane, CAST([] AS BIGINT[]) st, CAST(0 AS BIGINT) w FROM r UNION ALL
SELECT a, o, pane, list_append(st, pane * {_K} + key * {P} + w), w FROM (SELECT *, {choice} w FROM (SELECT r.*, {keep} st FROM s JOIN r ON r.a = s.a AND r.o = s.o + 1))),
x AS (SELECT CAST(r.a AS INTEGER) agent_id, r.ts, r.key, CAST(w AS INTEGER) worker, hot is_hot, str FROM s JOIN r ON r.a = s.a AND r.o = s.o)"""


def _cms_sql() -> str:
    width, depth = hotkeys.sketch_size(0.05, 0.9)
    rows = ", ".join(f"({i}, {a}::BIGINT)" for i, a in enumerate(hotkeys.multipliers(depth)))
    return f"WITH {_REC}, m(r, a) AS (VALUES {rows}), c AS (SELECT key, r, ((key * a) % 2147483647) % {width} b FROM rec, m), s AS (SELECT r, b, count(*) n FROM c GROUP BY r, b) SELECT key, min(n) AS estimate FROM (SELECT DISTINCT * FROM c) JOIN s USING (r, b) GROUP BY key"


def _sketch_sql() -> str:
    width, depth = hotkeys.sketch_size(0.05, 0.9)
    rows = ", ".join(f"({i}, {a}::BIGINT)" for i, a in enumerate(hotkeys.multipliers(depth)))
    return f"{_COUNTS}, m(r, a) AS (VALUES {rows}), c AS (SELECT iv, key, n, r, ((key * a) % 2147483647) % {width} b FROM n, m), s AS (SELECT iv, r, b, sum(n) x FROM c GROUP BY ALL), e AS (SELECT iv, key, max(n) n, min(x) x FROM c JOIN s USING (iv, r, b) GROUP BY ALL), t AS (SELECT iv + 1 iv, sum(n) // {P} thr, count(*) >= 100 wide FROM n GROUP BY iv) SELECT iv, key, CAST(CASE WHEN wide THEN x ELSE n END AS BIGINT) n FROM e JOIN t USING (iv) WHERE CASE WHEN wide THEN x ELSE n END > thr"


def oracle_sql() -> dict[str, str]:
    orders = "SELECT 2 agent_id, CAST(2 + 2 * (o_orderkey - 1) AS BIGINT) ts, CAST(o_custkey % 100 AS INTEGER) AS key, o_orderstatus str FROM orders"
    two = f"WITH {_REC}, u AS (SELECT 1 agent_id, 1 + 2 * ts ts, key, str FROM rec UNION ALL {orders})"
    x = "((key + 1) * 0.6180339887498949::DOUBLE)"
    return {
        **{name: _WC for name in ("wc_hashing", "wc_shuffling_two_step", "wc_cam_one_step", "wc_two_choices_two_step")},
        **{f"route_{n}": f"{_route_sql(n)} SELECT agent_id, ts, key, worker, is_hot FROM x" for n in ("two_choices", "cm", "cam", "dagreedy")},
        **{f"wc_{n}": f"{_route_sql(n)} SELECT ws, worker, key, word, count(*) cnt FROM (SELECT key, worker, {_WS}, {_WORDS} FROM x, range({M}) t(i)) GROUP BY ALL" for n in ("two_choices", "cm", "cam", "dagreedy")},
        "wc_documents": f"WITH l AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS key FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) SELECT coalesce(key, -1) AS key, word, count(*) cnt FROM (SELECT lang, {_WORDS} FROM (SELECT lang, text str FROM documents)) LEFT JOIN l USING (lang) GROUP BY ALL",
        "wc_forward_hot_only": _forward_sql("kh"),
        "wc_forward_cold_only": _forward_sql("NOT kh"),
        "rec_project": f"WITH {_REC} SELECT * FROM rec",
        "source_circular": f"WITH {_REC} SELECT CAST(a AS INTEGER) agent_id, ts + c * (SELECT count(*) FROM rec) ts, key, str FROM rec, range(2) t(c), range(2) u(a)",
        "source_two_files": f"{two} SELECT * FROM u",
        "source_alternate": f"WITH {_REC}, o AS (SELECT o_orderkey - 1 ts, CAST(o_custkey % 100 AS INTEGER) AS key, o_orderstatus str FROM orders), l AS (SELECT least((SELECT count(*) FROM rec), (SELECT count(*) FROM o)) n) SELECT 0 agent_id, CAST(2 * ts AS BIGINT) ts, key, str FROM rec, l WHERE ts < n UNION ALL SELECT 0, CAST(2 * ts + 1 AS BIGINT), key, str FROM o, l WHERE ts < n",
        "source_lines": f"WITH {_REC} SELECT 0 agent_id, row_number() OVER (ORDER BY ts) - 1 ts, key, split_part(str, ',', 1) str FROM rec WHERE ts % 97 <> 0",
        "union_streams": f"{two} SELECT agent_id, key, count(*) n, max(ts) AS last FROM u GROUP BY ALL",
        "part_hashing": f"WITH {_REC} SELECT ts, key, CAST(key % {P} AS INTEGER) worker FROM rec",
        "part_shuffling": f"WITH {_REC} SELECT ts, key, CAST((row_number() OVER (ORDER BY ts) - 1) % {P} AS INTEGER) worker FROM rec",
        "part_two_choice_candidates": f"WITH {_REC} SELECT ts, key, CAST(key % {P} AS INTEGER) h1, CAST(floor({P} * ({x} - trunc({x}))) AS INTEGER) h2 FROM rec",
        "placement": f"WITH {_REC} SELECT ts, CAST(key % {P} AS INTEGER) worker, CAST(key % {P} AS INTEGER) AS partition FROM rec",
        "load_sliding": f"WITH {_REC}, n AS (SELECT CAST(key % {P} AS INTEGER) worker, ts // {SLIDE} pane, count(*) n FROM rec GROUP BY ALL) SELECT worker, pane, CAST(sum(n) OVER (PARTITION BY worker ORDER BY pane RANGE BETWEEN {M} PRECEDING AND CURRENT ROW) AS BIGINT) load FROM n",
        "load_summary": f"WITH {_REC}, n AS (SELECT CAST(key % {P} AS INTEGER) worker, ts // {SLIDE} pane, count(*) n FROM rec GROUP BY ALL), l AS (SELECT p.pane, worker, sum(n) l FROM (SELECT DISTINCT pane FROM n) p JOIN n ON n.pane BETWEEN p.pane - {M} AND p.pane GROUP BY ALL) SELECT pane, sum(l) / {P}::DOUBLE mean, CAST(max(l) AS BIGINT) most FROM l GROUP BY pane",
        "load_imbalance": f"{_HASHED} SELECT ws, round(max(l) * {P} / sum(l) - 1, 9) imbalance FROM (SELECT ws, worker, sum(n) l FROM n GROUP BY ALL) GROUP BY ws",
        "cardinality_sliding": f"{_HASHED} SELECT ws, worker, count(DISTINCT key) AS keys FROM n GROUP BY ALL",
        "fragmentation_sliding": f"{_SHUFFLED} SELECT ws, key, count(DISTINCT worker) workers FROM n GROUP BY ALL",
        "replication_factor": f"{_SHUFFLED} SELECT ws, round(avg(w), 9) replication FROM (SELECT ws, key, count(DISTINCT worker) w FROM n GROUP BY ALL) GROUP BY ws",
        "reward_static": f"{_SHUFFLED}, l AS (SELECT ws, worker, CAST(sum(n) AS DOUBLE) l FROM n GROUP BY ALL), m AS (SELECT ws, sum(l) / {P} m FROM l GROUP BY ws), k AS (SELECT ws, key, count(*) kf FROM n GROUP BY ALL) SELECT n.ws, n.key, n.worker, round(-(0.5::DOUBLE * (l - m) / greatest(l, m) + 0.5::DOUBLE * kf / {P}), 9) reward FROM n JOIN l USING (ws, worker) JOIN m USING (ws) JOIN k ON k.ws = n.ws AND k.key = n.key",
        "welford_running": "SELECT user_id, event_id, round(avg(value) OVER w + 1e-9, 6) mean, round(CASE WHEN count(value) OVER w < 2 THEN 1.0 ELSE var_samp(value) OVER w END + 1e-9, 6) var FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        "normalised_running": "SELECT user_id, event_id, round((value - avg(value) OVER w) / sqrt(CASE WHEN count(value) OVER w < 2 THEN 1.0 ELSE var_samp(value) OVER w END + 1e-8) + 1e-9, 6) normalised FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        "qtable_merge": f"WITH {_REC}, q AS (SELECT key, CAST(a AS INTEGER) AS action, ts % 5 + 1 n, -((key * 7 + ts * (a + 3)) % 100) / 50.0::DOUBLE q FROM rec, range(4) t(a)) SELECT key, action, round(sum(n * q) / sum(n), 9) q FROM q GROUP BY ALL",
        "hot_status_per_record": f"{_HOT} SELECT ts, key, hot FROM h",
        "hot_keys_exact": f"{_COUNTS} SELECT iv, key, n FROM n WHERE n > (SELECT sum(n) // {P} FROM n x WHERE x.iv = n.iv - 1)",
        "hot_keys_dag": f"WITH {_REC}, n AS (SELECT iv, key, count(*) n FROM (SELECT key, CASE WHEN ts // {SLIDE} > 0 AND ts = min(ts) OVER (PARTITION BY ts // {SLIDE}) THEN ts // {SLIDE} - 1 ELSE ts // {SLIDE} END iv FROM rec) GROUP BY ALL) SELECT iv, key, n FROM n WHERE n > (SELECT sum(n) // {100 * P} FROM n x WHERE x.iv = n.iv - 1)",
        "hot_keys_sketch": _sketch_sql(),
        "topk_keys": f"{_COUNTS} SELECT iv, CAST(r AS INTEGER) AS rank, key, n FROM (SELECT *, row_number() OVER (PARTITION BY iv ORDER BY n DESC, key) r FROM n) WHERE r <= {P}",
        "cms_estimate": _cms_sql(),
        "sim_pairs_part": _PAIRS,
        "sim_edges_positive": f"{_PAIRS} WHERE sim > 0",
    }
