"""The same operators on Structured Streaming, and a progress sink."""

from __future__ import annotations

import csv
import os
import pickle
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ballast.functions.text import split_words
from ballast.operators.cooperative import Answer, route_round
from ballast.operators.routers import ROUTERS
from ballast.shared import ship


def event_time(df: DataFrame, slide: int, delay: str = "0 seconds") -> DataFrame:
    """Ordinals as milliseconds, moved by one slide (a record at epoch 0 would be late), with a watermark."""
    return df.withColumn("event_time", F.timestamp_millis(F.col("ts") + slide)).withWatermark("event_time", delay)


def word_count_stream(df: DataFrame, size: int, slide: int) -> DataFrame:
    """(ws, key, word, cnt) of a stream of routed records; append mode gives a window once the watermark has passed it."""
    words = event_time(df, slide).withColumn("word", F.explode(split_words(F.col("str"))))
    counts = words.groupBy(F.window("event_time", f"{size} milliseconds", f"{slide} milliseconds"), "key", "word").agg(F.count("*").alias("cnt"))
    return counts.select((F.unix_millis("window.start") - slide).alias("ws"), "key", "word", "cnt")


def two_step_stream(df: DataFrame, size: int, slide: int) -> DataFrame:
    """Partial counts by worker in sliding windows, then one tumbling window of a slide over the partials' ends."""
    words = event_time(df, slide).withColumn("word", F.explode(split_words(F.col("str"))))
    part = words.groupBy(F.window("event_time", f"{size} milliseconds", f"{slide} milliseconds"), "worker", "key", "word").agg(F.count("*").alias("cnt"))
    total = part.groupBy(F.window(F.window_time("window"), f"{slide} milliseconds").alias("w"), "key", "word").agg(F.sum("cnt").alias("cnt"))
    return total.select((F.unix_millis("w.end") - size - slide).alias("ws"), "key", "word", "cnt")


def routed_stream(df: DataFrame, name: str, p: int, size: int, slide: int) -> DataFrame:
    """A stateful router over a stream, one state for each agent; the state is checkpointed by Spark."""
    ship(df.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        router = pickle.loads(state.get[0]) if state.exists else ROUTERS[name](p, size, slide)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        found = [router.route(int(k), int(t)) for k, t in zip(rows["key"], rows["ts"], strict=True)]
        state.update((pickle.dumps(router),))
        yield rows.assign(agent_id=key[0], worker=[w for w, _ in found], is_hot=[h for _, h in found])[["agent_id", "ts", "key", "str", "worker", "is_hot"]]

    return df.where("key is not null").groupBy("agent_id").applyInPandasWithState(run, "agent_id int, ts long, key int, str string, worker int, is_hot boolean", "state binary", "append", GroupStateTimeout.NoTimeout)


class Cooperation:
    """A foreachBatch sink: each micro-batch is a round of cooperating agents, and its end their sync point.

    Routed rows of batch b go to `path`/routed/batch=b, the merged values to `path`/values/batch=b, agents' states to
    `path`/states/batch=b; all replace what an interrupted run of the same batch left, and a restarted query goes on from
    those of the batch before.
    """

    def __init__(self, path: str, p: int, size: int, slide: int, agents: int):
        self.path, self.args, self.at = path, (p, size, slide, agents), -1
        self.known = Answer()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, batch_id - 1
        if batch_id and self.at != before:
            rows = spark.read.schema("key int, q array<double>, until long, total long").parquet(f"{self.path}/values/batch={before}").collect()  # the answer's keys, and a row without key
            self.known.table = {r["key"]: (list(r["q"]), r["until"]) for r in rows if r["key"] is not None}
            self.known.total = rows[0]["total"]
        if batch_id:
            self.known.states = spark.read.schema("agent_id int, state binary").parquet(f"{self.path}/states/batch={before}")
        low, high = batch.agg(F.min("ts"), F.max("ts")).first()
        states = self.known.states
        if low is not None:
            slide = self.args[2]
            first = low // slide * slide
            rows, self.known = route_round(batch, *self.args, first, high + 1 - first, self.known)
            rows.write.mode("overwrite").parquet(f"{self.path}/routed/batch={batch_id}")
            states = self.known.states
        if states is None:
            states = spark.createDataFrame([], "agent_id int, state binary")
        states.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/states/batch={batch_id}")
        total = self.known.total
        values = spark.createDataFrame([(None, None, None, total), *((k, q, until, total) for k, (q, until) in self.known.table.items())], "key int, q array<double>, until long, total long")
        values.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/values/batch={batch_id}")
        self.at = batch_id


def metrics_path(folder: str, method: str) -> str:
    """A file named by method and date."""
    return os.path.join(folder, f"performance_metrics_{method}_{time.strftime('%Y%m%d_%H%M%S')}.csv")


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that has their number (`recordsProcessed`) once an action has run."""
    seen = Observation()
    return df.observe(seen, F.count("*").alias("recordsProcessed")), seen


class ProgressSink(StreamingQueryListener):
    """Records and rate of each micro-batch, with the driver's memory, as lines of a CSV file."""

    def __init__(self, spark: SparkSession, path: str):
        self.memory, self.path = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryMXBean(), path
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        self._write("timestamp", "heapMemoryUsed", "nonHeapMemoryUsed", "recordsProcessed", "throughput")

    def _write(self, *row: object) -> None:
        with open(self.path, "a", newline="") as f:
            csv.writer(f).writerow(row)

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        x = event.progress
        self._write(x.timestamp, self.memory.getHeapMemoryUsage().getUsed(), self.memory.getNonHeapMemoryUsage().getUsed(), x.numInputRows, x.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
