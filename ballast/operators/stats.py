"""Load, cardinality and fragmentation of routed records (ts, key, worker) in sliding windows, and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.windows import checked, pane_of, sliding


def load(df: DataFrame, size: int, slide: int) -> DataFrame:
    """(worker, pane, load): records of this pane and the size / slide before it."""
    m = checked(size, slide)
    n = df.groupBy("worker", pane_of(F.col("ts"), slide).alias("pane")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("worker").orderBy("pane").rangeBetween(-m, 0)
    return n.select("worker", "pane", F.sum("n").over(w).alias("load"))


def imbalance(df: DataFrame, size: int, slide: int, p: int) -> DataFrame:
    """(ws, imbalance): most loaded worker over the mean of all p, less 1."""
    n = sliding(df.groupBy("worker", pane_of(F.col("ts"), slide).alias("pane")).agg(F.count("*").alias("n")), size, slide)
    return n.groupBy("ws", "worker").agg(F.sum("n").alias("n")).groupBy("ws").agg(F.round(F.max("n") * p / F.sum("n") - 1, 9).alias("imbalance"))


def load_summary(df: DataFrame, size: int, slide: int, p: int) -> DataFrame:
    """(pane, mean, most): mean over all p workers and largest of the workers' sliding loads, in panes where any record came.

    A worker without records in a pane still has the load of the panes before it.
    """
    m = checked(size, slide)
    n = df.groupBy("worker", pane_of(F.col("ts"), slide).alias("pane")).agg(F.count("*").alias("n"))
    spread = n.select("worker", F.explode(F.sequence(F.col("pane"), F.col("pane") + m)).alias("pane"), "n").groupBy("worker", "pane").agg(F.sum("n").alias("load"))
    some = n.select("pane").distinct()
    return spread.join(some, "pane", "left_semi").groupBy("pane").agg((F.sum("load") / p).alias("mean"), F.max("load").alias("most"))


def _distinct(df: DataFrame, slide: int) -> DataFrame:
    return df.select(pane_of(F.col("ts"), slide).alias("pane"), "key", "worker").distinct()


def cardinality(df: DataFrame, size: int, slide: int) -> DataFrame:
    """(ws, worker, keys): distinct keys of each worker."""
    return sliding(_distinct(df, slide), size, slide).select("ws", "worker", "key").distinct().groupBy("ws", "worker").agg(F.count("*").alias("keys"))


def fragmentation(df: DataFrame, size: int, slide: int) -> DataFrame:
    """(ws, key, workers): distinct workers of each key."""
    return sliding(_distinct(df, slide), size, slide).select("ws", "worker", "key").distinct().groupBy("ws", "key").agg(F.count("*").alias("workers"))


def replication(df: DataFrame, size: int, slide: int) -> DataFrame:
    """(ws, replication): mean distinct workers of a key."""
    return fragmentation(df, size, slide).groupBy("ws").agg(F.round(F.avg("workers"), 9).alias("replication"))


def rewards(df: DataFrame, size: int, slide: int, p: int) -> DataFrame:
    """(ws, key, worker, reward): half the worker's relative overload and half the key's share of workers, negated."""
    n = sliding(df.groupBy(pane_of(F.col("ts"), slide).alias("pane"), "key", "worker").agg(F.count("*").alias("n")), size, slide).groupBy("ws", "key", "worker").agg(F.sum("n").alias("n"))
    loads = n.groupBy("ws", "worker").agg(F.sum("n").alias("load"))
    means = loads.groupBy("ws").agg((F.sum("load") / p).alias("mean"))
    frag = n.groupBy("ws", "key").agg(F.count("*").alias("kf"))
    value = -(0.5 * (F.col("load") - F.col("mean")) / F.greatest("load", "mean") + 0.5 * F.col("kf") / p)
    return n.select("ws", "key", "worker").join(loads, ["ws", "worker"]).join(means, "ws").join(frag, ["ws", "key"]).select("ws", "key", "worker", F.round(value, 9).alias("reward"))


def running_moments(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Running mean and sample variance (1 while there are fewer than two values) within each group."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    var = F.when(F.count(value).over(w) < 2, 1.0).otherwise(F.var_samp(value).over(w))
    return df.select(by, order, F.avg(value).over(w).alias("mean"), var.alias("var"))


def normalised(df: DataFrame, by: str, order: str, value: str, eps: float = 1e-8) -> DataFrame:
    """Each value less the running mean, over the running deviation."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    var = F.when(F.count(value).over(w) < 2, 1.0).otherwise(F.var_samp(value).over(w))
    return df.select(by, order, ((F.col(value) - F.avg(value).over(w)) / F.sqrt(var + eps)).alias("normalised"))


def merge_qtables(df: DataFrame) -> DataFrame:
    """df (key, q array, n): the count-weighted mean of the agents' values of each key."""
    x = df.select("key", "n", F.posexplode("q").alias("action", "q"))
    return x.groupBy("key", "action").agg((F.sum(F.col("n") * F.col("q")) / F.sum("n")).alias("q"))
