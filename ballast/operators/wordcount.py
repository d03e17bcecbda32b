"""Windowed word count in one or two steps over routed records (agent_id, ts, key, str, worker[, is_hot])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.text import split_words
from ballast.functions.windows import pane_of, sliding


def partial(df: DataFrame, slide: int) -> DataFrame:
    """Step 1: counts by (pane, worker, key, word). Panes are counted once and not once for each window that holds them."""
    hot = F.bool_or("is_hot") if "is_hot" in df.columns else F.lit(True)
    return df.withColumn("word", F.explode(split_words(F.col("str")))).groupBy(pane_of(F.col("ts"), slide).alias("pane"), "worker", "key", "word").agg(F.count("*").alias("cnt"), hot.alias("is_hot"))


def by_worker(df: DataFrame, size: int, slide: int) -> DataFrame:
    """Step 1 as each worker gives it out: (ws, worker, key, word, cnt)."""
    return sliding(partial(df, slide), size, slide).groupBy("ws", "worker", "key", "word").agg(F.sum("cnt").alias("cnt"))


def final(partials: DataFrame, size: int, slide: int) -> DataFrame:
    """Step 2: (ws, key, word, cnt), whatever workers the partials came from."""
    return sliding(partials, size, slide).groupBy("ws", "key", "word").agg(F.sum("cnt").alias("cnt"))


def word_count(df: DataFrame, size: int, slide: int, key_disjoint: bool = False) -> DataFrame:
    """key_disjoint: each key has one worker, so worker partials aren't kept apart and one aggregation is enough."""
    if key_disjoint:
        df = df.withColumn("worker", F.lit(0))
    return final(partial(df, slide), size, slide)


def forwarded(df: DataFrame, size: int, slide: int) -> tuple[DataFrame, DataFrame]:
    """(hot, cold) branches: a key is hot in a window if any of its records there is; only hot keys need step 2."""
    counts = sliding(partial(df, slide), size, slide)
    keys = counts.groupBy("ws", "key").agg(F.bool_or("is_hot").alias("key_is_hot"))
    marked = counts.groupBy("ws", "key", "word").agg(F.sum("cnt").alias("cnt")).join(keys, ["ws", "key"])
    return marked.where("key_is_hot").drop("key_is_hot"), marked.where("not key_is_hot").drop("key_is_hot")
