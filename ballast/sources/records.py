"""Keyed record streams: (agent_id, ts, key, str). ts is the ordinal of a record in its source, the event-time clock."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "agent_id int, ts long, key int, str string"


def skewed_key(ident: Column, other: Column) -> Column:
    """Three hot keys with 30, 15 and 10 per cent of the records; the rest by `other`."""
    b = (ident * 7919) % 1000
    return F.when(b < 300, 0).when(b < 450, 1).when(b < 550, 2).otherwise(other + 3).cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as records with skewed keys; columns are pruned to the four that are read."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.lit(0).alias("agent_id"), F.col("event_id").alias("ts"), skewed_key(F.col("event_id"), F.col("user_id")).alias("key"), F.concat_ws(" ", "event_type", "props").alias("str"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records; the key is the language's place in the alphabet."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs = sorted(r["lang"] for r in d.select("lang").where("lang is not null").distinct().collect())  # as many as there are languages
    code = F.coalesce(*[F.when(F.col("lang") == x, i) for i, x in enumerate(langs)], F.lit(-1)) if langs else F.lit(-1)
    return d.select(F.lit(0).alias("agent_id"), F.col("doc_id").alias("ts"), code.cast("int").alias("key"), F.col("text").alias("str"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records: blocks of equal size, names to cluster."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit(0).alias("agent_id"), F.col("p_partkey").cast("long").alias("ts"), F.col("p_size").cast("int").alias("key"), F.col("p_name").alias("str"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, start, key, str) with their place n in the piece of the file they come from."""
    n, at = 0, None
    for batch in batches:
        places = []
        for piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, at = (n + 1 if piece == at else 0), piece
            places.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["file", "start", "key", "str", "n"])


def read_lines(spark: SparkSession, path: str, agent_id: int = 0, start: int = 0, step: int = 1) -> DataFrame:
    """Lines `key,string[,ignored]` as records in file order.

    A bad key, or no second field, drops the line and takes no ordinal; a missing file raises; files of a folder follow each
    other by name. An ordinal is the row's place in its piece of a file after the counts of the pieces before: no task sees
    all rows, and the running sum is over one row for each piece that Spark reads.
    """
    fields = F.split("value", ",")
    pieces = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.expr("try_cast(trim(split(value, ',')[0]) as int)").alias("key"), F.get(fields, 1).alias("str"))
    placed = pieces.where("key is not null and str is not null and str <> ''").mapInArrow(_numbered, "file string, start long, key int, str string, n long")
    counts = placed.groupBy("file", "start").agg(F.count("*").alias("size"))
    before = counts.select("file", "start", F.coalesce(F.sum("size").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(before, ["file", "start"]).select(F.lit(agent_id).alias("agent_id"), (F.lit(start) + F.lit(step) * (F.col("before") + F.col("n"))).cast("long").alias("ts"), "key", "str")


def dealt(df: DataFrame, agents: int) -> DataFrame:
    """A source's records dealt to some agents in turn; ordinals stay those of the source."""
    return df.withColumn("agent_id", F.pmod("ts", F.lit(agents)).cast("int"))


def replayed(df: DataFrame, n: int, cycles: int, agents: int = 1) -> DataFrame:
    """A finite replay of a circular source of n records with ordinals from 0, by each of some agents."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(cycles - 1)))
    return df.withColumn("cycle", rounds).withColumn("agent_id", F.explode(F.sequence(F.lit(0), F.lit(agents - 1)))).select("agent_id", (F.col("cycle") * F.lit(n) + F.col("ts")).cast("long").alias("ts"), "key", "str")


def circular_stream(ticks: DataFrame, df: DataFrame, n: int, agent_id: int = 0) -> DataFrame:
    """An endless replay of n records with ordinals from 0. ticks: a rate stream (value from 0), which sets the pace."""
    place = df.select(F.col("ts").alias("place"), "key", "str")
    return ticks.withColumn("place", F.col("value") % n).join(place, "place").select(F.lit(agent_id).alias("agent_id"), F.col("value").alias("ts"), "key", "str")


def two_sources(first: DataFrame, second: DataFrame, alternate: bool = False, n_first: int = 0, n_second: int = 0) -> DataFrame:
    """Two sources with ordinals from 0 each: source 1 takes the odd ordinals, source 2 the even ones from 2.

    alternate: one stream that takes turns and ends when either is exhausted.
    """
    place = lambda df, k: df.select(F.lit(k).alias("agent_id"), (F.lit(k) + 2 * F.col("ts")).cast("long").alias("ts"), "key", "str")
    if not alternate:
        return place(first, 1).unionByName(place(second, 2))
    n = min(n_first, n_second)
    turn = lambda df, k: df.where(F.col("ts") < n).select(F.lit(0).alias("agent_id"), (2 * F.col("ts") + k).cast("long").alias("ts"), "key", "str")
    return turn(first, 0).unionByName(turn(second, 1))
