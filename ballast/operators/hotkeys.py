"""Hot keys: exact tests in closed form, top lists and count-min sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hot_status(df: DataFrame, interval: int, p: int) -> DataFrame:
    """df (ts, key, ...) with `hot`: over the last interval's total / p occurrences in this interval, or became hot in the last.

    Ranks are counted within (interval, key); a key with a third of all records still has its ranks cut by interval, and
    what earlier intervals say is joined as one row for each (interval, key).
    """
    d = df.withColumn("iv", F.floor(F.col("ts") / interval).cast("long"))
    totals = d.groupBy("iv").agg(F.floor(F.count("*") / p).cast("long").alias("thr")).withColumn("iv", F.col("iv") + 1)
    ranked = d.withColumn("rn", F.row_number().over(Window.partitionBy("iv", "key").orderBy("ts"))).join(totals, "iv", "left")
    became = d.groupBy("iv", "key").agg(F.count("*").alias("n")).join(totals, "iv").where("n > thr").select("iv", "key")
    one, two = (became.select((F.col("iv") + k).alias("iv"), "key", F.lit(True).alias(f"was{k}")) for k in (1, 2))
    out = ranked.join(one, ["iv", "key"], "left").join(two, ["iv", "key"], "left")
    hot = F.coalesce(F.col("rn") > F.col("thr"), F.lit(False)) | F.coalesce("was1", F.lit(False)) | ((F.col("ts") == F.col("iv") * interval) & F.coalesce("was2", F.lit(False)))
    return out.select(*df.columns, hot.alias("hot"))


def _held_back(df: DataFrame, interval: int) -> DataFrame:
    """df with `iv`, an interval's first record counted to the interval before (the first interval's isn't)."""
    d = df.withColumn("iv", F.floor(F.col("ts") / interval).cast("long"))
    first = d.groupBy("iv").agg(F.min("ts").alias("opens"))
    return d.join(first, "iv").withColumn("iv", F.when((F.col("ts") == F.col("opens")) & (F.col("iv") > 0), F.col("iv") - 1).otherwise(F.col("iv"))).drop("opens")


def hot_keys(df: DataFrame, interval: int, p: int, scale: int = 1, roll_first: bool = True) -> DataFrame:
    """(iv, key, n) of keys that exceed total / (scale * p) of the interval before. Counts only: no ranks, no skew.

    roll_first: the record that reaches an interval's start opens it; else it is the last of the interval before. ts are distinct and no interval is empty.
    """
    d = df.withColumn("iv", F.floor(F.col("ts") / interval).cast("long")) if roll_first else _held_back(df, interval)
    d = d.groupBy("iv", "key").agg(F.count("*").alias("n"))
    totals = d.groupBy("iv").agg(F.floor(F.sum("n") / (scale * p)).cast("long").alias("thr")).withColumn("iv", F.col("iv") + 1)
    return d.join(totals, "iv").where("n > thr").select("iv", "key", "n")


def hot_keys_sketched(df: DataFrame, interval: int, p: int, tracked: int = 10_000, eps: float = 0.05, confidence: float = 0.9, seed: int = 33) -> DataFrame:
    """(iv, key, n) like hot_keys; n is a count-min estimate in intervals that follow one of at least `tracked` distinct keys."""
    width, depth = sketch_size(eps, confidence)
    cells = F.array(*[F.struct(F.lit(i).alias("row"), bucket(F.col("key"), a, width).alias("bucket")) for i, a in enumerate(multipliers(depth, seed))])
    d = df.where("key is not null").groupBy(F.floor(F.col("ts") / interval).cast("long").alias("iv"), "key").agg(F.count("*").alias("n"))
    last = d.groupBy("iv").agg(F.floor(F.sum("n") / p).cast("long").alias("thr"), (F.count("*") >= tracked).alias("wide")).withColumn("iv", F.col("iv") + 1)
    at = d.select("iv", "key", "n", F.explode(cells).alias("x")).select("iv", "key", "n", "x.row", "x.bucket")
    sketch = at.groupBy("iv", "row", "bucket").agg(F.sum("n").alias("cell"))
    estimate = at.join(sketch, ["iv", "row", "bucket"]).groupBy("iv", "key").agg(F.max("n").alias("n"), F.min("cell").alias("estimate"))
    return estimate.join(last, "iv").select("iv", "key", F.when(F.col("wide"), F.col("estimate")).otherwise(F.col("n")).alias("n"), "thr").where("n > thr").drop("thr")


def top_keys(df: DataFrame, interval: int, k: int) -> DataFrame:
    """(iv, rank, key, n): the k most frequent keys of each interval; ties by key."""
    d = df.groupBy(F.floor(F.col("ts") / interval).cast("long").alias("iv"), "key").agg(F.count("*").alias("n"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("iv").orderBy(F.desc("n"), "key"))).where(F.col("rank") <= k).select("iv", "rank", "key", "n")


def sketch_size(eps: float, confidence: float) -> tuple[int, int]:
    return math.ceil(2 / eps), math.ceil(-math.log(1 - confidence) / math.log(2))


#: One odd multiplier for each row of a sketch, by a linear congruence from the seed.
def multipliers(depth: int, seed: int = 33) -> list[int]:
    out, x = [], seed
    for _ in range(depth):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(x | 1)
    return out


def bucket(key: Column, a: int, width: int) -> Column:
    return F.pmod(F.pmod(key.cast("long") * F.lit(a), F.lit((1 << 31) - 1)), F.lit(width)).cast("int")


def count_min(df: DataFrame, eps: float = 0.05, confidence: float = 0.9, seed: int = 33) -> DataFrame:
    """(row, bucket, n): the sketch as rows; at most depth * width of them. Sketches add up by summing n."""
    width, depth = sketch_size(eps, confidence)
    cells = F.array(*[F.struct(F.lit(i).alias("row"), bucket(F.col("key"), a, width).alias("bucket")) for i, a in enumerate(multipliers(depth, seed))])
    return df.groupBy("key").agg(F.count("*").alias("c")).select("c", F.explode(cells).alias("x")).groupBy("x.row", "x.bucket").agg(F.sum("c").alias("n"))


def estimates(keys: DataFrame, sketch: DataFrame, eps: float = 0.05, confidence: float = 0.9, seed: int = 33) -> DataFrame:
    """(key, estimate), never under the true count. The sketch's size is fixed by eps and confidence, so it is broadcast."""
    width, depth = sketch_size(eps, confidence)
    cells = F.array(*[F.struct(F.lit(i).alias("row"), bucket(F.col("key"), a, width).alias("bucket")) for i, a in enumerate(multipliers(depth, seed))])
    probed = keys.select("key").distinct().select("key", F.explode(cells).alias("x")).select("key", "x.row", "x.bucket")
    return probed.join(F.broadcast(sketch), ["row", "bucket"]).groupBy("key").agg(F.min("n").alias("estimate"))
