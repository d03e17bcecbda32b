"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents; the
last returns the encoding's digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm import bpe, decontaminate, nearsets, repeats, toxicity
from ballast.shared import compact, discard, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    return toxicity.reject_toxic(docs, toxicity.training_labels(spark, sf_dir))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles >= 0.8) the document of smallest id stays (rows of that id all stay, as do those without an id)."""
    groups = nearsets.near_copies(docs.select("doc_id", "text"))
    gone = groups.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first")).where("not first").select("doc_id")
    return nearsets.only(compact(docs), stored(gone, True), "left_anti")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts, which stay as they are elsewhere; every document stays, n_chars follows a text that is cut."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = repeats.cut_repeats(docs, keep=("n_chars", *rest), layout=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("keep0"))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept").alias("text"), "n_chars": n_chars.alias("n_chars")} | {c: F.col(f"keep{i}").alias(c) for i, c in enumerate(rest, 1)}
    return cut.select(*[made[c] for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    import public_tokenizers

    return bpe.digests(bpe.encode_decode(compact(docs), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, known=200_000, learnt=15_000))


STAGES = [("toxicity", toxicity_stage), ("simhash", simhash_stage), ("substrings", substring_stage), ("decontamination", decontamination_stage), ("bpe", bpe_stage)]
#: Learned scores and XXH64 can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
