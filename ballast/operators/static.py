"""Partitioners whose choice depends on the record alone, and placement of workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOLDEN = 0.6180339887498949


def hashing(key: Column, p: int) -> Column:
    return F.pmod(key, F.lit(p)).cast("int")


def shuffling(ts: Column, p: int, start: int = 0, step: int = 1) -> Column:
    """Round robin over dense ordinals: a source's nth record goes to worker n mod p, without a window over all rows."""
    return F.pmod(((ts - F.lit(start)) / F.lit(step)).cast("long"), F.lit(p)).cast("int")


def second_hash(key: Column, p: int) -> Column:
    x = (key + 1) * F.lit(GOLDEN)
    return F.pmod(F.floor(F.lit(p) * (x - x.cast("long"))), F.lit(p)).cast("int")


def placed(df: DataFrame, p: int, worker: str = "worker") -> DataFrame:
    """Worker i's rows in partition i."""
    return df.repartitionById(p, F.col(worker))
