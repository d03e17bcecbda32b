"""Event-time windows over ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked(size: int, slide: int) -> int:
    """Panes in a window; windows must be whole panes."""
    if slide <= 0 or size < slide or size % slide:
        raise ValueError("size must be a positive multiple of slide")
    return size // slide


def pane_of(ts: Column, slide: int) -> Column:
    return F.floor(ts / F.lit(slide)).cast("long")


def sliding(df: DataFrame, size: int, slide: int, pane: str = "pane", start: str = "ws") -> DataFrame:
    """One row for each window that holds the row's pane: starts (pane - i) * slide."""
    m = checked(size, slide)
    return df.withColumn(start, F.explode(F.expr(f"transform(sequence(0, {m - 1}), i -> ({pane} - i) * {slide}L)")))
