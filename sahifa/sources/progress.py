"""Counts of a run, taken while its rows pass by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F


def observed(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """df with an observation of its rows and of those that meet each condition; read after an action on df."""
    seen = Observation()
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen
