"""First-wins duplicates and resuming after what is already there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_by(df: DataFrame, key: Column, order: str, name: str = "key") -> DataFrame:
    """One row per non-null key: that of the smallest `order`, with `copies`, the number of rows it stands for.

    min_by aggregates on the map side, so a key that holds a third of all rows costs one row per task. dropDuplicates
    would keep an arbitrary row.
    """
    row = F.struct(*df.columns)
    keyed = df.withColumn("__key", key).where("__key is not null")
    best = keyed.groupBy("__key").agg(F.min_by(row, order).alias("__row"), F.count(F.lit(1)).alias("copies"))
    return best.select(F.col("__key").alias(name), *[F.col(f"__row.{c}").alias(c) for c in df.columns if c != name], "copies")


def duplicate_counts(df: DataFrame, key: Column) -> DataFrame:
    """One row: loaded, distinct and duplicate rows by key. The distinct count is over partial sums, not one set."""
    per = df.select(key.alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("loaded"), F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def not_yet(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose key is not in done: what a resumed run has still to do. Null keys count as not done."""
    return df.join(done.select(*on).distinct(), on, "left_anti")


def new_first(df: DataFrame, done: DataFrame, key: Column, order: str) -> DataFrame:
    """not_yet and first_by on one derived key."""
    return first_by(df.withColumn("__new", key).join(done.select(key.alias("__new")).distinct(), "__new", "left_anti").drop("__new"), key, order)


def seeded_sample(df: DataFrame, key: str, order: str, n: int, seed: int) -> DataFrame:
    """The first n rows by `order`, in an order that a seed fixes: that of shuffle_key, the md5 of key and seed."""
    taken = df.orderBy(order).limit(n)
    return taken.select(*df.columns, F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))).alias("shuffle_key")).orderBy("shuffle_key", key)


def not_written(df: DataFrame, name: Column, written: DataFrame, force: bool = False) -> DataFrame:
    """df with filename: rows whose file (written: filename) is not there yet, or all with force."""
    named = df.withColumn("filename", name)
    return named if force else not_yet(named, written, ["filename"])


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with batch (from 0) of `size` rows in the given order and position (from 0).

    Positions come from counts per range and running numbers inside each, so no task sees all rows.
    """
    from pyspark.sql import Window

    from ..runtime import cut

    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    placed = parts.withColumn("__in", inside).join(F.broadcast(offsets), "__part")  # one row per partition
    return placed.withColumn("position", F.col("__in") + F.col("__before")).withColumn("batch", F.floor(F.col("position") / size)).drop("__part", "__in", "__before")
