"""The training corpus of a tokenizer: which texts enter it, and counts over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import trim

#: The least length of a text in characters, and of a title that is put before it (exclusive).
LEAST_TEXT, LEAST_TITLE = 50, 10
MARK = "▁"


def training_texts(df: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """df with text trimmed, prefixed by a title of more than ten characters; shorter texts are left out, nulls are empty."""
    t, h = trim(F.coalesce(F.col(text), F.lit(""))), trim(F.coalesce(F.col(title), F.lit("")))
    kept = df.withColumn(text, t).withColumn(title, h).where(F.length(F.col(text)) >= LEAST_TEXT)
    return kept.withColumn(text, F.when(F.length(title) > LEAST_TITLE, F.concat(F.col(title), F.lit("\n\n"), F.col(text))).otherwise(F.col(text)))


def totals(df: DataFrame, text: str = "text") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"))


def pieces(text: Column) -> Column:
    """Pre-tokens: spaces become the mark, a text that does not begin with one gets it, and each mark begins a piece."""
    marked = F.replace(text, F.lit(" "), F.lit(MARK))
    headed = F.when(marked.startswith(MARK) | (marked == ""), marked).otherwise(F.concat(F.lit(MARK), marked))
    return F.regexp_extract_all(headed, F.lit(f"(?s){MARK}[^{MARK}]*|[^{MARK}]+"), F.lit(0))


def piece_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n) over all texts; counted on the map side first."""
    return df.select(F.explode(pieces(F.col(text))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def alphabet(counts: DataFrame) -> DataFrame:
    """(symbol, n) of the characters of counted pieces."""
    return counts.select(F.explode(F.filter(F.split("piece", ""), lambda c: c != "")).alias("symbol"), "n").groupBy("symbol").agg(F.sum("n").alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """(left_symbol, right_symbol, n) of neighbouring characters in counted pieces: what the first merge chooses from."""
    chars = F.filter(F.split("piece", ""), lambda c: c != "")
    pairs = F.filter(F.transform(chars, lambda c, i: F.struct(c.alias("l"), F.get(chars, i + 1).alias("r"))), lambda p: p["r"].isNotNull())
    return counts.select(F.explode(pairs).alias("p"), "n").groupBy(F.col("p.l").alias("left_symbol"), F.col("p.r").alias("right_symbol")).agg(F.sum("n").alias("n"))
