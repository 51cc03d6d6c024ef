"""JSON lines: strict and tolerant reading, appending, and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ARTICLES = "url string, title string, category string, parent_categories array<string>"
FIGURES = "name string, url string, category string, title string, summary string, infobox map<string,string>"
RECORDS = "name string, url string, category string, skip boolean, skip_reason string, title string, article string, qa_pairs array<struct<question:string,answer:string>>"


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line must parse; blank lines are passed over."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_resumed(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): one bad line does not lose what is already there."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad"), spark.read.text(path).where(F.try_parse_json("value").isNull() & (F.trim("value") != ""))


def append(df: DataFrame, path: str) -> None:
    """One object a line, null fields left out, text unescaped."""
    df.write.mode("append").json(path)


def one_article(spark: SparkSession, url: str) -> DataFrame:
    """A single page as an article row."""
    return spark.createDataFrame([(url, None, "N/A", [])], ARTICLES)


def limited(df: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first rows by `order`; 0 or None for all."""
    return df.orderBy(order).limit(most) if most else df


def write_documents(df: DataFrame, path: str) -> None:
    """(filename, markdown) rows as a table; file names are the key."""
    df.select("filename", "markdown").write.mode("append").parquet(path)
