"""Queries over the training-data problems; __spark_entry__ adds them if this subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.corpus import encoding_sql
from ..runtime import table
from . import leaks as _leaks, lookalikes as _lookalikes, mixing as _mixing, near as _near, pairs as _pairs, quality as _quality, reading as _reading, tokens as _tokens


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows delivered twice count once; rows with a null key are told apart by nothing and all stay."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    own = F.when(known, F.lit(-1).cast("bigint")).otherwise(F.monotonically_increasing_id())
    return df.withColumn("__own", own).dropDuplicates([*keys, "__own"]).drop("__own")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of problem 3: train_phase_1.text and egyptian_figures_data.summary."""
    train = table(spark, d, "train_phase_1").select(F.lit("train_phase_1").alias("src_table"), "rec_id", "text")
    figures = table(spark, d, "egyptian_figures_data").select(F.lit("egyptian_figures_data").alias("src_table"), F.col("figure_id").alias("rec_id"), F.col("summary").alias("text"))
    return train.unionByName(figures)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs.defective_pairs(table(spark, d, "output_dataset"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _quality.not_prose(texts(spark, d))


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _quality.quality(texts(spark, d))


def counted(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of train_phase_1.text and output_dataset.article, one row per record."""
    train = table(spark, d, "train_phase_1").select(F.lit("train_phase_1").alias("src_table"), "rec_id", "source", F.lit(None).cast("string").alias("category"), "text")
    articles = table(spark, d, "output_dataset").select(F.lit("output_dataset").alias("src_table"), "rec_id", F.lit("output_dataset").alias("source"), "category", F.col("article").alias("text"))
    rows = train.unionByName(articles)
    keys = ["src_table", "rec_id", "source", "category"]
    counts = _tokens.count_tokens(rows, table(spark, d, "tokenizer_vocab"), table(spark, d, "tokenizer_merges"), keys)
    named = counts.select("src_table", "rec_id", _tokens.name_key(F.col("source")).alias("source"), _tokens.name_key(F.col("category")).alias("category"), "lang", "tokens")
    return once(named, ["src_table", "rec_id"])


def p4_tokens(spark: SparkSession, d: str) -> DataFrame:
    return counted(spark, d)


def p4_budget(spark: SparkSession, d: str) -> DataFrame:
    return _tokens.budget(counted(spark, d))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts = _tokens.count_tokens(table(spark, d, "documents"), table(spark, d, "tokenizer_vocab"), table(spark, d, "tokenizer_merges"), ["doc_id", "source", "category"])
    return _mixing.mix(counts, table(spark, d, "mix_targets"), unique=True)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixing.reached(*_mix(spark, d))


def values(spark: SparkSession, d: str) -> DataFrame:
    """The values of problem 5, one row each."""
    train = table(spark, d, "train_phase_1")
    figures = table(spark, d, "egyptian_figures_data")
    parts = [(train, "train_phase_1", "rec_id", "text"), (train, "train_phase_1", "rec_id", "title"), (figures, "egyptian_figures_data", "figure_id", "name")]
    rows = [t.select(F.lit(n).alias("src_table"), F.col(k).alias("rec_id"), F.lit(f).alias("field"), F.col(f).alias("value")) for t, n, k, f in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _lookalikes.changed_values(values(spark, d))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return once(_lookalikes.consistent_forms(values(spark, d)), ["src_table", "rec_id", "field"])


_SOURCES = {0: "train_phase_1", 1: "output_dataset"}


def records(spark: SparkSession, d: str) -> DataFrame:
    """The texts of problem 6: train_phase_1.text and output_dataset.article."""
    train = table(spark, d, "train_phase_1").select(F.lit(0).alias("src"), "rec_id", "text")
    articles = table(spark, d, "output_dataset").select(F.lit(1).alias("src"), "rec_id", F.col("article").alias("text"))
    return train.unionByName(articles)


def _named(df: DataFrame) -> DataFrame:
    name = F.element_at(F.create_map(*[F.lit(x) for kv in _SOURCES.items() for x in kv]), F.col("src"))
    return df.select(name.alias("src_table"), *[c for c in df.columns if c != "src"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = _near.near_records(records(spark, d), k=3, t=0.6, least_words=20)
    return _named(_near.record_pairs(pairs, members))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = _near.near_records(records(spark, d))
    return _named(_near.groups(pairs, members))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    levels = _reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_samples"))
    return levels.select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return _reading.level_profile(_reading.reading_levels(docs, table(spark, d, "reading_samples")), docs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p3_found, p3_statistics, p4_tokens, p4_budget, p5_found, p5_forms, p6_found, p6_groups, p7_found, p8_mix, p8_shares, p9_found, p9_profile)}
def _words_sql(c: str) -> str:
    """The words of text.words(): composed, without marks and invisible characters, digits and variants of alef and yaa folded."""
    t = f"regexp_replace(nfc_normalize({c}), '" + r"[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{610}-\x{61A}\x{640}\x{64B}-\x{65F}\x{670}\x{6D6}-\x{6ED}]" + "', '', 'g')"
    return f"regexp_extract_all(translate(lower({t}), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹أإآٱىیک', '01234567890123456789اااايي' || 'ك'), '" + r"[\p{L}\p{N}]+" + "')"


def _spans_sql(key: str, source: str) -> str:
    return f"SELECT {key}, array_to_string(w[n : n + 14], ' ') AS span FROM (SELECT {key}, w, unnest(range(1, len(w) - 13)) AS n FROM (SELECT {key}, {_words_sql('text')} AS w FROM {source} WHERE text IS NOT NULL))"


def _name_sql(c: str) -> str:
    return "nullif(regexp_replace(lower(trim(" + c + r")), '[\s\-]+', '_', 'g'), '')"


_AR, _LA = ("len(coalesce(regexp_replace(text, '[^" + x + "]', '', 'g'), ''))" for x in ("ء-يٮ-ۓ", "A-Za-zÀ-ɏ"))
_RECORDS = f"""SELECT src_table, rec_id, text, {_name_sql('source')} AS source, {_name_sql('category')} AS category, CASE WHEN {_AR} = 0 AND {_LA} = 0 THEN 'none' WHEN {_AR} >= {_LA} THEN 'ar' ELSE 'en' END AS lang
 FROM (SELECT DISTINCT 'train_phase_1' AS src_table, rec_id, source, NULL::VARCHAR AS category, text FROM train_phase_1 UNION ALL SELECT DISTINCT 'output_dataset', rec_id, 'output_dataset', category, article FROM output_dataset)"""
_TOKENS = f"""WITH {encoding_sql("SELECT src_table, rec_id, text FROM (" + _RECORDS + ") WHERE text IS NOT NULL", "src_table, rec_id")}, r AS ({_RECORDS}),
 k AS (SELECT r.src_table, r.rec_id, source, category, lang, coalesce(tokens, 0)::BIGINT AS tokens FROM r LEFT JOIN (SELECT src_table, rec_id, sum(len(tokens)) AS tokens FROM p JOIN e USING (piece) GROUP BY 1, 2) c ON c.src_table = r.src_table AND c.rec_id = r.rec_id)"""
_CELLS = "SELECT src_table, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(category, '(none)') AS category, tokens FROM k"

SQL: dict[str, str] = {
    "p4_tokens": f"{_TOKENS} SELECT src_table, rec_id, source, category, lang, tokens FROM k",
    "p4_budget": f"{_TOKENS} SELECT src_table, source, lang, category, count(*) AS documents, sum(tokens)::BIGINT AS tokens FROM ({_CELLS}) GROUP BY src_table, CUBE (source, lang, category)",
    "p7_found": f"SELECT DISTINCT doc_id, item_id FROM ({_spans_sql('doc_id', 'documents')}) JOIN ({_spans_sql('item_id', 'eval_items')}) USING (span)",
}
