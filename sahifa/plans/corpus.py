"""Queries over the tokenizer's corpus: normalising, filtering, counting, training, encoding and its quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import normalize_arabic, reduction_percent
from ..operators import bpe, corpus
from ..runtime import table
from .pages import _TRIM, normal_text_sql

#: Texts that show the edges of the rules; the SQL has the same rows.
LITERAL_TEXTS = ["أَنْتَ", "على", "a   b\n \n\n\nc", "a ‌ b", "x—y…", "ٰa", "a\n  b", "  ", "كـــتاب"]
#: Size and least frequency of the vocabulary that is trained here, as in the reference.
VOCAB, LEAST = 32_000, 5


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_phase_1").where("text is not null").groupBy("rec_id").agg(F.min(F.struct("title", "text")).alias("m")).select("rec_id", "m.title", "m.text")


def q21_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    literal = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(LITERAL_TEXTS)], "rec_id bigint, text string")
    return _texts(spark, d).select("rec_id", "text").unionByName(literal).select("rec_id", normalize_arabic(F.col("text")).alias("normal"))


_TEXTS = "SELECT rec_id, any_value(title) AS title, any_value(text) AS text FROM train_phase_1 WHERE text IS NOT NULL GROUP BY 1"
_LITERAL = ", ".join(f"({-i - 1}, " + " || ".join("chr(" + str(ord(c)) + ")" for c in t) + ")" for i, t in enumerate(LITERAL_TEXTS))
SQL_Q21 = f"SELECT rec_id::BIGINT AS rec_id, {normal_text_sql('text')} AS normal FROM (SELECT rec_id, text FROM ({_TEXTS}) UNION ALL SELECT * FROM (VALUES {_LITERAL}) t(rec_id, text))"


def q22_normalize_stats(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d).select("rec_id", "text", normalize_arabic(F.col("text")).alias("normal"))
    return t.select("rec_id", F.length("text").alias("before"), F.length("normal").alias("after"), F.round(reduction_percent(F.col("text"), F.col("normal")), 6).alias("saved_percent"))


SQL_Q22 = f"SELECT rec_id, len(text)::INTEGER AS before, len(n)::INTEGER AS after, round(CASE WHEN len(text) > 0 THEN (len(text) - len(n)) * 100.0::DOUBLE / len(text) END, 6) AS saved_percent FROM (SELECT rec_id, text, {normal_text_sql('text')} AS n FROM ({_TEXTS}))"


def q23_corpus_filter(spark: SparkSession, d: str) -> DataFrame:
    return corpus.training_texts(_texts(spark, d)).select("rec_id", "text")


_T, _H = _TRIM.format("coalesce(text, '')"), _TRIM.format("coalesce(title, '')")
SQL_Q23 = f"SELECT rec_id, CASE WHEN len(h) > 10 THEN h || chr(10) || chr(10) || t ELSE t END AS text FROM (SELECT rec_id, {_T} AS t, {_H} AS h FROM ({_TEXTS})) WHERE len(t) >= 50"


def q24_corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    return corpus.totals(q23_corpus_filter(spark, d))


SQL_Q24 = f"SELECT count(*) AS documents, coalesce(sum(len(text)), 0)::BIGINT AS characters FROM ({SQL_Q23})"


def q25_word_freq(spark: SparkSession, d: str) -> DataFrame:
    return corpus.piece_counts(q23_corpus_filter(spark, d))


_MARKED = "CASE WHEN starts_with(m, '▁') OR m = '' THEN m ELSE '▁' || m END"
SQL_Q25 = f"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_MARKED}, '(?s)▁[^▁]*|[^▁]+')) AS piece FROM (SELECT replace(text, ' ', '▁') AS m FROM ({SQL_Q23}))) GROUP BY 1"


def q26_alphabet(spark: SparkSession, d: str) -> DataFrame:
    return corpus.alphabet(q25_word_freq(spark, d))


SQL_Q26 = f"SELECT symbol, sum(n)::BIGINT AS n FROM (SELECT unnest(list_transform(range(1, len(piece) + 1), lambda i: substring(piece, i, 1))) AS symbol, n FROM ({SQL_Q25})) GROUP BY 1"


def q27_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.pair_counts(q25_word_freq(spark, d))


SQL_Q27 = f"SELECT p[1] AS left_symbol, p[2] AS right_symbol, sum(n)::BIGINT AS n FROM (SELECT unnest(list_transform(range(1, len(piece)), lambda i: [substring(piece, i, 1), substring(piece, i + 1, 1)])) AS p, n FROM ({SQL_Q25})) GROUP BY 1, 2"


def q28_bpe_vocab(spark: SparkSession, d: str) -> DataFrame:
    return bpe.train(q25_word_freq(spark, d), VOCAB, LEAST)[0]


def q28_bpe_merges(spark: SparkSession, d: str) -> DataFrame:
    return bpe.train(q25_word_freq(spark, d), VOCAB, LEAST)[1]


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(_texts(spark, d), "rec_id", table(spark, d, "tokenizer_vocab"), table(spark, d, "tokenizer_merges"))


def q29_encode(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and ids of every text, in order, under the tokenizer of the tables."""
    return _encoded(spark, d).select("rec_id", F.array_join("tokens", " ").alias("tokens"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


def q30_token_ids(spark: SparkSession, d: str) -> DataFrame:
    """Characters of every title looked up in the vocabulary."""
    t = _texts(spark, d).select("rec_id", F.filter(F.split(F.replace("title", F.lit(" "), F.lit("▁")), ""), lambda c: c != "").alias("tokens"))
    return bpe.token_ids(t, "rec_id", table(spark, d, "tokenizer_vocab"))


SQL_Q30 = f"""SELECT rec_id, (i - 1)::INTEGER AS pos, token, coalesce(id, 1)::INTEGER AS id FROM (SELECT rec_id, i, substring(t, i, 1) AS token FROM (SELECT rec_id, replace(title, ' ', '▁') AS t, unnest(range(1, len(title) + 1)) AS i FROM ({_TEXTS}))) LEFT JOIN tokenizer_vocab v USING (token)"""


def q30_padded_batch(spark: SparkSession, d: str) -> DataFrame:
    """Character ids of every title, filled up to the longest, and how many of them are real."""
    t = _texts(spark, d).where("title is not null").select("rec_id", F.filter(F.split(F.replace("title", F.lit(" "), F.lit("▁")), ""), lambda c: c != "").alias("tokens"))
    ids = bpe.token_ids(t, "rec_id", table(spark, d, "tokenizer_vocab")).groupBy("rec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    p = bpe.padded(ids, "rec_id")
    return p.select("rec_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"), F.size(F.filter("valid", lambda v: v)).alias("real"))


SQL_Q30_PADDED = f"""WITH c AS ({SQL_Q30}), g AS (SELECT rec_id, list(id ORDER BY pos) AS ids FROM c GROUP BY 1), m AS (SELECT max(len(ids)) AS n FROM g)
 SELECT rec_id, array_to_string(list_concat(ids, list_transform(range(0, (n - len(ids))::BIGINT), lambda i: 0)), ' ') AS ids, len(ids)::INTEGER AS real FROM g, m"""


def q31_chars_per_token(spark: SparkSession, d: str) -> DataFrame:
    """Characters a pre-token, by text; null for an empty one."""
    t = _texts(spark, d)
    return t.select("rec_id", F.round(F.try_divide(F.length("text"), F.size(corpus.pieces(F.col("text")))), 6).alias("chars_per_token"))


_PIECES = "regexp_extract_all(CASE WHEN starts_with(replace(text, ' ', '▁'), '▁') OR text = '' THEN replace(text, ' ', '▁') ELSE '▁' || replace(text, ' ', '▁') END, '(?s)▁[^▁]*|[^▁]+')"
SQL_Q31 = f"SELECT rec_id, round(len(text)::DOUBLE / nullif(len({_PIECES}), 0), 6) AS chars_per_token FROM ({_TEXTS})"


def q31_bpe_chars_per_token(spark: SparkSession, d: str) -> DataFrame:
    e = _encoded(spark, d).join(_texts(spark, d).select("rec_id", F.length("text").alias("chars")), "rec_id")
    return e.select("rec_id", F.round(F.try_divide("chars", F.size("tokens")), 6).alias("chars_per_token"))


def q32_token_length_hist(spark: SparkSession, d: str) -> DataFrame:
    return bpe.length_histogram(q25_word_freq(spark, d), "piece")


SQL_Q32 = f"SELECT len(piece)::INTEGER AS length, count(*) AS tokens FROM ({SQL_Q25}) GROUP BY 1"


def q32_bpe_length_hist(spark: SparkSession, d: str) -> DataFrame:
    return bpe.length_histogram(_encoded(spark, d).select(F.explode("tokens").alias("token")))


def q33_lossless(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text comes back from its pre-tokens; one that begins with a space does not."""
    t = _texts(spark, d)
    return t.select("rec_id", (bpe.decode(corpus.pieces(F.col("text"))) == F.col("text")).alias("lossless"))


SQL_Q33 = f"SELECT rec_id, regexp_replace(replace(array_to_string({_PIECES}, ''), '▁', ' '), '^ ', '') = text AS lossless FROM ({_TEXTS})"


def q33_bpe_lossless(spark: SparkSession, d: str) -> DataFrame:
    e = _encoded(spark, d).join(_texts(spark, d), "rec_id")
    return e.select("rec_id", (bpe.decode(F.col("tokens")) == F.col("text")).alias("lossless"))


def encoding_sql(texts: str, keys: str) -> str:
    """CTEs p (keys, i, piece), the pieces of the texts(keys, text) in order, and e (piece, tokens), each distinct piece after its merges.

    A step merges the first of the neighbours with the lowest rank, until no neighbours merge.
    """
    return f"""RECURSIVE p AS (SELECT {keys}, i, q[i] AS piece FROM (SELECT {keys}, q, unnest(range(1, len(q) + 1)) AS i FROM (SELECT {keys}, {_PIECES} AS q FROM ({texts})))),
 h AS (SELECT piece, j, coalesce(token, '[UNK]') AS c FROM (SELECT piece, unnest(range(1, len(piece) + 1)) AS j FROM (SELECT DISTINCT piece FROM p)) LEFT JOIN tokenizer_vocab ON token = substring(piece, j, 1)),
 s AS (SELECT piece, list(c ORDER BY j) AS y, 0 AS n FROM h GROUP BY 1
  UNION ALL SELECT piece, list_concat(list_append(y[1 : (place - 1)], y[place] || y[place + 1]), y[(place + 2) : len(y)]), n + 1 FROM (SELECT piece, y, n, min(struct_pack(r := merge_rank, i := i)).i AS place FROM (SELECT piece, y, n, unnest(range(1, len(y))) AS i FROM s) JOIN tokenizer_merges ON left_token = y[i] AND right_token = y[i + 1] GROUP BY 1, 2, 3)),
 e AS (SELECT piece, arg_max(y, n) AS tokens FROM s GROUP BY 1)"""


_ENCODING = encoding_sql(_TEXTS, "rec_id")
_JOINED = f"WITH {_ENCODING}, v AS (SELECT piece, string_agg(coalesce(id, 1), ' ' ORDER BY j) AS ids FROM (SELECT piece, j, tokens[j] AS token FROM (SELECT piece, tokens, unnest(range(1, len(tokens) + 1)) AS j FROM e)) LEFT JOIN tokenizer_vocab USING (token) GROUP BY 1), t AS ({_TEXTS})"
SQL_Q29 = f"""{_JOINED} SELECT t.rec_id, coalesce(x.tokens, '') AS tokens, coalesce(x.ids, '') AS ids FROM t LEFT JOIN (SELECT rec_id, string_agg(array_to_string(tokens, ' '), ' ' ORDER BY i) AS tokens, string_agg(ids, ' ' ORDER BY i) AS ids FROM p JOIN e USING (piece) JOIN v USING (piece) GROUP BY 1) x ON x.rec_id = t.rec_id"""
_COUNTED = f"WITH {_ENCODING}, t AS ({_TEXTS}), c AS (SELECT rec_id, sum(len(tokens)) AS n, regexp_replace(replace(string_agg(array_to_string(list_filter(tokens, lambda x: x NOT IN ('[PAD]', '[UNK]', '[BOS]', '[EOS]')), ''), '' ORDER BY i), '▁', ' '), '^ ', '') AS back FROM p JOIN e USING (piece) GROUP BY 1)"
SQL_Q31_BPE = f"{_COUNTED} SELECT t.rec_id, round(len(text)::DOUBLE / nullif(n, 0), 6) AS chars_per_token FROM t LEFT JOIN c ON c.rec_id = t.rec_id"
SQL_Q32_BPE = f"WITH {_ENCODING} SELECT len(token)::INTEGER AS length, count(*) AS tokens FROM (SELECT unnest(tokens) AS token FROM p JOIN e USING (piece)) GROUP BY 1"
SQL_Q33_BPE = f"{_COUNTED} SELECT t.rec_id, coalesce(back, '') = text AS lossless FROM t LEFT JOIN c ON c.rec_id = t.rec_id"

QUERIES = {f.__name__: f for f in (q21_normalize_text, q22_normalize_stats, q23_corpus_filter, q24_corpus_totals, q25_word_freq, q26_alphabet, q27_pair_counts, q28_bpe_vocab, q28_bpe_merges, q29_encode, q30_token_ids, q30_padded_batch, q31_chars_per_token, q31_bpe_chars_per_token, q32_token_length_hist, q32_bpe_length_hist, q33_lossless, q33_bpe_lossless)}
SQL = {"q21_normalize_text": SQL_Q21, "q22_normalize_stats": SQL_Q22, "q23_corpus_filter": SQL_Q23, "q24_corpus_totals": SQL_Q24, "q25_word_freq": SQL_Q25, "q26_alphabet": SQL_Q26, "q27_pair_counts": SQL_Q27, "q30_token_ids": SQL_Q30, "q30_padded_batch": SQL_Q30_PADDED, "q31_chars_per_token": SQL_Q31, "q32_token_length_hist": SQL_Q32, "q33_lossless": SQL_Q33, "q29_encode": SQL_Q29, "q31_bpe_chars_per_token": SQL_Q31_BPE, "q32_bpe_length_hist": SQL_Q32_BPE, "q33_bpe_lossless": SQL_Q33_BPE}
