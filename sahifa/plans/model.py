"""Queries over embeddings: lookup, positions and causal attention. A label is a sequence, the order of vec_id its positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import attention as att
from ..runtime import table

WIDTH, HEADS = 64, 8
SIZE = WIDTH // HEADS


def _weights(a: int, b: int, rows: int = WIDTH, cols: int = WIDTH) -> F.Column:
    """Weights by a formula, as a layer would supply them."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda j: F.pmod(i * a + j * b, F.lit(17)).cast("double") / 16 - 0.5))


def _weights_sql(a: int, b: int) -> str:
    return f"list_transform(range(0, {WIDTH}), lambda i: list_transform(range(0, {WIDTH}), lambda j: ((i * {a} + j * {b}) % 17)::DOUBLE / 16 - 0.5))"


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("embedding is not null")
    pos = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int")
    return e.select(F.col("label").cast("bigint").alias("seq_id"), pos.alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


_SEQ = "SELECT label::BIGINT AS seq_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS pos, embedding::DOUBLE[] AS vec FROM embeddings WHERE embedding IS NOT NULL"


def _rows(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """One row per component, rounded, to compare."""
    return df.select(*keys, F.posexplode(vec).alias("i", "x")).select(*keys, "i", F.round("x", 6).alias("x"))


def q34_token_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the embedding table for sequences of token ids; token 0 is the padding row, all zeros."""
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("token_id"), F.transform("embedding", lambda x: F.when(F.col("vec_id") == 0, 0.0).otherwise(x.cast("double"))).alias("vec"))
    tokens = e.select(F.col("label").cast("bigint").alias("seq_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int").alias("pos"), F.col("vec_id").alias("token_id"))
    return _rows(att.embed(tokens, rows), ["seq_id", "pos"])


SQL_Q34 = "SELECT seq_id, pos, (i - 1)::INTEGER AS i, round(CASE WHEN vec_id = 0 THEN 0 ELSE embedding[i]::DOUBLE END, 6) AS x FROM (SELECT label::BIGINT AS seq_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS pos, vec_id, embedding FROM embeddings), (SELECT unnest(range(1, 65)) AS i)"


def q35_position_add(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("token_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    tokens = e.select(F.col("label").cast("bigint").alias("seq_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int").alias("pos"), F.col("vec_id").alias("token_id"))
    longest = 4096
    positions = spark.range(longest).select(F.col("id").cast("int").alias("pos"), F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda j: F.pmod(F.col("id") * 31 + j * 17, F.lit(101)).cast("double") / 101).alias("vec"))
    return _rows(att.embed(tokens, rows, positions, longest), ["seq_id", "pos"])


SQL_Q35 = f"SELECT seq_id, pos, (i - 1)::INTEGER AS i, round(vec[i] + ((pos * 31 + (i - 1) * 17) % 101)::DOUBLE / 101, 6) AS x FROM ({_SEQ}), (SELECT unnest(range(1, 65)) AS i)"


def q36_qkv_heads(spark: SparkSession, d: str) -> DataFrame:
    h = att.heads(_sequences(spark, d), HEADS, WIDTH, _weights(3, 5), _weights(7, 2), _weights(4, 9))
    long = h.select("seq_id", "pos", "head", F.posexplode(F.arrays_zip("q", "k", "v")).alias("i", "z"))
    return long.select("seq_id", "pos", "head", "i", *[F.round(f"z.{c}", 6).alias(c) for c in "qkv"])


def _projected(a: int, b: int) -> str:
    return f"list_transform({_weights_sql(a, b)}, lambda r: list_dot_product(r, vec))"


SQL_Q36 = f"""SELECT seq_id, pos, ((n - 1) // {SIZE})::INTEGER AS head, ((n - 1) % {SIZE})::INTEGER AS i, round(q[n], 6) AS q, round(k[n], 6) AS k, round(v[n], 6) AS v FROM (SELECT seq_id, pos, unnest(range(1, 65)) AS n, q, k, v
 FROM (SELECT seq_id, pos, {_projected(3, 5)} AS q, {_projected(7, 2)} AS k, {_projected(4, 9)} AS v FROM ({_SEQ})))"""


def _plain_heads(spark: SparkSession, d: str) -> DataFrame:
    return att.heads(_sequences(spark, d), HEADS, WIDTH, None, None, None)


_HEADS = f"SELECT seq_id, pos, h::INTEGER AS head, vec[h * {SIZE} + 1 : (h + 1) * {SIZE}] AS v FROM ({_SEQ}), (SELECT unnest(range(0, {HEADS})) AS h)"
_SCORES = f"SELECT a.seq_id, a.head, a.pos AS q_pos, b.pos AS k_pos, list_dot_product(a.v, b.v) / sqrt({SIZE}.0) AS score, b.v FROM h a JOIN h b ON a.seq_id = b.seq_id AND a.head = b.head AND b.pos <= a.pos"
_WEIGHTS = "SELECT *, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY seq_id, head, q_pos) AS weight FROM (SELECT *, max(score) OVER (PARTITION BY seq_id, head, q_pos) AS m FROM s)"
_WITH = f"WITH h AS ({_HEADS}), s AS ({_SCORES}), w AS ({_WEIGHTS})"


def q37_scores_causal(spark: SparkSession, d: str) -> DataFrame:
    return att.scores(_plain_heads(spark, d)).withColumn("score", F.round("score", 6))


SQL_Q37 = f"WITH h AS ({_HEADS}), s AS ({_SCORES}) SELECT seq_id, head, q_pos, k_pos, round(score, 6) AS score FROM s"


def q38_attn_weights(spark: SparkSession, d: str) -> DataFrame:
    return att.weights(att.scores(_plain_heads(spark, d))).withColumn("weight", F.round("weight", 6))


SQL_Q38 = f"{_WITH} SELECT seq_id, head, q_pos, k_pos, round(weight, 6) AS weight FROM w"


def q39_attended(spark: SparkSession, d: str) -> DataFrame:
    h = _plain_heads(spark, d)
    return _rows(att.attended(att.weights(att.scores(h)), h, SIZE), ["seq_id", "head", "q_pos"])


SQL_Q39 = f"{_WITH} SELECT seq_id, head, q_pos, (i - 1)::INTEGER AS i, round(sum(weight * v[i]), 6) AS x FROM w, (SELECT unnest(range(1, {SIZE + 1})) AS i) GROUP BY 1, 2, 3, 4"


def q40_mha_output(spark: SparkSession, d: str) -> DataFrame:
    bias = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda j: j.cast("double") / 64)
    return _rows(att.attention(_sequences(spark, d), HEADS, WIDTH, wo=_weights(5, 11), bias=bias), ["seq_id", "pos"])


_OUT = "SELECT seq_id, q_pos, list(x ORDER BY head, i) AS vec FROM a GROUP BY 1, 2"
SQL_Q40 = f"""{_WITH}, a AS (SELECT seq_id, head, q_pos, i, sum(weight * v[i]) AS x FROM w, (SELECT unnest(range(1, {SIZE + 1})) AS i) GROUP BY 1, 2, 3, 4), o AS ({_OUT}), p AS (SELECT seq_id, q_pos, {_projected(5, 11)} AS out FROM o)
 SELECT seq_id, q_pos AS pos, (n - 1)::INTEGER AS i, round(out[n] + (n - 1)::DOUBLE / 64, 6) AS x FROM p, (SELECT unnest(range(1, 65)) AS n)"""


def q41_padding_mask(spark: SparkSession, d: str) -> DataFrame:
    """Padding on every third place and on the whole start of the even sequences, whose first rows see no key and give the bias."""
    x = _sequences(spark, d)
    valid = x.where((F.col("pos") % 3 != 2) & ((F.col("seq_id") % 2 == 1) | (F.col("pos") >= 4))).select("seq_id", "pos")
    bias = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda j: j.cast("double") / 64)
    return _rows(att.attention(x, HEADS, WIDTH, bias=bias, wo=_weights(5, 11), valid=valid), ["seq_id", "pos"])


_MASKED = _SCORES + " AND b.pos % 3 <> 2 AND (b.seq_id % 2 = 1 OR b.pos >= 4)"
SQL_Q41 = f"""WITH h AS ({_HEADS}), s AS ({_MASKED}), w AS ({_WEIGHTS}), g AS (SELECT seq_id, head, pos AS q_pos, i FROM h, (SELECT unnest(range(1, {SIZE + 1})) AS i)),
 a AS (SELECT g.seq_id, g.head, g.q_pos, g.i, coalesce(sum(weight * v[g.i]), 0) AS x FROM g LEFT JOIN w ON w.seq_id = g.seq_id AND w.head = g.head AND w.q_pos = g.q_pos GROUP BY 1, 2, 3, 4), o AS ({_OUT}), p AS (SELECT seq_id, q_pos, {_projected(5, 11)} AS out FROM o)
 SELECT seq_id, q_pos AS pos, (n - 1)::INTEGER AS i, round(out[n] + (n - 1)::DOUBLE / 64, 6) AS x FROM p, (SELECT unnest(range(1, 65)) AS n)"""

QUERIES = {f.__name__: f for f in (q34_token_embedding, q35_position_add, q36_qkv_heads, q37_scores_causal, q38_attn_weights, q39_attended, q40_mha_output, q41_padding_mask)}
SQL = {"q34_token_embedding": SQL_Q34, "q35_position_add": SQL_Q35, "q36_qkv_heads": SQL_Q36, "q37_scores_causal": SQL_Q37, "q38_attn_weights": SQL_Q38, "q39_attended": SQL_Q39, "q40_mha_output": SQL_Q40, "q41_padding_mask": SQL_Q41}
