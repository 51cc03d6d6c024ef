"""Embedding lookup and causal multi-head attention as relations: (seq_id, pos, vec array<double>)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def matrix(rows: list[list[float]]) -> Column:
    """Weights as a literal: they are part of the plan, as small as the layer."""
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def project(vec: Column, weights: Column, bias: Column | None = None) -> Column:
    """weights x vec (+ bias); weights is an array of rows."""
    out = F.transform(weights, lambda row: dot(row, vec))
    return out if bias is None else add(out, bias)


def embed(tokens: DataFrame, table: DataFrame, positions: DataFrame | None = None, max_length: int | None = None) -> DataFrame:
    """(seq_id, pos, vec) of tokens(seq_id, pos, token_id): rows of table(token_id, vec), plus those of positions(pos, vec).

    A token or a position without a row raises, as does a position beyond max_length.
    """
    found = tokens.join(table.select("token_id", F.col("vec").alias("__t")), "token_id", "left")
    if max_length is not None:
        found = found.withColumn("pos", F.when(F.col("pos") < max_length, F.col("pos")).otherwise(F.raise_error(F.concat(F.lit("position beyond the longest sequence: "), F.col("pos").cast("string"))).cast("int")))
    vec = F.coalesce(F.col("__t"), F.raise_error(F.concat(F.lit("no embedding for token "), F.col("token_id").cast("string"))).cast("array<double>"))
    found = found.withColumn("vec", vec)
    if positions is None:
        return found.select("seq_id", "pos", "vec")
    placed = F.coalesce(F.col("__p"), F.raise_error(F.concat(F.lit("no embedding for position "), F.col("pos").cast("string"))).cast("array<double>"))
    return found.join(positions.select("pos", F.col("vec").alias("__p")), "pos", "left").select("seq_id", "pos", add(F.col("vec"), placed).alias("vec"))


def initial_embeddings(spark: SparkSession, tokens: int, width: int, std: float = 0.02, seed: int = 0, pad: int | None = 0) -> DataFrame:
    """table(token_id, vec) of normal numbers fixed by seed and place, however the rows are partitioned; the padding row is zeros."""
    def uniform(j: Column, salt: int) -> Column:
        h = F.pmod(F.xxhash64(F.col("token_id"), j, F.lit(seed), F.lit(salt)), F.lit(1 << 52))
        return (h + 0.5) / F.lit(float(1 << 52))

    def normal(j: Column) -> Column:
        return F.sqrt(-2 * F.log(uniform(j, 1))) * F.cos(2 * F.pi() * uniform(j, 2)) * std

    ids = spark.range(tokens).select(F.col("id").alias("token_id"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), normal)
    zero = F.array_repeat(F.lit(0.0), width)
    return ids.select("token_id", vec.alias("vec") if pad is None else F.when(F.col("token_id") == pad, zero).otherwise(vec).alias("vec"))


def heads(x: DataFrame, n_heads: int, width: int, wq: Column | None, wk: Column | None, wv: Column | None) -> DataFrame:
    """(seq_id, pos, head, q, k, v): projections (null weights: the vector itself) cut into heads."""
    if width % n_heads:
        raise ValueError("the width must be a multiple of the heads")
    size = width // n_heads

    def cut(c: Column) -> Column:
        return F.slice(c, F.col("head") * size + 1, F.lit(size))

    v = F.col("vec")
    full = x.select("seq_id", "pos", *[(v if w is None else project(v, w)).alias(n) for n, w in (("fq", wq), ("fk", wk), ("fv", wv))])
    each = full.withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(n_heads - 1))))
    return each.select("seq_id", "pos", "head", cut(F.col("fq")).alias("q"), cut(F.col("fk")).alias("k"), cut(F.col("fv")).alias("v"))


def scores(h: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """(seq_id, head, q_pos, k_pos, score): scaled products of each query with the keys up to its place.

    valid(seq_id, pos): the keys that count; padding masks keys, never queries. Joined on sequence and head, so the work
    is quadratic in a sequence only.
    """
    keys = h.select("seq_id", "head", F.col("pos").alias("k_pos"), "k")
    if valid is not None:
        keys = keys.join(valid.select("seq_id", F.col("pos").alias("k_pos")), ["seq_id", "k_pos"], "left_semi")
    queries = h.select("seq_id", "head", F.col("pos").alias("q_pos"), "q")
    pairs = queries.join(keys, ["seq_id", "head"]).where("k_pos <= q_pos")
    return pairs.select("seq_id", "head", "q_pos", "k_pos", (dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q").cast("double"))).alias("score"))


def weights(s: DataFrame) -> DataFrame:
    """scores with weight: the softmax over the keys of each query."""
    from pyspark.sql import Window

    w = Window.partitionBy("seq_id", "head", "q_pos")
    e = s.withColumn("__e", F.exp(F.col("score") - F.max("score").over(w)))
    return e.select("seq_id", "head", "q_pos", "k_pos", (F.col("__e") / F.sum("__e").over(w)).alias("weight"))


def attended(w: DataFrame, h: DataFrame, size: int) -> DataFrame:
    """(seq_id, head, q_pos, vec): weighted sums of values, one per query row of h; zeros for one without any key.

    Each component is summed as a column of its own, so partial sums meet before the shuffle.
    """
    values = h.select("seq_id", "head", F.col("pos").alias("k_pos"), "v")
    sums = w.join(values, ["seq_id", "head", "k_pos"]).groupBy("seq_id", "head", "q_pos").agg(*[F.sum(F.col("weight") * F.get("v", F.lit(i))).alias(f"__{i}") for i in range(size)])
    vec = sums.select("seq_id", "head", "q_pos", F.array(*[F.col(f"__{i}") for i in range(size)]).alias("vec"))
    zeros = F.array(*[F.lit(0.0)] * size)
    every = h.select("seq_id", "head", F.col("pos").alias("q_pos"))
    return every.join(vec, ["seq_id", "head", "q_pos"], "left").select("seq_id", "head", "q_pos", F.coalesce("vec", zeros).alias("vec"))


def joined_heads(a: DataFrame, wo: Column | None = None, bias: Column | None = None) -> DataFrame:
    """(seq_id, pos, vec): heads put together in order and projected."""
    whole = a.groupBy("seq_id", F.col("q_pos").alias("pos")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("head", "vec"))), lambda x: x["vec"])).alias("vec"))
    return whole.select("seq_id", "pos", (F.col("vec") if wo is None else project(F.col("vec"), wo, bias)).alias("vec"))


def attention(x: DataFrame, n_heads: int, width: int, wq: Column | None = None, wk: Column | None = None, wv: Column | None = None, wo: Column | None = None, bias: Column | None = None, valid: DataFrame | None = None) -> DataFrame:
    """Causal multi-head self-attention of (seq_id, pos, vec); dropout is the identity. A query without a valid key gives the bias."""
    h = heads(x, n_heads, width, wq, wk, wv)
    return joined_heads(attended(weights(scores(h, valid)), h, width // n_heads), wo, bias)


