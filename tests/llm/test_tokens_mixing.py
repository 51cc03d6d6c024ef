import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sahifa.llm import mixing, tokens
from sahifa.llm.queries import once


def tables(spark, data):
    return spark.read.parquet(f"{data}/tokenizer_vocab.parquet"), spark.read.parquet(f"{data}/tokenizer_merges.parquet")


def test_counts_are_those_of_the_whole_encoding(spark, data):
    tk = pytest.importorskip("tokenizers")
    vocab, merges = tables(spark, data)
    v, m = tokens.tokenizer_tables(vocab, merges)
    t = tk.Tokenizer(tk.models.BPE(vocab=v, merges=m, unk_token="[UNK]"))
    t.pre_tokenizer = tk.pre_tokenizers.Metaspace()
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a  b ", "a\n\nb c", "▁x▁y", "[PAD] x", "日本", "x" * 5000, None]
    df = spark.createDataFrame([(i, x, 1, "y") for i, x in enumerate(texts)], "id bigint, text string, tokens int, lang string")
    got = {r.id: r.tokens for r in tokens.count_tokens(df, vocab, merges, ["id"]).collect()}
    for i, x in enumerate(texts):
        assert got[i] == (0 if not x else len(t.encode(x, add_special_tokens=False).ids)), x


def test_one_tokenizer_per_process(spark, data):
    import os

    import pyarrow as pa

    vocab, merges = tables(spark, data)
    df = spark.range(400).repartition(12).select("id", F.lit("a b c").alias("text"))
    tokens.count_tokens(df, vocab, merges, ["id"]).count()
    tokens.count_tokens(df, vocab, merges, ["id"]).write.format("noop").mode("overwrite").save()
    tokens.count_tokens(df, vocab, merges, ["id"]).write.format("noop").mode("overwrite").save()

    def ask(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([tokens.built()])], names=["pid", "built"])

    rows = spark.range(400).repartition(12).mapInArrow(ask, "pid bigint, built bigint").collect()
    assert max(r.built for r in rows) == 1


def test_budget_cube(spark):
    rows = [("t", "a", "ar", "x", 5), ("t", "a", "en", None, 7), ("t", None, "ar", "x", 1), ("u", "a", "ar", "x", 2)]
    df = spark.createDataFrame(rows, "src_table string, source string, lang string, category string, tokens bigint")
    got = {(r.src_table, r.source, r.lang, r.category): (r.documents, r.tokens) for r in tokens.budget(df).collect()}
    assert got["t", None, None, None] == (3, 13)
    assert got["t", "a", None, None] == (2, 12)
    assert got["t", "(none)", "ar", "x"] == (1, 1)
    assert got["t", None, "ar", "x"] == (2, 6)
    assert got["u", None, None, "x"] == (1, 2)
    assert tokens.budget(df.limit(0)).count() == 0


def test_source_totals():
    assert np.allclose(mixing.source_totals(np.array([0.5, 0.3, 0.2]), np.array([100.0, 100, 100]), 100), [50, 30, 20])
    assert np.allclose(mixing.source_totals(np.array([0.5, 0.3, 0.2]), np.array([100.0, 100, 10]), 100), [56.25, 33.75, 10])
    assert np.allclose(mixing.source_totals(np.array([0.5, 0.5]), np.array([10.0, 20]), 100), [10, 20])
    assert np.allclose(mixing.source_totals(np.array([0.5, 0.5]), np.array([0.0, 20]), 10), [0, 10])


def test_rake_meets_all_marginals():
    rng = np.random.default_rng(0)
    t = rng.uniform(1, 10, 24)
    axes = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(2), 3), 4), np.tile(np.arange(3), 8)]
    targets = []
    w0 = rng.uniform(0.5, 2, 24)
    for a, n in zip(axes, (4, 2, 3)):
        targets.append(np.bincount(a, w0 * t, n))
    w, rested = mixing.rake(t, np.full(24, 100.0), axes, targets)
    assert rested
    for a, g in zip(axes, targets):
        assert np.allclose(np.bincount(a, w * t, len(g)), g, rtol=1e-5)
    capped, _ = mixing.rake(t, np.full(24, 1.0), axes, targets)
    assert (capped <= 1).all()


def counts(spark, n=4000):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        s = rnd.choices(["big", " Big ", "mid", "small", None, "other"], [60, 5, 25, 2, 4, 4])[0]
        rows.append((i, s, rnd.choice(["ar", "en"]), rnd.choice(["x", "y", None]), rnd.randint(50, 150), 1.0, 9))
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, category string, tokens bigint, weight double, copies int")


def test_mix_reaches_its_shares(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 2), ("small", 0.05, 3), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    m, goals = mixing.mix(counts(spark), targets)
    rows = {(r.axis, r.value): r for r in mixing.reached(m, goals).collect()}
    shares = {v: r for (a, v), r in rows.items() if a == "source"}
    assert set(shares) == {"big", "mid", "small", "absent"} and {v for a, v in rows if a == "lang"} == {"ar", "en"} and {v for a, v in rows if a == "topic"} == {"x", "y", "(none)"}
    assert shares["absent"].tokens == 0 and shares["absent"].wanted_share == 0
    assert abs(shares["big"].reached_share / shares["mid"].reached_share - 1.25) < 0.06
    assert all(r.most_used <= r.max_repeats for r in shares.values())
    assert all(abs(r.reached_share - r.planned_share) < 0.03 for r in rows.values())
    assert all(r.met == (abs(r.planned_share / r.wanted_share - 1) <= 0.0011 if r.wanted_share else True) for r in rows.values())
    for axis in ("source", "lang", "topic"):
        own = [r for (a, _), r in rows.items() if a == axis]
        assert abs(sum(r.reached_share for r in own) - 1) < 1e-4 and abs(sum(r.wanted_share for r in own) - 1) < 1e-4
    assert m.where("source not in ('big', 'mid', 'small')").count() == 0
    assert m.count() == m.select("doc_id").distinct().count()
    twice = counts(spark).unionByName(counts(spark)).repartition(7)
    again = {(r.doc_id, r.copies) for r in mixing.mix(twice, targets)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in m.collect()}
    assert again == {(r.doc_id, r.copies) for r in mixing.mix(counts(spark), targets, unique=True)[0].collect()}


def test_a_marginal_that_caps_forbid_is_reported(spark):
    rows = [(i, s, lang, None, 10) for i, (s, lang) in enumerate([("a", "ar")] * 10 + [("b", "en")] * 90)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, category string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {(r.axis, r.value): r for r in mixing.reached(*mixing.mix(df, targets, total=100.0)).collect()}
    assert not got["lang", "ar"].met and got["lang", "ar"].residual > 1
    assert got["source", "a"].target_share == 0.5


def test_cells_beyond_the_bound_raise(spark, monkeypatch):
    """Cells of sources without a target do not count and do not hide that too many others are there."""
    rows = [(i, "other", "ar", f"t{i}", 10) for i in range(6)] + [(10 + i, "big", "ar", f"t{i}", 10) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, category string, tokens bigint").coalesce(1)
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(mixing, "CELL_BOUND", 6)
    assert mixing.mix(df, targets)[0].count() == 6
    monkeypatch.setattr(mixing, "CELL_BOUND", 5)
    with pytest.raises(ValueError):
        mixing.mix(df, targets)
    monkeypatch.setattr(mixing, "SOURCE_BOUND", 0)
    with pytest.raises(ValueError):
        mixing.mix(df, targets)


def test_marginals_are_kept(spark):
    targets = spark.createDataFrame([("big", 0.5, 9), ("mid", 0.5, 9)], "source string, target_share double, max_repeats int")
    m, _ = mixing.mix(counts(spark), targets)
    by = {r.lang: r.t for r in m.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    assert abs(by["ar"] / (by["ar"] + by["en"]) - 0.5) < 0.05


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("big", 1.0, 1), (None, 0.5, 1), ("mid", None, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(counts(spark).limit(0), targets)[0].count() == 0
    assert mixing.mix(counts(spark), targets.limit(0))[0].count() == 0
    assert {r.source for r in mixing.mix(counts(spark), targets)[0].select("source").distinct().collect()} == {"big"}
    zero = counts(spark).withColumn("tokens", F.lit(0).cast("bigint"))
    assert mixing.mix(zero, targets)[0].where("copies > 1").count() == 0


def test_rows_without_a_key_all_stay(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, None)], "k int, v string")
    assert once(df, ["k"]).count() == 4
    assert once(df, ["k", "v"]).count() == 4
