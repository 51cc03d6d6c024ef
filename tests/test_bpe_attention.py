import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sahifa.operators import attention, bpe, corpus
from sahifa.plans import corpus as plans


def sample(seed=1, n=60):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choice("abcdéف") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 30))) + rnd.choice(["", "\nx", " "]) for _ in range(n)]


def public(texts, size, least):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer(tokenizers.models.BPE(unk_token="[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace()
    t.decoder = tokenizers.decoders.Metaspace()
    t.train_from_iterator(texts, tokenizers.trainers.BpeTrainer(vocab_size=size, min_frequency=least, special_tokens=bpe.SPECIALS, show_progress=False))
    return t


def test_training_is_that_of_the_public_package(spark):
    texts = sample()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    vocab, merges = bpe.train(corpus.piece_counts(df), 150, 2)
    t = public(texts, 150, 2)
    assert {r.token: r.id for r in vocab.collect()} == t.get_vocab()
    new = [*sample(2, 20), "zz ab", "", " ab", None]
    enc = {r.id: r for r in bpe.encode(spark.createDataFrame(list(enumerate(new)), "id int, text string"), "id", vocab, merges).collect()}
    for i, x in enumerate(new):
        if x is None:
            assert enc[i].tokens is None
        else:
            assert enc[i].tokens == t.encode(x).tokens, x
    decoded = spark.createDataFrame([(enc[i].tokens,) for i in range(20)], "t array<string>").select(bpe.decode(F.col("t")).alias("d")).collect()
    assert [r.d for r in decoded] == [t.decode(enc[i].ids) for i in range(20)]


def recounted(counts, size, least):
    """The merges, with all pairs counted anew for each."""
    vocab = {t: i for i, t in enumerate([*bpe.SPECIALS, *sorted({c for w in counts for c in w})])}
    words, merges = [(list(w), n) for w, n in counts.items()], []
    while len(vocab) < size:
        total = {}
        for w, n in words:
            for p in zip(w, w[1:]):
                total[p] = total.get(p, 0) + n
        best = min(total, key=lambda p: (-total[p], vocab[p[0]], vocab[p[1]]), default=None)
        if best is None or total[best] < least:
            break
        merges.append(best)
        vocab.setdefault(best[0] + best[1], len(vocab))
        words = [(bpe.merge_piece(w, {best: 0}), n) for w, n in words]
    return vocab, merges


def test_training_by_recounting():
    rnd = random.Random(5)
    for letters in ("ab", "abc", "abcdefgh"):
        counts = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))): rnd.randint(1, 9) for _ in range(150)}
        assert bpe.learn(counts, 120, 2) == recounted(counts, 120, 2)


def test_the_query_trains_with_the_sizes_of_the_reference(spark, data):
    counts = {r.piece: r.n for r in plans.q25_word_freq(spark, data).collect()}
    vocab, merges = bpe.learn(counts, 32_000, 5)
    assert len(merges) > 1000
    assert {r.token: r.id for r in plans.q28_bpe_vocab(spark, data).collect()} == vocab
    assert [(r.left_token, r.right_token) for r in plans.q28_bpe_merges(spark, data).orderBy("merge_rank").collect()] == merges


def test_pieces(spark):
    df = spark.createDataFrame([(x,) for x in ["ab zz", " ab", "ab\ncd", "", "a  b"]], "x string")
    assert [r[0] for r in df.select(corpus.pieces(F.col("x"))).collect()] == [["▁ab", "▁zz"], ["▁ab"], ["▁ab\ncd"], [], ["▁a", "▁", "▁b"]]


def test_training_texts(spark):
    df = spark.createDataFrame([("t" * 11, "x" * 50), ("t" * 10, "x" * 50), (None, "x" * 50), ("t", "x" * 49), ("t", None)], "title string, text string")
    assert sorted(r.text for r in corpus.training_texts(df).collect()) == sorted(["t" * 11 + "\n\n" + "x" * 50, "x" * 50, "x" * 50])


def test_attention_against_numpy(spark):
    rng = np.random.default_rng(0)
    width, n_heads = 8, 2
    x = rng.normal(size=(2, 5, width))
    wq, wk, wv, wo = (rng.normal(size=(width, width)) for _ in range(4))
    bias = rng.normal(size=width)
    valid = np.array([[1, 1, 1, 0, 1], [0, 1, 1, 1, 0]], dtype=bool)
    rows = [(s, p, [float(v) for v in x[s, p]]) for s in range(2) for p in range(5)]
    df = spark.createDataFrame(rows, "seq_id bigint, pos int, vec array<double>")
    mask = spark.createDataFrame([(s, p) for s in range(2) for p in range(5) if valid[s, p]], "seq_id bigint, pos int")
    got = attention.attention(df, n_heads, width, *(attention.matrix(w.tolist()) for w in (wq, wk, wv, wo)), bias=F.array(*[F.lit(float(b)) for b in bias]), valid=mask)
    out = {(r.seq_id, r.pos): np.array(r.vec) for r in got.collect()}
    size = width // n_heads
    for s in range(2):
        q, k, v = (x[s] @ w.T for w in (wq, wk, wv))
        for p in range(5):
            vec = []
            for h in range(n_heads):
                c = slice(h * size, (h + 1) * size)
                keys = [j for j in range(p + 1) if valid[s, j]]
                if not keys:
                    vec.append(np.zeros(size))
                    continue
                e = np.exp(np.array([q[p, c] @ k[j, c] for j in keys]) / np.sqrt(size))
                vec.append((e / e.sum()) @ v[keys][:, c])
            assert np.allclose(out[s, p], wo @ np.concatenate(vec) + bias)


def test_weights_are_causal_and_sum_to_one(spark):
    rows = [(0, p, [float(p), 1.0]) for p in range(4)]
    h = attention.heads(spark.createDataFrame(rows, "seq_id bigint, pos int, vec array<double>"), 1, 2, None, None, None)
    w = attention.weights(attention.scores(h))
    assert w.where("k_pos > q_pos").count() == 0
    assert all(abs(r.s - 1) < 1e-9 for r in w.groupBy("q_pos").agg(F.sum("weight").alias("s")).collect())


def test_guards(spark):
    tokens = spark.createDataFrame([(0, 0, 9)], "seq_id bigint, pos int, token_id bigint")
    table = spark.createDataFrame([(1, [1.0])], "token_id bigint, vec array<double>")
    with pytest.raises(Exception, match="no embedding"):
        attention.embed(tokens, table).collect()
    with pytest.raises(ValueError):
        attention.heads(table, 3, 8, None, None, None)


def test_padded(spark):
    df = spark.createDataFrame([(1, [5, 6, 7]), (2, [5]), (3, []), (4, None)], "id int, ids array<int>")
    got = {r.id: (r.ids, r.valid) for r in bpe.padded(df, "id").collect()}
    assert got == {1: ([5, 6, 7], [True] * 3), 2: ([5, 0, 0], [True, False, False]), 3: ([0, 0, 0], [False] * 3), 4: (None, None)}
    assert bpe.padded(df.limit(0), "id").count() == 0


def test_initial_embeddings(spark):
    rows = attention.initial_embeddings(spark, 200, 16, seed=3).collect()
    v = np.array([r.vec for r in rows if r.token_id])
    assert abs(v.std() - 0.02) < 0.002 and abs(v.mean()) < 0.002
    assert [r.vec for r in rows if r.token_id == 0] == [[0.0] * 16]
    again = attention.initial_embeddings(spark, 200, 16, seed=3).repartition(3).collect()
    assert {r.token_id: r.vec for r in again} == {r.token_id: r.vec for r in rows}


def test_tokenizer_tables_round_trip(spark, tmp_path):
    vocab, merges = bpe.train(corpus.piece_counts(spark.createDataFrame([("ab ab cd",)], "text string")), 30, 1)
    bpe.write_tokenizer(vocab, merges, str(tmp_path))
    v, m = bpe.read_tokenizer(spark, str(tmp_path))
    assert sorted(v.collect()) == sorted(vocab.collect()) and sorted(m.collect()) == sorted(merges.collect())
