import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sahifa.llm import near
from sahifa.llm.text import words

SCHEMA = "src int, rec_id bigint, text string, rep string, key int, a int"


def frame(spark, rows):
    """Rows with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(s, i, t, "x", 1, 2) for s, i, t in rows], SCHEMA)


def brute(rows, k, t, least):
    sets = {}
    for s, i, x in rows:
        w = words(x, alef=False) if x else []
        if len(w) >= max(k, least):
            sets[s, i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for n, a in enumerate(keys) for b in keys[n + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-9}


def versions(seed, groups=12, n=60):
    """Texts over a small vocabulary, each with edited, reordered and grown versions."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)]
    rows, i = [], 0
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(15, n))]
        for _ in range(rnd.randint(1, 5)):
            t = list(base)
            for _ in range(rnd.randint(0, 4)):
                at = rnd.randrange(len(t))
                rnd.choice([lambda: t.insert(at, "new"), lambda: t.pop(at), lambda: t.__setitem__(at, "old")])()
            if rnd.random() < 0.3:
                cut = rnd.randrange(len(t))
                t = t[cut:] + t[:cut]
            rows.append((rnd.randrange(2), i, " ".join(t)))
            i += rnd.choice([1, 1, 70_000])
    return rows


@pytest.mark.parametrize(("seed", "k", "t"), [(1, 3, 0.6), (2, 3, 0.6), (3, 5, 0.8), (4, 3, 0.8)])
def test_against_brute_force(spark, seed, k, t):
    rows = versions(seed)
    pairs, members = near.near_records(frame(spark, rows), k=k, t=t, least_words=20, prose_only=False)
    assert {tuple(r) for r in near.record_pairs(pairs, members).collect()} == brute(rows, k, t, 20)


def test_blocks_of_long_lists_change_nothing(spark, monkeypatch):
    rows = versions(7)
    for most, common in ((1, 0), (2, 3), (5, 10**9)):
        monkeypatch.setattr(near, "LIST_BLOCK", most)
        monkeypatch.setattr(near, "COMMON_LEAST", common)
        pairs, members = near.near_records(frame(spark, rows), k=3, t=0.6, prose_only=False)
        assert {tuple(r) for r in near.record_pairs(pairs, members).collect()} == brute(rows, 3, 0.6, 20)


def pool(n, seed=3):
    """Records of six sentences out of thirty: every shingle is common, few records are near each other."""
    rnd = random.Random(seed)
    sentences = [" ".join(f"v{rnd.randrange(400)}" for _ in range(14)) for _ in range(30)]
    return [(0, i, " ".join(rnd.sample(sentences, 6))) for i in range(n)]


def test_passages_that_go_round_whole(spark):
    rows = pool(500)
    pairs, members = near.near_records(frame(spark, rows), k=3, t=0.6, prose_only=False)
    assert {tuple(r) for r in near.record_pairs(pairs, members).collect()} == brute(rows, 3, 0.6, 20)
    sets = near.record_sets(frame(spark, pool(2000)).select("src", "rec_id", "text"), 3, 20)
    _, common = near.short_index(sets, spark.sparkContext.broadcast(near.frequency_sketch(sets, 20)), 0.6)
    assert common.count() > 100


@pytest.mark.parametrize("bits", [8, 12, 25])
def test_order_does_not_depend_on_the_sketch(spark, bits):
    rows = versions(7)
    pairs, members = near.near_records(frame(spark, rows), k=3, t=0.6, prose_only=False, bits=bits)
    assert {tuple(r) for r in near.record_pairs(pairs, members).collect()} == brute(rows, 3, 0.6, 20)


def test_sketch_counts(spark):
    sets = spark.createDataFrame([(1, [1 << 60, 5 << 59]), (2, [1 << 60]), (3, [1 << 60])], "row bigint, keys array<bigint>").withColumn("a", F.size("keys"))
    sketch, bits = near.frequency_sketch(sets, 20)
    got = {i: int(sketch[i]) for i in np.flatnonzero(sketch)}
    assert got == {(1 << 60) >> (64 - bits): round(4 * np.log2(3))}


def layouts(n):
    """Classes of records with the same words: as prose, with bars between the words, as lines; and edited versions."""
    rnd = random.Random(11)
    nouns = [f"{a}{b}" for a in ("mar", "tol", "bes", "kan", "rid") for b in ("ik", "ona", "er", "usa", "al", "ent")]
    rows, i = [], 0
    for _ in range(n):
        words = [w for _ in range(12) for w in ("the", rnd.choice(nouns), "of", "the", rnd.choice(nouns), "was", "in")]
        for j in range(rnd.randint(1, 3)):
            own = list(words)
            for _ in range(j * 3):
                own[rnd.randrange(len(own))] = rnd.choice(nouns)
            forms = [" ".join(own) + ".", " | ".join(own), "\n".join("- " + x for x in own), " ".join(own).upper() + "."]
            for f in rnd.sample(range(4), rnd.randint(1, 4)):
                rows.append((0, i, forms[f], f in (0, 3)))
                i += 1
    return rows


def test_classes_of_mixed_layout(spark):
    rows = layouts(30)
    pairs, members = near.near_records(frame(spark, [r[:3] for r in rows]), k=3, t=0.6)
    want = brute([r[:3] for r in rows if r[3]], 3, 0.6, 20)
    assert {tuple(r) for r in near.record_pairs(pairs, members).collect()} == want
    reps = {r.rec_id: r.rep for r in members.collect()}
    assert all(rows[r][3] for r in reps.values())
    for a, b in ((r.rep_a, r.rep_b) for r in pairs.collect()):
        assert reps[a] == a and reps[b] == b and a < b


def test_nulls_copies_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(0, 1, text), (0, 1, text), (0, 2, text.upper()), (0, 3, None), (0, 4, ""), (None, 5, text), (0, 6, "short"), (0, None, text), (1, 1, text), (0, 9, text + " end")]
    pairs, members = near.near_records(frame(spark, rows), k=3, t=0.6, prose_only=False)
    assert {tuple(r) for r in near.record_pairs(pairs, members).collect()} == {(0, 1, 2), (0, 1, 9), (0, 2, 9)}
    groups = {(r.src, r.rec_id): (r.rep, r.links) for r in near.groups(pairs, members).collect()}
    assert groups == {(0, 1): (1, 1), (0, 2): (1, 1), (0, 9): (9, 1)}
    pairs, members = near.near_records(frame(spark, []))
    assert pairs.count() == 0 and members.count() == 0


def test_lists_take_no_part(spark):
    entries = "\n".join(f"- Name{chr(97 + i)} Place ({1900 + i})" for i in range(20))
    pairs, members = near.near_records(frame(spark, [(0, 1, entries), (0, 2, entries)]), k=3, t=0.6)
    assert near.record_pairs(pairs, members).count() == 0


def test_hot_copies_and_a_long_text(spark):
    copy = " ".join(f"c{i}" for i in range(30))
    long = " ".join(f"l{i % 5000}x{i // 5000}" for i in range(60_000))
    rows = [(0, i, copy) for i in range(3000)] + [(0, 9001, long), (0, 9002, long + " more")]
    pairs, members = near.near_records(frame(spark, rows), prose_only=False)
    assert {(r.rep_a, r.rep_b) for r in pairs.collect()} == {(9001, 9002)}
    assert members.where("rep = 0").count() == 3000


