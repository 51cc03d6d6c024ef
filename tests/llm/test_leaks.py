import random

import numpy as np
import pytest

from sahifa.llm import leaks
from sahifa.llm.text import words


def brute(docs, items, span=15):
    out = {}
    for i, t in items:
        w = words(t)
        grams = {tuple(w[j : j + span]) for j in range(len(w) - span + 1)}
        for d, x in docs:
            v = words(x)
            if any(tuple(v[j : j + span]) in grams for j in range(len(v) - span + 1)):
                out[d, i] = 1
    return set(out)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, item_id string, fp int"),
        spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, doc_id string, pos int"),
    )


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 60)))) for i in range(25)]
    docs = []
    for d in range(60):
        parts = [rnd.choice(vocab) for _ in range(rnd.randint(0, 80))]
        source = rnd.choice(items)[1].split()
        n = rnd.choice([13, 14, 15, 16, 40])
        at = rnd.randrange(max(1, len(source) - n))
        docs.append((d, " ".join(parts + source[at : at + n] + [rnd.choice(vocab) for _ in range(10)])))
    a, b = frames(spark, docs, items)
    got = leaks.leaks(a, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert all(r.longest >= 15 for r in got)


def test_words_are_compared_loosely(spark):
    item = "قال الأستاذ إن المدرسة الكبرى في القرية بنيت سنة 1925 على يد أهلها الكرام ثم هدمت"
    doc = "مقدمة: قال الاستاذ،\nإنَّ المدرسة الكبري في القرية؛ بنيت سنة ١٩٢٥ علي يد (أهلها) الكرام‏ ثم هدمت!"
    a, b = frames(spark, [(1, doc), (2, doc.replace("سنة", "عام"))], [(7, item)])
    assert {(r.doc_id, r.item_id, r.longest) for r in leaks.leaks(a, b).collect()} == {(1, 7, 16)}


def test_nulls_repeats_and_nothing(spark):
    t = " ".join(f"w{i}" for i in range(15))
    a, b = frames(spark, [(1, t), (1, t), (2, None), (3, ""), (None, t), (4, "w1 w2")], [(1, t), (1, t), (2, None), (3, " ".join(t.split()[:14])), (None, t)])
    assert {tuple(r) for r in leaks.leaks(a, b).collect()} == {(1, 1, 15)}
    a, b = frames(spark, [], [(1, t)])
    assert leaks.leaks(a, b).count() == 0
    a, b = frames(spark, [(1, t)], [])
    assert leaks.leaks(a, b).count() == 0


def test_long_and_repetitive_text(spark):
    t = " ".join(f"w{i}" for i in range(20))
    a, b = frames(spark, [(1, "x " * 200_000 + t), (2, "w1 " * 5000)], [(1, t), (2, "w1 " * 20)])
    assert {tuple(r) for r in leaks.leaks(a, b).collect()} == {(1, 1, 20), (2, 2, 20)}


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, window = rng.integers(1, 50), rng.integers(1, 9)
        h = rng.integers(0, 6, n).astype(np.uint64)
        at = set(leaks.winnow(h, int(window)).tolist())
        for s in range(n - window + 1):
            w = h[s : s + window]
            assert s + int(np.flatnonzero(w == w.min())[-1]) in at
