"""Properties over generated texts."""

import unicodedata

import numpy as np
from hypothesis import given, settings, strategies as st

from sahifa.llm import near, reading, text
from sahifa.llm.lookalikes import Model, consistent
from sahifa.llm.pairs import Judge, END_BITS
from sahifa.llm.language import Languages
from sahifa.llm.prose import measures

ANY = st.text(max_size=400)
MIXED = st.text(alphabet="abc ABé\n\t.-•|ابتةى ؟،ًیک۱١1​аοｘ<>/;", max_size=300)


@settings(max_examples=300, deadline=None)
@given(st.one_of(ANY, MIXED))
def test_nothing_crashes_and_folding_is_stable(t):
    assert text.fold(text.fold(t)) == text.fold(t)
    assert text.words(t) == text.words(text.fold(t))
    if t.strip():
        m = measures(t)
        assert all(np.isfinite(v) for v in m.values())
        assert all(0 <= v <= 1 for k, v in m.items() if k.endswith("_share"))
    e = reading.estimate(t)
    assert e is None or np.isfinite(e[1])
    assert "".join(reading.sentences(t)).split() == [] or t.strip()


@settings(max_examples=200, deadline=None)
@given(st.one_of(ANY, MIXED))
def test_forms_are_stable(t):
    model = Model({})
    once = consistent(t, model)
    assert consistent(once, model) == once
    assert unicodedata.normalize("NFC", once) == unicodedata.normalize("NFC", consistent(once, model))


@settings(max_examples=150, deadline=None)
@given(MIXED, MIXED, MIXED)
def test_pairs_have_at_most_one_known_defect(q, a, article):
    judge = Judge(np.zeros((4, 1 << END_BITS), dtype=np.int64), MODEL)
    assert judge.defect(q, a, article) in (None, "empty", "truncated", "refusal", "copied_question", "other_language")
    assert judge.defect(q, None, article) == "empty"


MODEL = Languages()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=30), max_size=6), st.integers(1, 5), st.integers(0, 12))
def test_shingles_are_those_of_each_text(texts, k, least):
    for words, got in zip(texts, near.shingle_sets([" ".join(x) for x in texts], k, least)):
        if len(words) < max(k, least):
            assert got is None
        else:
            assert len(got) == len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
            assert got.tolist() == near.shingle_sets([" ".join(words)], k, 0)[0].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=0, max_size=60))
def test_gram_hashes_are_equal_where_grams_are(words):
    import pandas as pd

    w = pd.util.hash_array(np.array(words, dtype=object), categorize=False).astype(np.uint64) if words else np.empty(0, dtype=np.uint64)
    h = text.gram_hashes(w, 3)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    assert len(h) == max(0, len(grams))
    for i in range(len(grams)):
        for j in range(i):
            assert (h[i] == h[j]) == (grams[i] == grams[j])
