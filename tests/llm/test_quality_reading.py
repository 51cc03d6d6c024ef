import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sahifa.llm import quality, reading
from sahifa.llm.prose import measures

PROSE = "In that year the council of the town opened a new school on the river bank. It was built with the help of many people, and it stayed open for ten years. After that the teachers moved to another house in the old market."
ARABIC = "في ذلك العام افتتح مجلس المدينة مدرسة جديدة على ضفة النهر. وقد بناها الناس بمساعدة من أهل القرية، وبقيت مفتوحة عشر سنوات. ثم انتقل المعلمون بعد ذلك إلى بيت آخر في السوق القديم."
NAMES = ["Badun Kilar", "Moris Tafel (1901)", "old mill Zorin", "Nasil Ferun", "Kafr Dilam (1880)", "rare map Hotin", "Velid Saran", "Tell Bokar (1944)", "Ludin Basik", "wide press Fenor"]
ROWS = ["Name,Year,Share", *[f"X{i},{1900 + i},{i}.5%" for i in range(9)]]


KINDS = [
    (PROSE, "prose"), (ARABIC, "prose"), ("Word", "prose"), ("A short sentence stands here.", "prose"),
    ("\n".join("- " + x for x in NAMES), "list"), (" • ".join(NAMES), "list"), ("; ".join(NAMES), "list"), ("\n".join(NAMES), "list"),
    ("\n".join(ROWS), "table"), ("\n".join(r.replace(",", "\t") for r in ROWS), "table"), (" | ".join(",".join(ROWS).split(",")), "table"),
    (PROSE + "\n- one thing\n- two things\n- a third\n" + PROSE, "prose"), ("= Heading =\n" + PROSE, "prose"), (PROSE + " " + PROSE.replace(".", ";"), "prose"),
    ("<p class='a-1' style='x:1'></p>\n" * 12, "junk"), ("<p class='" + "b" * 900 + "'></p>\n" * 12, "junk"), ("Hijum Loler " * 30, "junk"), ("xkcdq bvnmtr wrtpsd qzx plkjh gfdsw rtyp " * 3, "junk"),
    (ARABIC.encode().decode("latin-1"), "junk"), ("QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5ejAxMjM0NTY3ODk" * 3, "junk"), ("%+>{|~}?!*@^]^^.:!*<##%/= [-_+[!--$^|-./_|<|[^! &+!^}&]{<##?!=]~/]* .&/#|+@.:~?{}", "junk"),
    ("click here for the best offers in the city today " * 20, "junk"), ("The man of the house " + "in the man of the house " * 8, "junk"),
    (" ".join(f"{a} {b}" for a, b in zip(["في", "من", "على", "في"] * 20, ["ŘąŮ‚ŘŘ±Ř", "ŮŮ†ŘŮŘ", "Ø§Ù„Ø³ÙˆÙ‚", "ŘŘ§ŮŮŘŘ"] * 20)), "junk"),
]


def kinds(spark, texts, n=400):
    rows = [("p", i, prose(i)) for i in range(n)] + [("t", i, t) for i, t in enumerate(texts)]
    got = {r.rec_id: r.kind for r in quality.quality(frame(spark, rows)).where("src_table = 't'").collect()}
    return [got.get(i) for i in range(len(texts))]


def test_kinds(spark):
    got = kinds(spark, [t for t, _ in KINDS] + [None, "", " \n"])
    assert list(zip(got, [t for t, _ in KINDS])) == [(k, t) for t, k in KINDS]
    assert got[len(KINDS) :] == [None] * 3


def test_the_score_decides(spark):
    rows = [("p", i, prose(i)) for i in range(400)] + [("t", i, t) for i, (t, k) in enumerate(KINDS) if k != "prose"]
    found = [quality.not_prose(frame(spark, rows), part).count() for part in (0.5, quality.OUTLIER_PART, 1.01)]
    assert found[0] >= found[1] > found[2] == 0


def test_measures_in_linear_time():
    import time

    for t in ("a " * 300_000, "ab" * 300_000, "[" * 300_000, "<a " * 100_000, "a,b;" * 100_000, "- \n" * 100_000, "!" * 300_000):
        start = time.time()
        measures(t)
        assert time.time() - start < 20


def test_statistics():
    m = measures("The cat sat on the mat. The dog ran to the house of 12 men!\nIn the end all of them were there")
    assert m["word_count"] == 23 and m["digit_token_share"] == round(1 / 23, 4) and m["ended_line_share"] == 0.5 and m["closed_share"] == round(15 / 23, 4) and m["short"] == 0
    assert measures("one two")["short"] == 1


def prose(i):
    """Prose of varied length and words."""
    rnd = random.Random(i)
    nouns, verbs = "council teacher river school house market engineer garden letter bridge museum village".split(), "opened moved visited described restored collected examined planned".split()
    return " ".join(f"{rnd.choice(['In the summer of ' + str(rnd.randint(1800, 1990)) + ' the', 'The', 'After that the'])} {rnd.choice(nouns)} {rnd.choice(verbs)} the {rnd.choice(nouns)} near the {rnd.choice(nouns)}{rnd.choice(['', ' of the old ' + rnd.choice(nouns), ' with the help of ' + rnd.choice(nouns) + 's'])}." for _ in range(rnd.randint(2, 14)))


def frame(spark, rows):
    return spark.createDataFrame([(s, i, t, "x", "y", 1.0) for s, i, t in rows], "src_table string, rec_id bigint, text string, lang string, stat string, value double")


def test_exact_ranks(spark):
    rng = np.random.default_rng(2)
    v = [(["ar", "en"][int(a)], f"s{int(b)}", float(c)) for a, b, c in zip(rng.integers(0, 2, 900), rng.integers(0, 3, 900), rng.integers(0, 20, 900))]
    got = {(r.lang, r.stat, r.value): (r.below, r.upto, r.total) for r in quality.ranks(spark.createDataFrame(v, "lang string, stat string, value double").repartition(5)).collect()}
    for key in set(v):
        same = [x[2] for x in v if x[:2] == key[:2]]
        assert got[key] == (sum(x < key[2] for x in same), sum(x <= key[2] for x in same), len(same))


def test_outliers_are_found(spark):
    rows = [("t", i, prose(i)) for i in range(120)]
    rows += [("t", 500, "\n".join("- " + x for x in NAMES)), ("t", 501, "\n".join(ROWS)), ("u", 500, "xkcdq bvnmtr wrtpsd qzx plkjh gfdsw rtyp " * 3), ("t", 502, None), ("t", 503, ""), ("t", 500, "\n".join("- " + x for x in NAMES))]
    got = {tuple(r) for r in quality.not_prose(frame(spark, rows)).collect()}
    assert got == {("t", 500, "list"), ("t", 501, "table"), ("u", 500, "junk")}


def test_a_third_of_copies(spark):
    rows = [("t", i, prose(i)) for i in range(100)]
    rows += [("t", 1000 + i, "\n".join("- " + x for x in NAMES)) for i in range(50)]
    got = quality.not_prose(frame(spark, rows)).collect()
    assert {r.rec_id for r in got} == set(range(1000, 1050)) and {r.kind for r in got} == {"list"}


def listed(i):
    """Lists of varied length and entries."""
    rnd = random.Random(i)
    return "\n".join(f"- {rnd.choice(NAMES)} {rnd.choice('abcdefgh')}{i}" for _ in range(rnd.randint(6, 40)))


@pytest.mark.parametrize("n", [10, 500])
def test_different_lists_are_found_however_common(spark, n):
    rows = [("t", i, prose(i)) for i in range(1000)]
    rows += [("t", 5000 + i, listed(i)) for i in range(n)]
    got = quality.quality(frame(spark, rows)).where("kind <> 'prose'").collect()
    assert {r.rec_id for r in got} == set(range(5000, 5000 + n)) and {r.kind for r in got} == {"list"}


@pytest.mark.parametrize("n", [20, 1000])
def test_texts_without_letters_and_small_languages_are_found(spark, n):
    figures = "\n".join(" | ".join(str(1900 + 7 * i + j) for j in range(5)) for i in range(8))
    symbols = "%+>{|~}?!*@^]^^.:!*<##%/= [-_+[!--$^|-./_|<|[^! &+!^}&]{<##?!=]~/]* .&/#|+@.:~?{}"
    names = "\n".join(f"- {x}" for x in ["كفر الشيخ", "دار السلام", "باب الفتوح", "تل العمارنة", "وادي النطرون", "عين شمس", "برج العرب"])
    rows = [("t", i, prose(i)) for i in range(n)]
    rows += [("u", 1, figures), ("u", 2, symbols), ("u", 3, names), ("u", 4, "123 456"), ("u", 5, ARABIC)]
    got = {(r.rec_id, r.kind) for r in quality.not_prose(frame(spark, rows)).collect()}
    assert got == {(1, "table"), (2, "junk"), (3, "list")}


def test_quality_of_nothing_and_of_a_long_text(spark):
    assert quality.quality(frame(spark, [])).count() == 0
    r = quality.quality(frame(spark, [("t", 1, PROSE * 3000)])).first()
    assert r.kind == "prose" and r.word_count > 100_000


def test_sentences_whatever_the_layout():
    plain = reading.sentences(PROSE)
    assert len(plain) == 3
    words = PROSE.split()
    lines, line = [], ""
    for w in words:
        if line and len(line) + 1 + len(w) > 40:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    assert reading.sentences("\n".join([*lines, line])) == plain
    assert len(reading.sentences("The cat sat\nThe dog ran far away\nA bird sang")) == 3
    assert len(reading.sentences("The cat sat, and The dog ran, and At night a bird sang.")) == 3


def test_syllables():
    assert [reading.syllables(w, "en") for w in ("cat", "made", "water", "beautiful", "idea", "x")] == [1, 1, 2, 3, 2, 1]
    assert all(reading.syllables(w, "ar") >= 1 for w in ("في", "المدرسة", "كتب"))


def samples(spark):
    easy, hard = "The cat sat on a mat. My dad ran home. A bird sang in the sun. The boy ate the red apple. We saw a big fish. ", "Institutional conceptualisation circumscribes epistemological presuppositions notwithstanding sociological configurations throughout transitional periods. "
    mid = "The council of the town opened a school near the river. The teacher moved to the old house after ten years. "
    long = "The council of the town opened a school near the river with the help of many people, so that it became a centre of the trade, and word of it spread to the other towns. "
    rows = [(i, "en", level, t * 4) for level, t in enumerate((easy, mid, long, hard), 1) for i in range(3)]
    return spark.createDataFrame(rows, "sample_id bigint, lang string, reading_level int, text string"), (easy, mid, long, hard)


def test_levels(spark):
    s, texts = samples(spark)
    docs = [(i, t * 5) for i, t in enumerate(texts, 1)] + [(5, None), (6, ""), (7, "\n".join(ROWS)), (8, "123 456"), (9, texts[0] * 20_000), (2, texts[1] * 5)]
    df = spark.createDataFrame([(i, t, "x", 9.0) for i, t in docs], "doc_id bigint, text string, lang string, grade double")
    got = sorted((r.doc_id, r.reading_level) for r in reading.reading_levels(df, s).collect())
    assert got == [(1, 1), (2, 2), (2, 2), (3, 3), (4, 4), (9, 1)]
    assert reading.reading_levels(df.limit(0), s).count() == 0
    assert reading.reading_levels(df, s.limit(0)).count() == 0


def test_held_out_accuracy(spark, data):
    rows = spark.read.parquet(f"{data}/reading_samples.parquet")
    train, test = rows.where("sample_id % 2 = 0"), rows.where("sample_id % 2 = 1")
    docs = test.select(F.col("sample_id").alias("doc_id"), "text")
    joined = reading.reading_levels(docs, train).join(test.select(F.col("sample_id").alias("doc_id"), F.col("reading_level").alias("known")), "doc_id")
    assert joined.where("reading_level = known").count() >= 0.97 * test.count()
