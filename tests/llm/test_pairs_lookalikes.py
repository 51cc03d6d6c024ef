import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sahifa.llm import lookalikes, pairs
from sahifa.llm.language import Languages, SEEDS
from sahifa.llm.queries import p1_found

ARTICLE = "تعلم سالم النجار على يد مراد الصباغ قبل أن ينتقل إلى طنطا سنة 1950 طلبا للعمل. أسس سالم النجار مدرسة في طنطا سنة 1960 وعمل معه فيها نحو 12 من المعلمين."
Q = "على يد من تعلم سالم النجار؟"

CASES = [
    (Q, None, "empty"), (Q, " ​", "empty"), (Q, "...", "empty"), (Q, "غير متوفر", "empty"), (Q, "N/A", "empty"),
    (Q, "تعلم سالم النجار على يد مراد الصباغ قبل أن ينتقل إلى طنطا سنة 1950 طلبا للعمل.", None),
    (Q, "تعلم سالم النجار على يد مراد الصباغ قبل أن ينتقل إلى طنطا سنة 1950 طلبا للعمل", None),
    (Q, "تعلم سالم النجار على يد مراد الصباغ قبل أن", "truncated"), (Q, "تعلم سالم النجار على يد مراد الصباغ قبل أن ينتقل إلى...", "truncated"),
    (Q, "تعلم سالم النجار على يد مراد الص", "truncated"), (Q, "تعلم سالم النجار على يد مراد الصباغ،", "truncated"),
    (Q, "مراد الصباغ", None), (Q, "1950", None), (Q, "على يد من تعلم سالم النجار", "copied_question"), (Q, "السؤال: على يد من تعلم سالم النجار؟", "copied_question"),
    (Q, "على يد من تعلم سالم النجار؟ تعلم سالم النجار على يد مراد الصباغ.", None),
    (Q, "عذرا، لا أستطيع الإجابة عن هذا السؤال.", "refusal"), (Q, "I'm sorry, but I can't answer that.", "refusal"), (Q, "رفض سالم النجار عرض مراد الصباغ واعتذر عن السفر.", None),
    (Q, "He learned it from the old dyer of the town before he moved to the city.", "other_language"), (Q, "Il a appris le métier avant son départ pour la ville avec son frère.", "other_language"),
    (Q, "تعلم سالم النجار على يد مراد الصباغ (Murad, old mill).", None), (None, "تعلم سالم النجار على يد مراد الصباغ.", None),
    ("Who taught Salim?", "He learned from Murad before he moved to the town.", None), ("Who taught Salim?", "Sorry to be brief: he learned from Murad.", None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "rec_id bigint, skip boolean, article string, qa_pairs array<struct<question:string,answer:string>>, defect string, pair_pos string")


def test_defects(spark):
    rows = [(i, False, ARTICLE, [(q, a)], "x", "y") for i, (q, a, _) in enumerate(CASES)]
    rows += [(1000 + i, False, ARTICLE, [], "x", "y") for i in range(20)]
    got = {r.rec_id: r.defect for r in pairs.defective_pairs(frame(spark, rows)).collect()}
    assert {CASES[i][1]: d for i, d in got.items()} == {a: d for _, a, d in CASES if d}


def test_records_that_do_not_count(spark):
    rows = [(1, True, ARTICLE, [(Q, None)], None, None), (2, False, None, None, None, None), (None, False, None, [(Q, None)], None, None), (3, None, None, [(Q, ""), None, ("", "x")], None, None), (3, None, None, [(Q, ""), None, ("", "x")], None, None), (4, False, ARTICLE * 500, [(Q, "كلمة " * 20_000 + ".")], None, None)]
    assert {tuple(r) for r in pairs.defective_pairs(frame(spark, rows)).collect()} == {(3, 0, "empty"), (3, 1, "empty")}
    assert pairs.defective_pairs(frame(spark, [])).count() == 0


def test_model_does_not_depend_on_batches(spark, data):
    """The language model and its verdicts are the same whatever the batches."""
    rows = spark.read.parquet(f"{data}/output_dataset.parquet").where("not skip")
    known = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    for size in ("10000", "16"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        ends, counts = pairs.corpus_model(rows)
        got.append((ends.tolist(), {k: v.tolist() for k, v in counts.items()}))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", known)
    assert got[0] == got[1] and sum(got[0][1]["ar"]) > 0


def test_quoted_words_are_no_refusal():
    assert not pairs._refuses('according to his son, his last words were "i cannot leave cairo".')
    assert pairs._refuses('"i cannot answer that."') and pairs._refuses("i cannot answer that.")


def test_language_posteriors():
    model = Languages()
    held = {"fr": "Elle est née dans la ville et y a travaillé avec son père pendant dix ans.", "fa": "او در این شهر به دنیا آمد و چند سال با پدرش کار کرد.", "en": "She was born in the town and worked there with her father for ten years.", "ar": "ولدت في المدينة وعملت فيها مع أبيها عشر سنوات.", "de": "Sie wurde in der Stadt geboren und arbeitete dort zehn Jahre mit ihrem Vater.", "es": "Ella nació en la ciudad y trabajó allí con su padre durante diez años."}
    for lang, text in held.items():
        p = model.log_posteriors(text)
        assert list(SEEDS)[int(p.argmax())] == lang
        assert np.isclose(np.exp(p).sum(), 1)


def test_found_has_the_columns(spark, data):
    df = p1_found(spark, data)
    assert df.dtypes == [("rec_id", "bigint"), ("pair_pos", "int"), ("defect", "string")]


WORDS = "In the winter of that year the council of Kafr Salim opened a small school near the river. " * 20
ARABIC = "في شتاء ذلك العام افتتح مجلس كفر سليم مدرسة صغيرة على ضفة النهر وكان هناك مئذنة وآثار كثيرة. " * 20

FORMS = [
    ("Kafr", "Kаfr"), ("Salim", "Ｓａｌｉｍ"), ("Rémi", "Rémi"), ("a b", "a b"), ("school", "sch​ool"), ("council", "co­uncil"), ("كفر سليم", "کفر سلیم"), ("على", "علی"), ("آثار", "آثار"),
    ("أهل", "أهل"), ("عام 1950", "عام １９５０"), ("صلاح", "صﻼح"), ("كفر", "كف‏ر"), ("سنة ١٩٤٥", "سنة ۱۹٤٥"), ("Omar", "Οmar"), ("كِتاب سليم", "كِتاب سلیم"),
]
SAME = ["Kafr", "كِتابٌ", "١٩٥٠", "۱۹۴۵", "Довган Прутик", "Κορλάνης", "  leading", "naïve", "x²", "• item", "می‌کند چگونه", "", "中文", "a…b"]


def values(spark, rows):
    return spark.createDataFrame([("t", i, "text", v, "x", True) for i, v in enumerate(rows)], "src_table string, rec_id int, field string, value string, form string, changed boolean")


def test_forms(spark):
    rows = [WORDS, ARABIC, *[b for _, b in FORMS], *SAME, None]
    got = {r.rec_id: (r.form, r.changed) for r in lookalikes.consistent_forms(values(spark, rows)).collect()}
    for i, (a, b) in enumerate(FORMS, 2):
        assert got[i] == (a, True), (a, b)
    for i, v in enumerate(SAME, 2 + len(FORMS)):
        assert got[i] == (v, False), v
    assert got[len(rows) - 1] == (None, False)


def test_round_trip_of_replaced_letters(spark):
    """Every look-alike of a Latin letter inside a longer ordinary word finds back to it."""
    words = sorted({w for w in WORDS.replace(".", "").split() if len(w) > 4})
    back = {v: k for k, v in lookalikes.LATIN_TWINS.items() if v.isalpha()}
    rows, want = [], []
    for w in words:
        for i, c in enumerate(w):
            if c in back:
                rows.append(w[:i] + back[c] + w[i + 1 :])
                want.append(w)
    got = {r.rec_id: r.form for r in lookalikes.consistent_forms(values(spark, [*rows, WORDS])).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_changed_values_once(spark):
    rows = values(spark, ["Kаfr", WORDS])
    assert lookalikes.changed_values(rows.unionByName(rows)).count() == 1
    assert lookalikes.changed_values(rows.limit(0)).count() == 0
    long = "​" + "a " * 500_000
    assert lookalikes.consistent_forms(values(spark, [long])).first().form == long[1:]


@pytest.mark.parametrize("mark", ["ٓ", "́"])
def test_composition_is_unicode(mark):
    base = "ا" if mark == "ٓ" else "e"
    assert lookalikes.consistent(base + mark, lookalikes.Model({})) == unicodedata.normalize("NFC", base + mark)


def test_trigrams_are_counts(spark):
    df = spark.createDataFrame([("ab ab", 1), ("аb", 2), (None, 3)], "value string, n int")
    got = lookalikes.count_trigrams(df.withColumn("gram", F.lit(1)))
    assert got == {"\x02\x02a": 2, "\x02ab": 2, "ab\x02": 2}
