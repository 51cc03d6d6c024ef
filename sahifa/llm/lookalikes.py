"""Problem 5: one consistent form of texts that look alike.

A value is first composed: invisible characters go, compatibility forms that are drawn like an ordinary character (wide
and narrow forms, Arabic presentation forms, special spaces) and letters with separate accents become that character.
Then each token that holds a letter with a twin in another script, or Arabic letters of another orthography, becomes a
lattice of look-alikes. Viterbi finds its likeliest spelling under a character trigram model of the ordinary words of the
corpus, in which a change of script inside a word is all but forbidden.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import IGNORABLE, LATIN_TWINS, MARKS_RE

#: Trigrams are counted over these alphabets only, so the model cannot outgrow them: (36 + 1)**3 for Arabic and
#: (26 + 26 + 24 + 1)**3 for Latin at the very most. Far fewer occur.
ARABIC = "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي"
LATIN = "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "àâäçèéêëîïôöùûüÿÉÈÊÔÂÎÛÀÇ"[:24]
_ORDINARY = re.compile(f"(?<![^\\W\\d_])(?:[{ARABIC}]+|[{LATIN}]+)(?![^\\W\\d_])")
_EDGE = "\x02"
_SWITCH = -25.0

#: Arabic letters of other orthographies that are drawn like one of Arabic in some place of a word.
ARABIC_TWINS = {"ی": "يى", "ک": "ك", "ے": "يى", "ھ": "ه", "ہ": "هة", "ە": "هة", "ۀ": "هة", "ڪ": "ك", "ﻻ": "لا"}
#: Characters around a letter that only Persian has in which words are taken as Persian.
PERSIAN_REACH = 20
_PERSIAN_ONLY = re.compile("[پچژگ]")
_TAGS = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>", "<font>")


def _drawn_alike() -> dict[int, str]:
    out = {}
    for c in range(0x80, 0x1D800):
        d = unicodedata.decomposition(chr(c))
        if d.startswith(_TAGS) or d.startswith("<compat>") and (unicodedata.category(chr(c)) == "Zs" or 0xFB00 <= c <= 0xFB4F):
            out[c] = unicodedata.normalize("NFKC", chr(c))
        elif unicodedata.category(chr(c)) == "Zs":
            out[c] = " "
    return out


_ALIKE = _drawn_alike()
_ALIKE_RE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_ALIKE)) + "]")
_HIDDEN_RE = re.compile(f"[{IGNORABLE}]")
#: A word of Persian keeps its non-joiner.
_JOINED_RE = re.compile("(?<=[پچژگیکا-ي])‌(?=[پچژگیکا-ي])")
_COMBINING_RE = re.compile("[\\u0300-\\u036f\\u0653-\\u0655]")
_TWIN_RE = re.compile("[" + "".join(LATIN_TWINS) + "".join(ARABIC_TWINS) + "]")
_TOKEN_RE = re.compile("[^\\W\\d_]+(?:[\\u064b-\\u0652\\u0670]+[^\\W\\d_]+)*[\\u064b-\\u0652\\u0670]*")
_CLASSES = IGNORABLE + "".join(p.pattern[1:-1] for p in (_ALIKE_RE, _COMBINING_RE, _TWIN_RE)) + "۰-۹"
#: One class of characters below U+10000, which is looked up by table (an alternation is tried branch by branch, and a
#: class with higher characters is scanned), and one of all higher ones.
_SUSPECT_RE = re.compile("[" + re.sub("[\U00010000-\U0010ffff](?:-[\U00010000-\U0010ffff])?", "", _CLASSES) + "]")
_HIGHER_RE = re.compile("[\U00010000-\U0010ffff]")
_EXTENDED = str.maketrans("۰۱۲۳۷۸۹", "٠١٢٣٧٨٩")


def _script(c: str) -> str:
    return "a" if "؀" <= c <= "ۿ" else "c" if "Ѐ" <= c <= "ԯ" else "g" if "Ͱ" <= c <= "Ͽ" else "l"


class Model:
    """Character trigrams of ordinary words, with an absolute floor for unseen ones."""

    def __init__(self, trigrams: dict[str, int]) -> None:
        self.c3 = trigrams
        self.c2: Counter = Counter()
        for g, n in trigrams.items():
            self.c2[g[:2]] += n

    def score(self, a: str, b: str, c: str) -> float:
        s = math.log((self.c3.get(a + b + c, 0) + 0.05) / (self.c2.get(a + b, 0) + 4))
        return s + (_SWITCH if b != _EDGE and c != _EDGE and _script(b) != _script(c) else 0.0)

    def spell(self, token: str) -> str:
        """The likeliest spelling among the look-alikes of a token."""
        paths = {(_EDGE, _EDGE): (0.0, "")}
        for ch in token:
            options = [ch, *([LATIN_TWINS[ch]] if ch in LATIN_TWINS else []), *ARABIC_TWINS.get(ch, "")]
            if ch in ARABIC_TWINS:
                options = options[1:]
            reached: dict[tuple[str, str], tuple[float, str]] = {}
            for (a, b), (s, done) in paths.items():
                for o in options:
                    v = s + self.score(a, b, o)
                    if (b, o) not in reached or v > reached[b, o][0]:
                        reached[b, o] = (v, done + o)
            paths = reached
        return max((s + self.score(a, b, _EDGE), done) for (a, b), (s, done) in paths.items())[1]


def count_trigrams(df: DataFrame) -> dict[str, int]:
    """Trigrams of all ordinary words of df.value, each word as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                found: list[str] = []
                for t in batch["value"].slice(start, 1024).to_pylist():
                    if t:
                        found += _ORDINARY.findall(t)
                if found:
                    flat = np.empty(len(found), dtype=object)
                    flat[:] = found
                    codes, unique = pd.factorize(flat)
                    for w, n in zip(unique, np.bincount(codes).tolist()):
                        p = _EDGE + _EDGE + w + _EDGE
                        for i in range(len(p) - 2):
                            seen[p[i : i + 3]] += n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])

    rows = df.select("value").where("value is not null").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r[0]: r[1] for r in rows}


def consistent(value: str, model: Model) -> str:
    """The consistent form of a value; visible differences (vowel marks, digits of another set, outer spaces) stay."""
    t = value
    if not _SUSPECT_RE.search(t) and not _HIGHER_RE.search(t):
        return t
    if _HIDDEN_RE.search(t):
        if _PERSIAN_ONLY.search(t):
            t = _JOINED_RE.sub("\x03", t)
        t = _HIDDEN_RE.sub("", t).replace("\x03", "‌")
    t = t.translate(_ALIKE)
    composed = unicodedata.normalize("NFC", t)
    t = composed if len(composed) != len(t) else t  # the order of vowel marks alone is no difference
    if _TWIN_RE.search(t):
        persian = [m.start() for m in _PERSIAN_ONLY.finditer(t)]
        t = _TOKEN_RE.sub(lambda m: m.group() if _near(m, persian) else _token(m.group(), model), t)
    if re.search("[۰-۳۷-۹]", t) and re.search("[٠-٩]", t) and not re.search("[۴-۶]", t):
        t = t.translate(_EXTENDED)
    return t


def _near(m: re.Match, places: list[int]) -> bool:
    """A word within a few words of a letter that only Persian has is Persian."""
    at = bisect.bisect_left(places, m.start() - PERSIAN_REACH)
    return at < len(places) and places[at] <= m.end() + PERSIAN_REACH


def _token(token: str, model: Model) -> str:
    if not _TWIN_RE.search(token) or _PERSIAN_ONLY.search(token):
        return token
    bare = MARKS_RE.sub("", token)
    scripts = {_script(c) for c in bare}
    if scripts <= {"c"} or scripts <= {"g"}:  # a word of that script
        return token
    spelled = model.spell(bare)
    if len(bare) == len(token):
        return spelled
    letters = iter(spelled)
    return "".join(c if MARKS_RE.match(c) else next(letters) for c in token)


def consistent_forms(df: DataFrame) -> DataFrame:
    """(src_table, rec_id, field, form, changed) of every value.

    df: src_table, rec_id, field, value; other columns are ignored. A null value has a null form and is not changed. The
    model is built from all values. Rows delivered twice give equal rows.
    """
    trigrams = count_trigrams(df)
    shared = df.sparkSession.sparkContext.broadcast(trigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for b in batches:
            values = b["value"].to_pylist()
            forms = [None if v is None else consistent(v, model) for v in values]
            changed = pa.array([v != f for v, f in zip(values, forms)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["src_table"], b["rec_id"], b["field"], pa.array(forms, pa.string()), changed], names=["src_table", "rec_id", "field", "form", "changed"])

    return df.select("src_table", F.col("rec_id").cast("bigint").alias("rec_id"), "field", "value").mapInArrow(run, "src_table string, rec_id bigint, field string, form string, changed boolean")


def changed_values(df: DataFrame) -> DataFrame:
    """(src_table, rec_id, field), distinct: the values whose form differs."""
    return consistent_forms(df).where("changed").select("src_table", "rec_id", "field").distinct()
