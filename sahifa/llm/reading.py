"""Problem 9: the reading level of each document."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut
from .prose import STATISTICS
from .quality import MEASURED, measured, score
from .text import MARKS_RE, compose, script_of

#: Levels are fitted on at most this many labelled samples.
SAMPLE_BOUND = 20_000
_TERMINAL = re.compile(r"(?<=[.!?؟؛;…])[\"'»”)]*\s+")
_FINAL = re.compile(r"[.!?؟؛;…][\"'»”)]*$")
#: A comma and a conjunction before a word that opens a sentence: sentences that were only strung together.
_STRUNG = re.compile(r",\s+and\s+(?=(?:The|An?|In|On|At|By|For|Since|Until|After|Before|During|Between|Within|Late|Early|As|My|Our|So|Today|One|Last|Then|It|He|She|They|We|There|This|That)\b)|،\s+و(?=(?:في|مع|بعد|قبل|منذ|خلال|عند|بين|حتى|طوال|عقب|بحلول|ثم|أمس|اليوم|كل|وقت|بعدها)\s|ال)")
_WORD = re.compile(r"[^\W\d_]+")
_EN_VOWELS = re.compile("[aeiouyàâäéèêëîïôöûü]+")
_EN_SILENT = re.compile(r"(?:[^aeiouylr]e|[^aeiouy]es|[^aeioutd]ed)$")
_AR_LONG = re.compile("[اوىيآؤئ]")
_AR_PREFIX = re.compile("^(?:[وفبكل]?ال|لل)")


@lru_cache(maxsize=100_000)
def syllables(word: str, lang: str) -> int:
    """Syllables by hyphenation-style rules.

    English: groups of vowels, a silent e at the end not counted, at least one. Arabic without vowel marks: a syllable
    for each consonant but one that closes a syllable, taken as long vowels plus every second remaining letter.
    """
    if lang == "en":
        n = len(_EN_VOWELS.findall(word))
        if n > 1 and _EN_SILENT.search(word):
            n -= 1
        return max(1, n)
    stem = _AR_PREFIX.sub("", word)
    long = len(_AR_LONG.findall(stem))
    rest = len(stem) - long
    return max(1, long + max(0, math.ceil((rest - long) / 2))) + (stem != word)


def sentences(text: str) -> list[str]:
    """The sentences of a text, whatever its layout.

    A line break ends a sentence unless the line has no final mark and is filled up, that is, the first word of the next
    line would not have fitted into the width: then, where most such lines of the paragraph or of the run of lines are
    full, it is a space. The width is that of the unfinished lines of a run. A line that goes on in lower case always does.
    """
    out: list[str] = []
    for p in re.split(r"\n\s*\n", text):
        lines = [x.strip() for x in p.split("\n") if x.strip()]
        joined = lines[:1]
        for filled, b in zip(_filled(lines), lines[1:]):
            if filled or b[:1].islower():
                joined[-1] += " " + b
            else:
                joined.append(b)
        out += [s for x in joined for y in _TERMINAL.split(x) for s in _STRUNG.split(y) if s.strip()]
    return out


def _filled(lines: list[str]) -> list[bool]:
    """For each line but the last, whether it was broken because the next word did not fit."""
    unfinished = [not _FINAL.search(x) for x in lines[:-1]]
    full = [False] * len(unfinished)
    runs: list[list[int]] = []
    for i, u in enumerate(unfinished):
        if u:
            if i and unfinished[i - 1]:
                runs[-1].append(i)
            else:
                runs.append([i])
    for run in runs:
        width = max(len(lines[i]) for i in run)
        for i in run:
            full[i] = len(lines[i]) + 1 + len(lines[i + 1].split(" ", 1)[0]) > width
        # lines of one number of words
        sizes = Counter(len(lines[i].split()) for i in run)
        if len(run) >= 4 and max(sizes.values()) >= 0.75 * len(run):
            usual = sizes.most_common(1)[0][0]
            for i in run:
                full[i] = full[i] or len(lines[i].split()) == usual
    several = [i for run in runs if len(run) > 1 for i in run]
    paragraph = bool(several) and sum(full[i] for i in several) >= 0.6 * len(several)
    for run in runs:
        if not paragraph and (len(run) < 2 or sum(full[i] for i in run) < 0.6 * len(run)):
            for i in run:
                full[i] = False
    return full


@lru_cache(maxsize=200_000)
def _word(word: str, lang: str) -> tuple[int, int, bool, bool]:
    n = syllables(word, lang)
    return len(word), n, n >= (3 if lang == "en" else 4), len(word) > 6


def counts(sentence: str, lang: str) -> tuple[int, float, float, float, float] | None:
    """Words of a sentence and, per word, its letters, syllables, hard and long words; None without words."""
    found = _WORD.findall(sentence)
    if not found:
        return None
    n = len(found)
    letters, syllable, hard, long = map(sum, zip(*[_word(x, lang) for x in found]))
    return n, letters / n, syllable / n, hard / n, long / n


def estimate(text: str | None) -> tuple[str, float] | None:
    """(language, grade) of a text; None for a null or blank one or one without words.

    Each quantity of the formulas is the median over the sentences, so that a few sentences of another level, or a few
    that were strung together, do not move it. The grade is the median of the formulas' estimates.
    """
    if text is None or not text.strip():
        return None
    t = MARKS_RE.sub("", compose(text))
    lang = "en" if script_of(t) != "ar" else "ar"
    rows = [c for s in sentences(t) if (c := counts(s.lower(), lang))]
    if not rows:
        return None
    n, letters, syllable, hard, long = (median(c) for c in zip(*rows))
    estimates = (
        0.39 * n + 11.8 * syllable - 15.59,  # Flesch-Kincaid
        0.4 * (n + 100 * hard),  # Gunning fog
        4.71 * letters + 0.5 * n - 21.43,  # automated readability
        n * (1 + 2 * hard) / 2 - (n * (1 + 2 * hard) <= 20),  # Linsear Write
        (n + 100 * long) / 4,  # LIX, brought to the scale of grades
    )
    return lang, median(estimates)


def fit_levels(samples: DataFrame) -> dict[str, list[float]]:
    """Cut points between the levels for each language, from labelled samples(lang, reading_level, text).

    A cut lies halfway between the medians of the grades of neighbouring levels.
    """
    got: dict[str, dict[int, list[float]]] = {}
    rows = samples.select("text", "reading_level").where("text is not null and reading_level is not null").limit(SAMPLE_BOUND + 1).collect()
    if len(rows) > SAMPLE_BOUND:
        raise ValueError(f"more than {SAMPLE_BOUND} samples")
    for text, level in rows:
        if e := estimate(text):
            got.setdefault(e[0], {}).setdefault(level, []).append(e[1])
    cuts = {}
    for lang, by in got.items():
        levels = sorted(by)
        cuts[lang] = [_cut(by[a], by[b]) for a, b in zip(levels, levels[1:])]
    return cuts


def _cut(low: list[float], high: list[float]) -> float:
    """The point that parts two groups with the fewest errors, in the middle of the widest such gap."""
    points = sorted({*low, *high})
    best = min(((sum(x > c for x in low) + sum(x <= c for x in high), -gap, c) for c, gap in (((a + b) / 2, b - a) for a, b in zip(points, points[1:]))), default=(0, 0, points[0]))
    return best[2]


def reading_levels(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, lang, grade, reading_level) of each document that is prose.

    docs: doc_id, text; other columns are ignored. Null, blank and wordless texts, lists, tables and junk give no row; a
    doc_id that occurs twice gives two rows. Without samples of a language the cuts of the other language hold; without
    any samples there are no rows.
    """
    cuts = fit_levels(samples)
    names = ["doc_id", "read_lang", "grade", "reading_level", "lang", *STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            found = [estimate(t) if cuts else None for t in texts]
            levels = [e and 1 + sum(e[1] > c for c in cuts.get(e[0]) or next(iter(cuts.values()))) for e in found]
            own = [pa.array([e and e[0] for e in found], pa.string()), pa.array([e and round(e[1], 3) for e in found], pa.float64()), pa.array(levels, pa.int32())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *own, *measured(texts)], names=names)

    rated = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, f"doc_id bigint, read_lang string, grade double, reading_level int, {MEASURED}")
    rated = cut(rated.where("lang is not null").withColumn("row", F.monotonically_increasing_id()))
    prose = score(rated.select("row", "lang", *STATISTICS), ["row"]).where("kind = 'prose'").select("row")
    return rated.where("reading_level is not null").join(prose, "row").select("doc_id", F.col("read_lang").alias("lang"), "grade", "reading_level")


def level_profile(levels: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents and mean grade by source, language and level."""
    joined = levels.join(docs.select("doc_id", F.lower(F.trim("source")).alias("source")), "doc_id", "left")
    return joined.groupBy("source", "lang", "reading_level").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("grade"), 3).alias("mean_grade"))
