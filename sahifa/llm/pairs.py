"""Problem 1: defective question-answer pairs and the kind of their defect."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut
from .language import FEATURE_BITS, Languages, features
from .text import MARKS_RE, WORD_RE, compose, plain, script_of

#: log2 of the hashed tables of the end-of-text model: words and word pairs, all and those that end a sentence.
END_BITS = 18
#: Distinct words that a task holds before it sends their counts on.
WORDS_HELD = 500_000
#: Below this likelihood of an end after its last words a text without a final mark is broken off.
END_LIKELIHOOD = 0.03
#: Weight of a place in the article against the corpus behind it.
ARTICLE_WEIGHT = 100.0
#: Weight of the last word against the pair of the last two.
PAIR_BACKOFF = 2.0
#: Share of all words of a script from which a word is counted for its language (at most 1 / FREQUENT words are).
FREQUENT = 0.0005
#: Up to this share of all words a word is taken for a name.
RARE = 0.00005
#: Share of the question's words, in order, that a copy of it keeps; words a copy may add; words of another language.
COPY_SHARE, COPY_EXTRA, FOREIGN_WORDS = 0.7, 4, 4
QUESTION_ODDS = 10.0
#: Log odds from which the answer is taken to be in the other language.
FOREIGN_ODDS = 10.0

_SPLIT = re.compile(r"(?<=[.!?؟؛;…])[\"'»”)]*\s+|\n+")
_MARK = re.compile(r"[.!?؟]+[\"'»”’)\]]*$")
_OPEN = re.compile(r"(?:\.\.\.?|…|[،,؛;:\-–—])[\"'»”’)\]]*$")
_PARENS = re.compile(r"[(\[«][^()\[\]«»]*[)\]»]")
#: What others are quoted with says nothing of the answer itself.
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^“”\n]*”|«[^«»\n]*»")
_NUMBERED = re.compile(r"[^\W_]*\d[^\W_]*")
_LETTERS = re.compile(r"[^\W\d_]+")

#: Answers that say nothing, as words.
PLACEHOLDERS = frozenset(
    ["n a", "na", "none", "null", "nil", "nan", "tbd", "tba", "tbc", "todo", "no answer", "not available", "not applicable", "unknown", "undefined", "empty", "blank", "answer", "لا يوجد", "لا توجد", "لا شيء", "غير متوفر", "غير متوفرة", "غير متاح", "لا إجابة", "لا اجابة", "لا جواب", "لا توجد إجابة", "لا يوجد جواب", "بدون إجابة", "بلا إجابة", "فارغ", "غير معروف", "غير محدد", "الجواب", "الإجابة", "sans réponse", "aucune", "بدون پاسخ"]
)
#: Words that ask.
ASKING = frozenset("من ما ماذا متى أين لماذا كيف كم أي هل بم لم who whom whose what when where why how which qui que quoi quand où pourquoi comment combien quel quelle چه چرا کجا کی چگونه چند".split())

#: Cues by which a speaker declines or says that the answer is not known. Polite openings alone are none.
#: All begin a word: one boundary before the alternatives spares trying each of them inside words.
_REFUSALS = re.compile(
    r"\b(?:"
    + "|".join(
        [
            # Arabic, first person or about what is given
            r"\b(?:لا|لن|لست|ليس)\s+(?:أستطيع|استطيع|يمكنني|بإمكاني|بوسعي|أقدر|أعرف|اعرف|أعلم|اعلم|أدري|أملك|أمتلك|لدي|عندي|في وسعي)",
            r"\bلم\s+(?:أجد|أعثر|أتمكن|أستطع|أستدل)\b",
            r"\bلا\s+علم\s+لي\b|\bلا\s+يسعني\b|\bلست\s+(?:قادرا|متأكدا|مخولا|واثقا)\b|\bغير\s+قادر(?:ة)?\s+على\s+(?:الإجابة|الرد|المساعدة)",
            r"\b(?:يتعذر|تعذر|يصعب|يستحيل)\s+علي\b|\b(?:سأمتنع|أمتنع|أعتذر)\s+عن\s+(?:الرد|الإجابة|الجواب|الخوض|المساعدة|عدم)|\b(?:أفضل|افضل)\s+(?:عدم|ألا)\b|\bلا\s+أود\b|\bأرفض\b",
            r"\bلا\s+(?:تسمح|تكفي)\s+(?:لي\s+)?ب?(?:الجواب|الإجابة|الرد)|\bخارج\s+(?:نطاق|حدود)\s+(?:ما|معرفتي|قدرتي|صلاحياتي)",
            r"\b(?:لا|لم|ليس)\s+(?:تذكر|يذكر|يرد|ترد|تتضمن|يتضمن|تحتوي|يحتوي|تشر|يشر|تتوفر|يتوفر|تتوافر|توجد|يوجد)\s+(?:في\s+)?(?:المقالة|المقال|النص|المصدر|المصادر|لدي|أي\s+)?\s*(?:معلومة|معلومات|معطيات|إجابة|جواب|شيئا|شيء|ما\s+يجيب)",
            r"\bلا\s+يمكن\s+(?:الإجابة|الرد|معرفة|الجزم)\b|\b(?:الجواب|الإجابة)\s+(?:غير\s+(?:معروف|متوفر|متاح|واضح)ة?|ليست?\s+(?:معروف|متوفر)ة?)",
            # English
            r"\b(?:i|we)\s*(?:'m|am|are)?\s*(?:really\s+|simply\s+)?(?:can't|can not|cannot|can’t|couldn't|could not|won't|will not|am unable|unable|not able|not allowed|do not know|don't know|don’t know|have no idea|have no information|do not have|don't have|don’t have)\b",
            r"\bi(?:'m|’m| am)\s+(?:unable|not able|not sure|not allowed|not in a position)\b|\bi\s+(?:have to|must|would|will)\s+(?:decline|refuse|pass)\b|\bi\s+(?:would|'d|’d)\s+(?:rather|prefer)\s+not\b|\bi\s+(?:would|'d|’d)\s+prefer\s+to\s+(?:not|leave)\b",
            r"\bnot\s+possible\s+for\s+me\b|\bbeyond\s+what\s+i\s+(?:may|can|am)\b|\bnothing\s+(?:i|we)\s+(?:was|were|am|have been)\s+given\b|\boutside\s+(?:what|the scope of what)\s+i\b|\b(?:does not|doesn't|doesn’t|do not)\s+(?:say|mention|state|tell|contain)\s+(?:anything|who|what|when|where|why|how|that|this|the answer|enough|it)\b",
            r"\b(?:gives?|tells?|offers?)\s+(?:me|us)\s+(?:nothing|no)\b|\bnot\s+enough\s+(?:information|detail|details|data)\b|\bnothing\s+(?:in|is)\s+(?:the\s+(?:text|article|passage)|said)\b|\bfind\s+(?:nothing|no\s+\w+)\s+(?:on|about|in)\b",
            r"\b(?:the\s+)?answer\s+(?:is|was)\s+(?:not\s+known|unknown|not\s+available)\b|\bno\s+(?:information|answer)\s+(?:is|was|about|on)\b|\bleave\s+it\s+unanswered\b",
            # French, Spanish, German
            r"\bje\s+ne\s+(?:peux|puis|sais|suis|connais|dispose|souhaite)\b|\bil\s+m'?est\s+impossible\b|\bje\s+(?:préfère|dois)\s+(?:ne\s+pas|refuser|décliner)\b|\bno\s+(?:puedo|sé|tengo|dispongo)\b|\bich\s+(?:kann|weiß|darf)\s+(?:das|es|diese|leider|nicht|dazu)\b|\bleider\s+kann\s+ich\b",
            # Persian
            r"نمی\s*‌?\s*(?:توانم|دانم)|اطلاعی\s+ندارم|پاسخ\s+(?:نمی|این\s+پرسش\s+را\s+نمی)|متأسفانه\s+(?:نمی|این)|معذورم",
        ]
    )
    + ")"
)


_MASK = (1 << END_BITS) - 1


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & _MASK


def _pair_bucket(a, b):
    """The bucket of two neighbouring words, from their buckets; for numbers and arrays."""
    h = a * 40503 + b * 60493
    return (h ^ (h >> 9)) & _MASK


def _tokens(t: str) -> list[str]:
    """Words for the end-of-text model; all numbers are one word."""
    return WORD_RE.findall(_NUMBERED.sub("0", t))


def corpus_model(df: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Counts over all kept rows: the end-of-text tables (4, 2**END_BITS), and language features of the frequent words.

    Names say nothing of a language, so only words that make up FREQUENT of all words of a script are counted for it.
    Words are counted over the whole corpus before any is left out, so batches and files change nothing. The end tables
    have a fixed size; partial counts are summed per partition and then per table.
    """
    size = 1 << END_BITS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.zeros((4, size), dtype=np.int64)
        seen: Counter = Counter()

        def out(names: list, words: list, counts: list, tables: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(tables, pa.binary())], names=["name", "word", "n", "counts"])

        def words_of() -> pa.RecordBatch:
            return out(["ar" if w[0] >= "\u0600" else "en" for w in seen], list(seen), list(seen.values()), [None] * len(seen))

        for b in batches:
            flat: list[str] = []
            lengths: list[int] = []
            for article, qa in zip(b["article"].to_pylist(), b["qa_pairs"].to_pylist()):
                for s in _SPLIT.split(plain(article)) if article else ():
                    if _MARK.search(s) and len(w := _tokens(s)) >= 3:
                        flat += w
                        lengths.append(len(w))
                for q in qa or ():
                    if q and q["question"] and script_of(q["question"]) != "none":
                        seen.update(_LETTERS.findall(q["question"].lower()))
            if flat:
                words = np.empty(len(flat), dtype=object)
                words[:] = flat
                codes, unique = pd.factorize(words)
                for w, n in zip(unique, np.bincount(codes).tolist()):
                    seen[w] += n
                at = np.fromiter((_bucket(w) for w in unique), dtype=np.int64, count=len(unique))[codes]
                last = np.cumsum(lengths) - 1
                pairs = _pair_bucket(at[:-1], at[1:])
                inside = np.ones(len(pairs), dtype=bool)
                inside[last[:-1]] = False
                for i, x in enumerate((at, pairs[inside], at[last], pairs[last - 1])):
                    ends[i] += np.bincount(x, minlength=size)
            if len(seen) > WORDS_HELD:
                yield words_of()
                seen.clear()
        if seen:
            yield words_of()
        yield out([f"e{i}" for i in range(4)], [None] * 4, [None] * 4, [t.tobytes() for t in ends])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, raw in zip(b["name"].to_pylist(), b["counts"]):
                t = np.frombuffer(raw.as_py(), dtype=np.int64)
                sums[name] = sums[name] + t if name in sums else t
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([t.tobytes() for t in sums.values()], pa.binary())], names=["name", "counts"])

    both = cut(df.select("article", "qa_pairs").mapInArrow(partial, "name string, word string, n bigint, counts binary"))
    rows = both.where("counts is not null").select("name", "counts").repartition("name").mapInArrow(merge, "name string, counts binary").collect()
    got = {r[0]: np.frombuffer(r[1], dtype=np.int64) for r in rows}
    ends = np.array([got.get(f"e{i}", np.zeros(size, dtype=np.int64)) for i in range(4)])
    words = both.where("counts is null").groupBy("name", "word").agg(F.sum("n").alias("n"))
    totals = {r["name"]: r["t"] for r in both.where("counts is null").groupBy("name").agg(F.sum("n").alias("t")).collect()}  # two rows
    least = F.lit(None)
    for name, t in totals.items():
        least = F.when(F.col("name") == name, F.lit(max(5, FREQUENT * t))).otherwise(least)
    features_of = {x: np.zeros(1 << FEATURE_BITS, dtype=np.int64) for x in totals}
    for r in words.where(F.col("n") >= least).collect():  # at most 1 / FREQUENT words for each script
        np.add.at(features_of[r["name"]], features(r["word"]), r["n"])
    return ends, features_of


class Judge:
    """Decides on single pairs."""

    def __init__(self, ends: np.ndarray, languages: Languages) -> None:
        self.ends, self.languages, self.total = ends, languages, int(ends[0].sum())
        self.words = ends[0].tolist()

    def defect(self, question: str | None, answer: str | None, article: str | None) -> str | None:
        if answer is None:
            return "empty"
        a = plain(answer).strip()
        words = WORD_RE.findall(a)
        if not words or " ".join(words) in PLACEHOLDERS:
            return "empty"
        q = plain(question or "").strip()
        asked = WORD_RE.findall(q)
        if _refuses(a):
            return "refusal"
        if asked and _copies(asked, words, a):
            return "copied_question"
        if self._foreign(question or "", answer):
            return "other_language"
        return "truncated" if self._breaks_off(a, plain(article or ""), q) else None

    def _foreign(self, question: str, answer: str) -> bool:
        body = _PARENS.sub(" ", answer)
        if len(WORD_RE.findall(body)) < FOREIGN_WORDS or not question.strip():
            return False
        names = self.languages.names
        usual = names.index("ar" if script_of(question) == "ar" else "en")
        given = self.languages.log_posteriors(self._without_names(body))
        other = int(given.argmax())
        asked = self.languages.log_posteriors(question)
        if other == usual == int(asked.argmax()):
            return False
        asked = self.languages.log_posteriors(self._without_names(_PARENS.sub(" ", question)))
        own = int(asked.argmax())
        if asked[own] - asked[usual] < QUESTION_ODDS:  # a short question is taken to be in the usual language of its script
            own = usual
        if own == other:
            return False
        # the answer must be far likelier in the other language than in that of the question
        return bool(given[other] - given[own] > FOREIGN_ODDS)

    def _without_names(self, text: str) -> str:
        """The text without words that are rare, but not unknown, in the corpus: mostly names, which say nothing of a language."""
        bare = MARKS_RE.sub("", compose(text))
        found = [w for s in _SPLIT.split(bare) for i, w in enumerate(WORD_RE.findall(s)) if i == 0 or not (w[0].isupper() and w[0] < "\u0250")]
        counts, most = self.words, RARE * self.total
        kept = []
        for w in found:
            n = counts[_bucket(w.lower())]
            if n == 0 or n > most:
                kept.append(w)
        return " ".join(kept) if len(kept) >= 3 else text

    def end_likelihood(self, words: list[str], article_words: list[str], article_ends: set[int]) -> float:
        """Likelihood that a text may end after its last words: those of the article first, backed off to the corpus."""
        w = _tokens(" ".join(words[-2:]))
        if not w[-1].isascii() and len(w[-1]) == 1 or w[-1] == "ال":
            return 0.0
        b1 = _bucket(w[-1])
        p = (self.ends[2, b1] + 0.5) / (self.ends[0, b1] + 2.0)
        if len(w) > 1:  # the pair, backed off to the last word
            b2 = _pair_bucket(_bucket(w[-2]), b1)
            p = (self.ends[3, b2] + PAIR_BACKOFF * p) / (self.ends[1, b2] + PAIR_BACKOFF)
        # the article as the closest context: where its words run as these do
        for k in (5, 4, 3):
            if len(words) < k:
                continue
            tail = words[-k:]
            at = [i + k - 1 for i in range(len(article_words) - k + 1) if article_words[i : i + k] == tail]
            if at:
                ended = sum(i in article_ends for i in at)
                return (ARTICLE_WEIGHT * ended + p) / (ARTICLE_WEIGHT * len(at) + 1.0)
        if len(words) >= 3:  # a word that breaks off inside
            tail = words[-3:-1]
            for i in range(len(article_words) - 2):
                if article_words[i : i + 2] == tail and article_words[i + 2] != words[-1] and article_words[i + 2].startswith(words[-1]):
                    return 0.0
        return p

    def _breaks_off(self, a: str, article: str, q: str) -> bool:
        if _OPEN.search(a) or _unclosed(a):
            return True
        if _MARK.search(a) or a.endswith((")", "]", "»", "”")):
            return False
        words = WORD_RE.findall(a)
        pieces = _SPLIT.split(a)
        if len(pieces) > 1 and len(WORD_RE.findall(pieces[-1])) <= 2:
            return True  # a sentence was only begun
        spans = [(m.group(), m.end()) for m in WORD_RE.finditer(article)]
        article_words = [s for s, _ in spans]
        ends = {i for i, (_, e) in enumerate(spans) if re.match(r"[\"'»”)\]]*\s*(?:[.!?؟؛;…\n]|$)", article[e : e + 6])}
        if len(words) <= 3:
            # short complete answers: whole words that do not lead on
            if words[-1].isdigit():
                return False
            known = words[-1] in article_words
            b1 = _bucket(words[-1])
            leads = self.ends[0, b1] >= 50 and self.ends[2, b1] < 0.002 * self.ends[0, b1]
            partial = not known and any(x.startswith(words[-1]) for x in article_words)
            verb = len(words) > 1 and words[0] not in q and any(article_words[i - 1 : i + 1] == words[:2] and (i < 2 or i - 2 in ends) for i in range(1, len(article_words)))
            return bool(leads or partial or verb)
        if words[-1] not in article_words and words[-1] not in q and any(x == words[-2] and y.startswith(words[-1]) for x, y in zip(article_words, article_words[1:])):
            return True  # the article has a longer word here
        return self.end_likelihood(words, article_words, ends) < END_LIKELIHOOD


def _unclosed(a: str) -> bool:
    """A quotation mark or bracket is opened in the last sentence and not closed."""
    return a.count('"') % 2 == 1 or any(a.count(x) > a.count(y) for x, y in ("()", "[]", "«»", "“”"))


def _refuses(a: str) -> bool:
    said = _QUOTED.sub(" ", a)
    # an answer that is a quotation as a whole is judged by what it says
    return bool(_REFUSALS.search((said if WORD_RE.search(said) else a).replace("’", "'")))


def _copies(asked: list[str], words: list[str], a: str) -> bool:
    """The answer gives back the question, possibly altered a little or twice, and little else."""
    if len(words) > 6 * len(asked) + COPY_EXTRA:
        return False
    if sum(map(set(words).__contains__, asked)) < COPY_SHARE * len(asked):
        return False
    at, end, copies = 0, 0, 0
    while at < len(words):
        blocks = [m for m in SequenceMatcher(None, asked, words[at:], autojunk=False).get_matching_blocks() if m.size]
        if sum(m.size for m in blocks) < COPY_SHARE * len(asked):
            break
        lead, end = (blocks[0].b if not copies else 0), at + blocks[-1].b + blocks[-1].size
        reached = blocks[-1].a + blocks[-1].size == len(asked)
        inside = blocks[-1].b + blocks[-1].size - blocks[0].b - sum(m.size for m in blocks)
        if lead > COPY_EXTRA or inside > COPY_EXTRA or inside > 0.5 * len(asked):
            return False
        at, copies = end, copies + 1
    # what follows the question is an answer, unless the question's own last word was only changed
    if not copies or len(words) - end > (not reached):
        return False
    first = next((w for w in asked if w in ASKING), None)
    return first is None or first in words or a.rstrip("\"'»”)").endswith(("?", "؟"))


def defective_pairs(df: DataFrame) -> DataFrame:
    """(rec_id, pair_pos, defect), distinct: the defective pairs of the kept records.

    df: rec_id, skip, article, qa_pairs; other columns are ignored. Records with skip = true, null qa_pairs or a null
    rec_id give no row; a null skip counts as kept. A null pair or answer is empty; a null question only rules out the
    comparisons with it, a null article leaves the corpus model to judge where an answer may end.
    """
    kept = df.select("rec_id", "skip", "article", "qa_pairs").where("not coalesce(skip, false) and qa_pairs is not null and rec_id is not null")
    model = df.sparkSession.sparkContext.broadcast(corpus_model(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, counts = model.value
        judge = Judge(ends, Languages(counts))
        for b in batches:
            rows = []
            for rec, article, qa in zip(b["rec_id"].to_pylist(), b["article"].to_pylist(), b["qa_pairs"].to_pylist()):
                for pos, pair in enumerate(qa):
                    defect = judge.defect(pair["question"], pair["answer"], article) if pair else "empty"
                    if defect:
                        rows.append((rec, pos, defect))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string()))], names=["rec_id", "pair_pos", "defect"])

    return kept.select("rec_id", "article", "qa_pairs").mapInArrow(run, "rec_id bigint, pair_pos int, defect string").distinct()
