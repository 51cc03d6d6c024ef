"""Statistics that tell running prose from lists, tables and junk."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from operator import eq

from .text import MARKS_RE, compose

#: Frequent words of the two languages that prose cannot do without.
COMMON = {
    "ar": frozenset(
        "في من على إلى الى عن مع بعد قبل حتى منذ خلال بين عند أن إن التي الذي كان كانت قد لم لا ما هذا هذه ذلك هناك كل ثم أو لكن غير كما وهو وهي به بها له لها عليه فيه فيها منه منها لأن حيث سنة عام قرب تحت فوق أمام داخل خلف دون وفق ضمن وقد وكان ومن وفي هو هي أثناء بجوار".split()
    ),
    "en": frozenset(
        "the of and a an in to at by on for with from after before during since until it its was were is are be been that this which who as his her he she they their my our but so not or had has have near between under over into about than then when while where".split()
    ),
}
_COMMON = COMMON["ar"] | COMMON["en"]
_BULLET = re.compile(r"^[^\S\n]*(?:[^\w\s\"'«“‘(\[<]{1,2}\s+|\[.?\]\s+|\(?\d{1,3}[.)\-]\s+|\d{1,3}\s*[-–]\s+|\(?(?:[a-zA-Z]|[ivxlcIVXLC]{1,6}|[ء-ي])[.)]\s+)")
_BULLETS = re.compile(_BULLET.pattern, re.M)
_END = re.compile(r"[.!?؟…]+[\"'»”)]*\s*$")
_CLOSE = re.compile(r"[.!?؟]+[\"'»”)]*(?:\s+|$)")
_PARTS = re.compile(r"[\s,;|؛،]+")
_TAG = re.compile(r"<[^<>]+>")
_MOJI = re.compile(r"[ØÙÚÃÂŘŮ][\u0080-ɏˀ-˿ -⋿§©®°±¶·¡¢£¤¥¦¨ª«¬¯²³´µ¸¹º»¼½¾¿]")
_WORD = re.compile(r"[^\W\d_]{2,}")
_LETTERS = re.compile(r"[^\W\d_]++(?!\d)")
_DIGIT = re.compile(r"\d").search
_FIGURE = re.compile(r"^[-–—+]?[\d.,٫٬]*\d\s*%?$")
_MARKS_IN = re.compile(r"[^\w\s]")
_MISPLACED = re.compile("[ةى](?=[ء-ي])|ء(?=[ء-ي])(?<!^ء)|[ىة]{2}")
_CONSONANTS = re.compile("[^aeiouyéèêôîûàâëïüöäá]{5,}")
_VOWEL = re.compile("[aeiouyéèêôîûàâëïüöäá]")
_EDGES = ".,،;:؛!?؟…()[]«»\"'"
#: What sets entries or cells apart, besides lines and any mark that stands alone again and again.
_SEPARATORS = ("||", "!!", "|", "\t", "•", "·", "▪", " * ", " / ", " - ", " – ", ";", "؛", ",", "،", "  ")
#: So often, and for so many words once, a separator must occur to set cells apart.
LEAST_CUTS, WORDS_A_CUT = 6, 9
#: Most words of an entry or cell, and of an entry that is marked.
ENTRY_WORDS, MARKED_WORDS = 5, 9
#: Words of a run that is repeated again and again.
ECHO_WORDS = 10
#: Words of a sentence.
SENTENCE_WORDS = (6, 60)
#: A text under so many tokens and characters is a word or a short sentence: nothing to tell apart.
SHORT_TOKENS, SHORT_CHARS = 6, 60

STATISTICS = [
    "word_count", "mean_word_length", "symbol_ratio", "ended_line_share", "common_word_share", "distinct_word_share", "sentence_length", "digit_token_share",
    "entry_share", "figure_cell_share", "bar_share", "noise_share", "unreadable_share", "echo_share", "letter_run_length", "single_letter_share", "closed_share", "short",
]


def _cells(t: str, lines: list[str], tokens: int, alone: Counter) -> list[list[str]]:
    """The ways to cut a text into cells: by lines, by each separator that occurs often enough (alone: marks that stand alone), and by tags."""
    ways = [lines] if len(lines) >= 4 else []
    least = max(LEAST_CUTS, tokens / WORDS_A_CUT)
    for sep in (*_SEPARATORS, *(f" {x} " for x, n in alone.most_common(2) if n >= LEAST_CUTS)):
        if t.count(sep) >= least:
            cut = re.split(r"\s{2,}", t) if sep == "  " else re.split(re.escape(sep) + "|\n", t)
            ways.append([c for x in cut if (c := x.strip())])
    if t.count("<") >= LEAST_CUTS and len(tags := _TAG.split(t)) > LEAST_CUTS:
        ways.append([c for x in tags if (c := x.strip())])
    return ways


def _entries(cells: list[str], tokens: int) -> tuple[float, float]:
    """Share of the words that are in entries, and share of the cells that are figures.

    An entry is a cell of few words that does not end like a sentence and has no word that only holds sentences together.
    """
    held = figures = real = 0
    for c in cells:
        m = _BULLET.match(c)
        body = c[m.end() :] if m else c
        n = body.count(" ") + 1
        if n <= 2 and _FIGURE.match(body):
            figures += 1
            real += 1
            continue
        real += any(map(str.isalnum, c))
        if n <= (MARKED_WORDS if m else ENTRY_WORDS) and not _END.search(body) and (w := _WORD.findall(body.lower())) and not _COMMON.intersection(w):
            held += n + (c[: m.end()].count(" ") if m else 0)
    return min(1.0, held / max(1, tokens)), figures / real if real >= LEAST_CUTS else 0.0


@lru_cache(maxsize=200_000)
def _odd(word: str) -> bool:
    return len(word) > 18 or bool(_CONSONANTS.search(word)) or (len(word) > 3 and len(_VOWEL.findall(word)) < 0.16 * len(word))


def measures(text: str) -> dict[str, float]:
    """Statistics of one text that is neither null nor blank, to four digits; short is 1 for a word or a short sentence."""
    t = MARKS_RE.sub("", compose(text)).strip()
    tokens = t.split()
    n = len(tokens)
    lines = [x for x in map(str.strip, t.split("\n")) if x]
    bodies = _BULLETS.sub("", t).lower()
    runs = _LETTERS.findall(bodies)
    w = [x for x in runs if len(x) > 1]
    words = max(1, len(w))
    letters = sum(map(len, w))
    chars = max(1, sum(map(len, tokens)))
    counts = Counter(w)
    other = [x for x in tokens if not x.isalpha()]
    alone = Counter(x for x in other if not any(map(str.isalnum, x)))
    ways = [_entries(c, n) for c in _cells(t, lines, n, alone)]
    # Latin words that nobody can pronounce, Arabic letters where they cannot stand
    odd = sum(m for x, m in counts.items() if x[0] < "ɐ" and _odd(x)) + (0 if t.isascii() else len(_MISPLACED.findall(t)))
    # an echo of half the words leaves few different ones
    echo = 0.0
    if len(counts) <= 0.5 * len(w) + ECHO_WORDS:
        echo = max((sum(map(eq, w, w[p:])) / (len(w) - p) for p in range(1, ECHO_WORDS + 1) if len(w) >= 2 * p + 2), default=0.0)
    wrong = 2 * len(_MOJI.findall(t)) + sum(map(len, _TAG.findall(t)))
    # strings of many marks, and strings that no word is as long as
    wrong += sum(len(x) for x in tokens if len(x) > 30 and x.isalpha())
    wrong += sum(len(x) for y in other if not y.strip(_EDGES).isalnum() or len(y) > 30 for x in _PARTS.split(y) if len(x) > 30 or (len(x) >= 4 and len(set(_MARKS_IN.findall(x))) >= 3))
    # what stands after the last final mark is no closed sentence
    pieces = _CLOSE.split(bodies)
    sentences = [(k, x) for x in pieces[:-1] if SENTENCE_WORDS[0] <= (k := x.count(" ") + x.count("\n") + 1) <= SENTENCE_WORDS[1]]
    closed = sum(k for k, x in sentences if len(_COMMON.intersection(x.split())) >= 2)
    found = {
        "word_count": n,
        "mean_word_length": chars / max(1, n),
        "symbol_ratio": 1 - letters / chars,
        "ended_line_share": sum(bool(_END.search(x)) for x in lines) / max(1, len(lines)),
        "common_word_share": sum(map(_COMMON.__contains__, w)) / words,
        "distinct_word_share": len(counts) / words,
        "sentence_length": n / max(1, len(pieces) - (not pieces[-1].strip())),
        "digit_token_share": sum(map(bool, map(_DIGIT, other))) / max(1, n),
        "entry_share": min(max((e for e, _ in ways), default=0.0), 1 - min(1.0, sum(k for k, _ in sentences) / max(1, n))),
        "figure_cell_share": max((f for _, f in ways), default=0.0),
        "bar_share": min(1.0, (t.count("|") + t.count("\t") + t.count("!!")) / max(1, n)),
        "noise_share": min(1.0, wrong / chars),
        "unreadable_share": min(1.0, odd / words),
        "echo_share": echo,
        "letter_run_length": sum(map(len, runs)) / max(1, len(runs)),
        "single_letter_share": (len(runs) - len(w)) / max(1, len(runs)),
        "closed_share": min(1.0, closed / max(1, n)),
        "short": n < SHORT_TOKENS and len(t) < SHORT_CHARS,
    }
    return {k: round(float(v), 4) for k, v in found.items()}
