"""Text primitives shared by the training-data operators (run inside Arrow batches).

Every function takes and returns whole texts; nothing is cut or sampled.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pandas as pd

# Characters that never show: format controls, fillers and variation selectors.
IGNORABLE = (
    "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯"
    "ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff"
)
IGNORABLE_RE = re.compile(f"[{IGNORABLE}]")
#: Arabic vowel marks and the stretching mark; letters with hamza or madda are composed before these go.
MARKS = "ؐ-ؚـً-ٰٟۖ-ۭ"
MARKS_RE = re.compile(f"[{MARKS}]+")
WORD_RE = re.compile(r"[^\W_]+")

_DIGITS = {c: str(unicodedata.decimal(chr(c))) for c in range(0x100, sys.maxunicode) if unicodedata.category(chr(c)) == "Nd"}
_DIGIT_RE = re.compile("[٠-٩۰-۹߀-߉०-९０-９]")
_PERSIAN = (("ى", "ي"), ("ی", "ي"), ("ک", "ك"), ("ے", "ي"), ("ہ", "ه"), ("ھ", "ه"))
_PERSIAN_RE = re.compile("[یکىےہھ]")
_ALEF = (("أ", "ا"), ("إ", "ا"), ("آ", "ا"), ("ٱ", "ا"))


def _replaced(t: str, pairs: tuple[tuple[str, str], ...]) -> str:
    # replace() runs over the buffer at once; translate() looks up each character
    for old, new in pairs:
        t = t.replace(old, new)
    return t


#: Letters of other scripts that are drawn like a Latin letter (Cyrillic and Greek).
LATIN_TWINS = dict(
    zip(
        "аеорсухіјѕһԁԛԝӏАВЕКМНОРСТХУІЈЅЗ",
        "aeopcyxijshdqwlABEKMHOPCTXYIJS3",
    )
) | dict(
    zip(
        "οανρυικχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "oavpuikxyABEZHIKMNOPTYX",
    )
)
_TWIN_RE = re.compile("[" + "".join(LATIN_TWINS) + "]")
_TWIN_TABLE = {ord(k): v for k, v in LATIN_TWINS.items()}


def compose(t: str) -> str:
    """Compatibility composition with invisible characters deleted."""
    if t.isascii():
        return t
    if IGNORABLE_RE.search(t):
        t = IGNORABLE_RE.sub("", t)
    return unicodedata.normalize("NFKC", t)


def plain(t: str) -> str:
    """compose() without vowel marks, digits in 0-9, lower case."""
    t = compose(t)
    if not t.isascii():
        if MARKS_RE.search(t):
            t = MARKS_RE.sub("", t)
        if _DIGIT_RE.search(t):
            t = t.translate(_DIGITS)
    return t.lower()


def fold(t: str, alef: bool = True) -> str:
    """plain() with look-alike letters and the usual variants of yaa (and alef) folded: a key for comparison only."""
    t = compose(t)
    if _TWIN_RE.search(t):
        t = t.translate(_TWIN_TABLE)
    t = plain(t)
    if _PERSIAN_RE.search(t):
        t = _replaced(t, _PERSIAN)
    if alef and not t.isascii():
        t = _replaced(t, _ALEF)
    return t


def words(t: str | None, alef: bool = True) -> list[str]:
    """Words of fold(t); none for a null text."""
    return WORD_RE.findall(fold(t, alef)) if t else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None], alef: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of all texts in one array, and the offsets at which each text begins."""
    found = [words(t, alef) for t in texts]
    offsets = np.zeros(len(found) + 1, dtype=np.int64)
    np.cumsum([len(f) for f in found], out=offsets[1:])
    flat = np.empty(int(offsets[-1]), dtype=object)
    at = 0
    for f in found:
        flat[at : at + len(f)] = f
        at += len(f)
    if not len(flat):
        return np.empty(0, dtype=np.uint64), offsets
    codes, unique = pd.factorize(flat)
    return pd.util.hash_array(unique, categorize=False).astype(np.uint64)[codes], offsets


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs that begin at each place of w (shorter by k - 1)."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return mix64(h)


def script_of(t: str) -> str:
    """'ar' or 'en' by the letters that occur more often; 'none' without letters of either."""
    a = sum(map(len, _AR_RUN.findall(t)))
    e = sum(map(len, _LA_RUN.findall(t)))
    return "none" if not a and not e else "ar" if a >= e else "en"


_AR_RUN = re.compile("[ء-يٮ-ۓ]+")
_LA_RUN = re.compile("[A-Za-zÀ-ɏ]+")
