"""Text functions on columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Whitespace as Unicode has it, with the four separators of ASCII.
WHITE = "(?U)[\\s\\x1c-\\x1f]+"


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends (Spark's own trim removes spaces only)."""
    return F.regexp_replace(c, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def words(c: Column) -> Column:
    """Parts between runs of white space; none for a blank text, null for a null one."""
    return F.filter(F.split(c, WHITE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def percent_decode(c: Column) -> Column:
    """Percent escapes decoded as UTF-8; a plus and malformed escapes stay, invalid bytes become U+FFFD."""
    return F.url_decode(F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def normalize_arabic(c: Column) -> Column:
    """Arabic text for a tokenizer: vowel marks and stretching removed, final yaa unified, spaces and blank lines squeezed, dash and ellipsis plain, ends stripped."""
    s = F.regexp_replace(c, "[\\u064B-\\u0652\\u0640]", "")
    s = F.replace(s, F.lit("ى"), F.lit("ي"))
    s = F.regexp_replace(s, " +", " ")
    s = F.regexp_replace(s, "(?U)\\n[\\s\\x1c-\\x1f]*\\n+", "\n\n")
    s = F.replace(s, F.lit("‌"), F.lit(""))
    s = F.replace(s, F.lit("—"), F.lit("-"))
    s = F.replace(s, F.lit("…"), F.lit("..."))
    return trim(s)


def reduction_percent(before: Column, after: Column) -> Column:
    """By how much of its length a text was shortened; null for an empty one."""
    return F.try_divide((F.length(before) - F.length(after)) * F.lit(100.0), F.length(before))


def json_string(c: Column) -> Column:
    """The JSON literal of a string."""
    array = F.to_json(F.array(c))
    return F.substring(array, F.lit(2), F.length(array) - 2)
