"""Attribute-value rows into one typed row per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import broadcast_if_small

#: Month names and their usual short forms, in order.
MONTHS = {
    **{m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())},
    **{m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())},
    "sept": 9,
    **{m: i + 1 for i, m in enumerate("يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر".split())},
    **{m: i for m, i in (("ابريل", 4), ("إبريل", 4), ("يونيه", 6), ("يوليه", 7), ("اغسطس", 8), ("اكتوبر", 10))},
}
#: Numbers in words.
NUMBERS = {
    **{w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())},
    **{w: i for i, w in enumerate("صفر واحد اثنان ثلاثة أربعة خمسة ستة سبعة ثمانية تسعة عشرة".split())},
    **{w: i for w, i in (("اثنين", 2), ("ثلاث", 3), ("أربع", 4), ("اربعة", 4), ("خمس", 5), ("ست", 6), ("سبع", 7), ("ثمان", 8), ("ثماني", 8), ("تسع", 9), ("عشر", 10), ("واحدة", 1), ("اثنتان", 2), ("none", 0), ("لا أحد", 0))},
}
#: Texts that stand for a value that is not known.
PLACEHOLDERS = ["", "n/a", "na", "n.a.", "none given", "not given", "not available", "not known", "unknown", "unspecified", "tbd", "tba", "tbc", "null", "nil", "none", "nan", "missing", "غير معروف", "غير معروفة", "غير متوفر", "غير محدد", "غير متاح", "مجهول", "لا يوجد", "لا شيء"]
TRUE = ["true", "yes", "y", "1", "t", "نعم", "صحيح", "أجل", "✓", "✔"]
FALSE = ["false", "no", "n", "0", "f", "لا", "كلا", "خطأ", "✗", "✘"]

_INVISIBLE = "[\\u00AD\\u061C\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2069\\uFEFF]"
_SPACE = "[\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
_OTHER_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
#: The number of infobox_fields rows that may be gathered into one literal grid.
FIELD_BOUND = 10_000


def squeeze(c: Column) -> Column:
    """Trimmed, each run of white space (of any kind) as one space, invisible controls removed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, _INVISIBLE, ""), _SPACE, " "))


def label_key(c: Column) -> Column:
    """The form in which labels are compared: lower case; underscores, hyphens and colons as spaces."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, _INVISIBLE, ""), "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000_:\\-\\u2010-\\u2015]+", " ")))


def _ascii(c: Column) -> Column:
    return F.translate(c, _OTHER_DIGITS, "01234567890123456789")


def known(c: Column) -> Column:
    """squeeze(c), null for blanks, placeholders and values without a letter or digit."""
    s = squeeze(c)
    return F.when(~F.lower(F.rtrim(F.regexp_replace(s, "^[(\\[]|[)\\].]+$", ""))).isin(PLACEHOLDERS) & s.rlike("[\\p{L}\\p{N}✓✔✗✘]"), s)


def _lookup(c: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def to_date(c: Column) -> Column:
    """A date with day, month and year, in any of the usual orders; null where one of them is not known."""
    s = F.lower(_ascii(c))
    months = "|".join(sorted(MONTHS, key=len, reverse=True))
    gap, day, month, year = "\\s*[،,-]?\\s*", "(\\d{1,2})(?:st|nd|rd|th)?", f"({months})\\.?", "(\\d{4})م?"
    two, four, sign = "(\\d{1,2})", "(\\d{4})", "[-/.]"
    # one expression for all orders; groups of the orders that do not match are empty
    orders = [
        f"{four}{sign}{two}{sign}{two}",
        f"{two}{sign}{two}{sign}{four}",
        f"{day}{gap}(?:of |من )?{month}{gap}(?:of |من )?(?:عام |سنة )?{year}",
        f"{month}{gap}{day}{gap}{year}",
        f"{year}{gap}{month}{gap}{day}",
    ]
    pattern = f"(?s)^(?:.*?[^\\p{{L}}\\p{{N}}])??(?:{'|'.join(orders)})(?![\\p{{L}}\\p{{N}}]).*$"
    found = F.split(F.when(s.rlike(pattern), F.regexp_replace(s, pattern, "$1$6$9$12$13-$2$5$8$10$14-$3$4$7$11$15")), "-")
    name = F.get(found, F.lit(1))
    number = F.coalesce(_lookup(name, MONTHS), name.try_cast("int"))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", F.get(found, F.lit(0)).try_cast("int"), number, F.get(found, F.lit(2)).try_cast("int")), "yyyy-MM-dd")


def to_int(c: Column, field: str = "") -> Column:
    """An integer from free text: digits with or without separators, or a number in words.

    For a field of heights in centimetres (its name ends in _cm) metres, feet and inches are converted and rounded; for
    the first year of a span (its name ends in _from) the first number of four digits counts.
    """
    s = F.lower(_ascii(c))

    def number(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(s, pattern, group), F.lit("")).try_cast("double")

    if field.endswith("_cm"):
        decimal = F.nullif(F.regexp_extract(F.translate(s, ",٫", ".."), "(\\d+(?:\\.\\d+)?)\\s*(?:m\\b|metres?|meters?|متر|م(?![\\p{L}]))", 1), F.lit("")).try_cast("double")
        cm = F.nullif(F.regexp_extract(F.translate(s, ",٫", ".."), "(\\d+(?:\\.\\d+)?)\\s*(?:cm|centimet|سم|سنتيمتر)", 1), F.lit("")).try_cast("double")
        feet = number("(\\d+)\\s*(?:ft|feet|foot|'|′|’|قدم)")
        inches = number("(?:ft|feet|foot|'|′|’|قدم)\\.?\\s*(?:و\\s*)?(\\d+(?:\\.\\d+)?)")
        bare = F.nullif(F.regexp_extract(F.translate(s, ",٫", ".."), "^\\s*(\\d+(?:\\.\\d+)?)\\s*$", 1), F.lit("")).try_cast("double")
        value = F.coalesce(cm, decimal * 100, feet * 30.48 + F.coalesce(inches, F.lit(0.0)) * 2.54, F.when(bare < 3, bare * 100).otherwise(bare))
        return F.floor(value + 0.5).cast("int")
    if field.endswith("_from"):
        return F.nullif(F.regexp_extract(s, "(?<!\\d)(\\d{4})(?!\\d)", 1), F.lit("")).try_cast("int")
    plain = F.regexp_replace(s, "(?<=\\d)[,٬،' ](?=\\d{3}(?!\\d))", "")
    digits = F.nullif(F.regexp_extract(plain, "(?<![\\d.])([+-]?\\d+)(?![\\d])", 1), F.lit("")).try_cast("int")
    word = F.regexp_extract(s, "^([\\p{L}]+)", 1)
    return F.coalesce(digits, _lookup(s, NUMBERS), _lookup(word, NUMBERS)).cast("int")


def to_boolean(c: Column) -> Column:
    s = F.lower(_ascii(F.regexp_replace(c, "[.!]$", "")))
    return F.when(s.isin(TRUE), F.lit(True)).when(s.isin(FALSE), F.lit(False))


def typed(value: Column, field: str, kind: str) -> Column:
    """The value (as known() gives it) as its field's type; null where it cannot be read as one."""
    v = value
    if kind == "date":
        return to_date(v)
    if kind in ("int", "bigint", "long"):
        return to_int(v, field)
    if kind in ("double", "float"):
        return F.translate(_ascii(v), ",٫", "..").try_cast("double")
    if kind in ("boolean", "bool"):
        return to_boolean(v)
    return v


def field_list(fields: DataFrame) -> list[tuple[str, str, list[str]]]:
    """The wanted columns; a schema, so it is gathered, but never more than FIELD_BOUND rows of it."""
    rows = fields.select("field", "value_type", "labels").where("field is not null").limit(FIELD_BOUND + 1).collect()
    if len(rows) > FIELD_BOUND:
        raise ValueError(f"more than {FIELD_BOUND} fields")
    return sorted({r[0]: (r[0], (r[1] or "string").lower(), list(r[2] or [])) for r in rows}.values())


def attribute_rows(df: DataFrame, key: str, attributes: str) -> DataFrame:
    """(key, name, value) rows of a map column; null maps give none."""
    return df.select(key, F.explode(attributes).alias("name", "value"))


def widen(entities: DataFrame, rows: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """One row per distinct, non-null `key` of entities, with a typed column for each field.

    entities: key; rows: key, name, value; fields: field, value_type, labels. Only these columns are read, so others may
    have any names. The grid of entities and fields is completed, values are left-joined to it, the values of a cell are
    collected into one array sorted by the position of the field, and each position is projected through the cast of
    its type. Of several values of a cell the first in order that is known counts; names that are no label of any field
    are ignored. An entity without any value gives a row of nulls.
    """
    wanted = field_list(fields)
    # positions of the labels: the grid's second side, as many rows as the schema has labels
    labels = {}
    for at, (name, _, known_labels) in enumerate(wanted):
        for label in [name, *known_labels]:
            labels.setdefault(label, at)
    spark = entities.sparkSession
    side = spark.createDataFrame(list(labels.items()) or [("", -1)], "label string, position int").select(label_key(F.col("label")).alias("label"), "position").groupBy("label").agg(F.min("position").alias("position"))
    named = rows.select(F.col(key).alias("__key"), label_key(F.col("name")).alias("label"), known(F.col("value")).alias("value"))
    cells = named.join(broadcast_if_small(side, FIELD_BOUND * 20), "label").where("value is not null").select("__key", "position", "value")
    # a hot key costs one row per cell: repeated values meet before the shuffle
    cells = cells.groupBy("__key", "position").agg(F.min("value").alias("value"))
    grid = entities.select(F.col(key).alias("__key")).where("__key is not null").distinct().select("__key", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(wanted) - 1)))).alias("position"))
    whole = grid.join(cells, ["__key", "position"], "left").groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("cells"))
    columns = [typed(F.get("cells", F.lit(at))["value"], name, kind).alias(name) for at, (name, kind, _) in enumerate(wanted)]
    return whole.select(F.col("__key").alias(key), *columns)


def cells_of(wide: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, cell): the values of a wide table that are not null, as text."""
    if not fields:
        return wide.select(key, F.lit("").alias("field"), F.lit("").alias("cell")).limit(0)
    array = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("cell")) for f in fields])
    return wide.select(key, F.explode(array).alias("c")).select(key, "c.field", "c.cell").where("cell is not null")
