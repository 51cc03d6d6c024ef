"""Queries over figure records (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import wide
from ..runtime import table


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    figures = table(spark, d, "egyptian_figures_data")
    return wide.widen(figures, wide.attribute_rows(figures, "figure_id", "infobox"), table(spark, d, "infobox_fields"), "figure_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    fields = [f for f, _, _ in wide.field_list(table(spark, d, "infobox_fields"))]
    return wide.cells_of(p2_wide(spark, d), "figure_id", fields)


_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\p{Z}]+"
_CONTROLS = r"[\x{AD}\x{61C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{FEFF}]"


def _squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '{_CONTROLS}', '', 'g'), '{_WHITE}', ' ', 'g'))"


def _label_sql(c: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace({c}, '{_CONTROLS}', '', 'g'), '" + r"[\s\x{A0}\p{Z}_:\-\x{2010}-\x{2015}]+" + "', ' ', 'g')))"


def _map_sql(key: str, table_: dict) -> str:
    return f"map_extract(MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {v}' for k, v in table_.items())}}}, {key})[1]"


def _wide_sql() -> str:
    """The cells by plain SQL over the entries: labels joined, placeholders dropped, one value a cell, cast by type."""
    holders = ", ".join("'" + p.replace("'", "''") + "'" for p in wide.PLACEHOLDERS)
    months = "|".join(sorted(wide.MONTHS, key=len, reverse=True))
    y4, d2, gap = r"(\d{4})م?", r"(\d{1,2})(?:st|nd|rd|th)?", r"\s*[،,-]?\s*"
    m, head, tail = rf"({months})\.?", r"(?:^|[^\p{L}\p{N}])", r"(?:[^\p{L}\p{N}]|$)"
    orders = [  # pattern, places of year, month and day
        (rf"{head}(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){tail}", 1, 2, 3),
        (rf"{head}(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){tail}", 3, 2, 1),
        (rf"{head}{d2}{gap}(?:of |من )?{m}{gap}(?:of |من )?(?:عام |سنة )?{y4}{tail}", 3, 2, 1),
        (rf"{head}{m}{gap}{d2}{gap}{y4}{tail}", 3, 1, 2),
        (rf"{head}{y4}{gap}{m}{gap}{d2}{tail}", 1, 2, 3),
    ]

    def part(pattern: str, n: int) -> str:
        return f"regexp_extract(s, '{pattern}', {n})"

    def month(x: str) -> str:
        return f"coalesce(try_cast({x} AS INTEGER), {_map_sql(x, wide.MONTHS)})"

    date = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN try_cast(printf('%04d-%02d-%02d', {part(p, y)}::INTEGER, {month(part(p, mo))}::INTEGER, {part(p, da)}::INTEGER) AS DATE)::VARCHAR" for p, y, mo, da in orders) + " END"
    dots = "translate(s, ',٫', '..')"

    def number(c: str, pattern: str) -> str:
        return f"try_cast(nullif(regexp_extract({c}, '{pattern}', 1), '') AS DOUBLE)"

    cm, metres, bare = number(dots, r"(\d+(?:\.\d+)?)\s*(?:cm|centimet|سم|سنتيمتر)"), number(dots, r"(\d+(?:\.\d+)?)\s*(?:m\b|metres?|meters?|متر)"), number(dots, r"^\s*(\d+(?:\.\d+)?)\s*$")
    feet, inches = number("s", r"(\d+)\s*(?:ft|feet|foot|''|قدم)"), number("s", r"(?:ft|feet|foot|''|قدم)\.?\s*(\d+(?:\.\d+)?)")
    height = f"floor(coalesce({cm}, {metres} * 100, {feet} * 30.48 + coalesce({inches}, 0) * 2.54, CASE WHEN {bare} < 3 THEN {bare} * 100 ELSE {bare} END) + 0.5)::INTEGER::VARCHAR"
    first_year = r"nullif(regexp_extract(s, '(?:^|\D)(\d{4})(?:\D|$)', 1), '')"
    plain = r"regexp_replace(s, '(\d)[,٬](\d{3})\b', '\1\2', 'g')"
    whole = f"coalesce(try_cast(nullif(regexp_extract({plain}, '" + r"([+-]?\d+)" + f"', 1), '') AS INTEGER), {_map_sql('s', wide.NUMBERS)})::VARCHAR"
    yes, no = (", ".join(f"'{x}'" for x in v) for v in (wide.TRUE, wide.FALSE))
    flag = f"CASE WHEN s IN ({yes}) THEN 'true' WHEN s IN ({no}) THEN 'false' END"
    return f"""WITH f AS (SELECT field, value_type, unnest(list_append(labels, field)) AS label FROM infobox_fields),
 l AS (SELECT DISTINCT field, value_type, {_label_sql('label')} AS label FROM f),
 e AS (SELECT DISTINCT figure_id, map_keys(infobox)[i] AS k, {_squeeze_sql('map_values(infobox)[i]')} AS v FROM (SELECT figure_id, infobox, unnest(range(1, cardinality(infobox)::BIGINT + 1)) AS i FROM egyptian_figures_data WHERE infobox IS NOT NULL)),
 c AS (SELECT figure_id, field, value_type, min(v) AS v FROM e JOIN l ON l.label = {_label_sql('k')} WHERE v IS NOT NULL AND lower(v) NOT IN ({holders}) AND regexp_matches(v, '[\\p{{L}}\\p{{N}}]') GROUP BY 1, 2, 3),
 t AS (SELECT figure_id, field, value_type, v, lower(translate(v, '{wide._OTHER_DIGITS}', '01234567890123456789')) AS s FROM c)
 SELECT figure_id, field, cell FROM (SELECT figure_id, field, CASE WHEN value_type = 'date' THEN {date} WHEN field = 'height_cm' THEN {height} WHEN field = 'active_from' THEN {first_year} WHEN value_type = 'int' THEN {whole} WHEN value_type = 'boolean' THEN {flag} ELSE v END AS cell FROM t) WHERE cell IS NOT NULL"""


#: The columns of the wide table and their SQL types, as infobox_fields has them.
_COLUMNS = {"active_from": "INTEGER", "alma_mater": "VARCHAR", "birth_date": "DATE", "birth_place": "VARCHAR", "children": "INTEGER", "death_date": "DATE", "height_cm": "INTEGER", "is_retired": "BOOLEAN", "occupation": "VARCHAR", "works_count": "INTEGER"}
_PIVOT = ", ".join(f"max(cell) FILTER (WHERE field = '{c}')::{t} AS {c}" for c, t in _COLUMNS.items())
SQL = {"p2_found": _wide_sql(), "p2_wide": f"SELECT k.figure_id, {_PIVOT} FROM (SELECT DISTINCT figure_id FROM egyptian_figures_data WHERE figure_id IS NOT NULL) k LEFT JOIN ({_wide_sql()}) c ON c.figure_id = k.figure_id GROUP BY 1"}
QUERIES = {"p2_found": p2_found, "p2_wide": p2_wide}
