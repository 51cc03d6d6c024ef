"""Queries over crawled pages: addresses, duplicates, links, category walks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import urls
from ..functions.text import normalize_arabic, trim, word_count
from ..operators import dedup, graph, links, wikitext
from ..runtime import table

#: Addresses and links that show the edges of the rules; the SQL has the same rows.
LITERAL_URLS = ["https://h/a b?x#f", "HTTPS://ar.h/w/index.php?title=X&pagefrom=Y", "https://h/a;p", "https://h/", "https://h/wiki/a+b%20c%zz", "http://u@h:80/x/y///", "https://h/a;b/c"]
LITERAL_HREFS = ["/wiki/تصنيف:س", "/wiki/س", "/wiki/File:x.png", "/w/index.php?pagefrom=a", "/wiki/Category:A", "/wiki/Special:B", "https://h/wiki/x", "/wiki/%D8%AA%D8%B5%D9%86%D9%8A%D9%81:s", "/wiki/a?pageuntil=b", "#top"]


def _values(spark: SparkSession, items: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in items], f"{name} string")


def _sql_values(items: list[str]) -> str:
    return ", ".join("('" + x.replace("'", "''") + "')" for x in items)


def q01_url_normalize(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "article_records").select("url").unionByName(_values(spark, LITERAL_URLS, "url"))
    return both.select("url", urls.normalize(F.col("url")).alias("normal"))


_NORMAL = """lower(regexp_extract({0}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)', 1)) || '://' || regexp_extract({0}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)', 2)
 || regexp_replace(url_decode(regexp_replace(regexp_extract({0}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)', 3), '((?:^|/)[^/;]*);[^/]*$', '\\1')), '/+$', '')"""
SQL_Q01 = f"SELECT url, {_NORMAL.format('url')} AS normal FROM (SELECT url FROM article_records UNION ALL SELECT * FROM (VALUES {_sql_values(LITERAL_URLS)}) t(url))"


def q02_url_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "article_records").select("ord", "url", "title")
    return dedup.first_by(records, urls.normalize(F.col("url")), "ord", "normal").select("normal", "ord", "url", "title", "copies")


SQL_Q02 = f"""SELECT normal, ord, url, title, copies FROM (SELECT {_NORMAL.format('url')} AS normal, ord, url, title, count(*) OVER (PARTITION BY {_NORMAL.format('url')}) AS copies,
 row_number() OVER (PARTITION BY {_NORMAL.format('url')} ORDER BY ord) AS n FROM article_records WHERE url IS NOT NULL) WHERE n = 1"""


def q02_duplicate_counts(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_counts(table(spark, d, "article_records"), urls.normalize(F.col("url")))


SQL_Q02_COUNTS = f"SELECT count(*) AS loaded, count(DISTINCT normal) AS kept, count(*) - count(DISTINCT normal) AS duplicates FROM (SELECT {_NORMAL.format('url')} AS normal FROM article_records)"


def _category_pages(spark: SparkSession, d: str) -> DataFrame:
    """A category page for each record: its ancestors as sub-categories, itself and three other links as pages."""
    r = table(spark, d, "article_records").where("parent_categories is not null")

    def link(href: F.Column, label: F.Column) -> F.Column:
        return F.concat(F.lit('<li><a href="'), href, F.lit('" title="t"> '), label, F.lit("\n</a>"))

    sub = F.array_join(F.transform("parent_categories", lambda c: link(F.concat(F.lit("/wiki/تصنيف:"), c), c)), "")
    path = F.concat(F.lit("/wiki/"), F.col("ord").cast("string"))
    own = F.concat(link(path, F.lit("<b>x</b> &amp; y")), link(F.lit("/wiki/خاص:z"), F.lit("s")), link(F.lit("/w/i?pagefrom=a"), F.lit("next")))
    html = F.concat(F.lit('<html><h1 class="a firstHeading">تصنيف: c '), F.col("ord").cast("string"), F.lit(' </h1><p>open<a href="/wiki/out">o</a><div id="mw-subcategories"><ul>'), sub, F.lit('</ul></div><div id="mw-pages"><p>'), own, F.lit("</div></html>"))
    return r.select("ord", F.concat(F.lit("https://h/wiki/تصنيف:c"), F.col("ord").cast("string")).alias("page"), html.alias("html"))


def q03_html_links(spark: SparkSession, d: str) -> DataFrame:
    return links.page_links(_category_pages(spark, d), "ord").select("ord", trim(F.col("heading")).alias("heading"), "section", "pos", "href", trim(F.col("label")).alias("label"))


_PAGE_LINKS = """SELECT ord, 0 AS pos, '' AS section, '/wiki/out' AS href, 'o' AS label FROM r
 UNION ALL SELECT ord, i AS pos, 'subcategories', '/wiki/تصنيف:' || parent_categories[i], trim(parent_categories[i]) FROM (SELECT ord, parent_categories, unnest(range(1, len(parent_categories) + 1)) AS i FROM r)
 UNION ALL SELECT ord, len(parent_categories) + 1, 'pages', '/wiki/' || ord, 'x & y' FROM r
 UNION ALL SELECT ord, len(parent_categories) + 2, 'pages', '/wiki/خاص:z', 's' FROM r
 UNION ALL SELECT ord, len(parent_categories) + 3, 'pages', '/w/i?pagefrom=a', 'next' FROM r"""
SQL_Q03 = f"WITH r AS (SELECT ord, parent_categories FROM article_records WHERE parent_categories IS NOT NULL), l AS ({_PAGE_LINKS}) SELECT ord, 'تصنيف: c ' || ord AS heading, section, pos::INTEGER AS pos, href, label FROM l"


def q04_category_links(spark: SparkSession, d: str) -> DataFrame:
    return links.category_links(_category_pages(spark, d), "ord", "page")


SQL_Q04 = f"""WITH r AS (SELECT ord, parent_categories FROM article_records WHERE parent_categories IS NOT NULL), l AS ({_PAGE_LINKS})
 SELECT ord, 'c ' || ord AS category, kind, pos::INTEGER AS pos, 'https://h' || href AS url, label FROM (SELECT *, CASE WHEN section = 'subcategories' AND starts_with(href, '/wiki/') AND contains(href, 'تصنيف:') THEN 'subcategory'
 WHEN section = 'pages' AND starts_with(href, '/wiki/') AND NOT contains(href, 'خاص:') THEN 'article' WHEN section = 'pages' AND contains(href, 'pagefrom=') THEN 'paging' END AS kind FROM l) WHERE kind IS NOT NULL"""


def q04_link_filters(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "article_records").select(F.regexp_replace("url", "^[a-zA-Z]+://[^/]*", "").alias("href")).where("href is not null")
    h = F.col("href")
    return paths.unionByName(_values(spark, LITERAL_HREFS, "href")).select(
        "href", urls.is_subcategory_link(h).alias("is_subcategory"), urls.is_article_link(h).alias("is_article"), urls.is_paging_link(h).alias("is_paging"), urls.is_figure_link(h).alias("is_figure"), urls.is_category_page(h).alias("is_category_page")
    )


def _any(c: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{m}')" for m in marks) + ")"


_SUB = ["تصنيف:", "%D8%AA%D8%B5%D9%86%D9%8A%D9%81:"]
_OTHERS = [*_SUB, "Special:", "خاص:", "User:", "مستخدم:", "File:", "ملف:", "صورة:", "Template:", "قالب:", "Talk:", "نقاش:", "Wikipedia:", "ويكيبيديا:", "Help:", "مساعدة:", "Portal:", "بوابة:"]
SQL_Q04_FILTERS = f"""SELECT href, starts_with(href, '/wiki/') AND {_any('href', _SUB)} AS is_subcategory, starts_with(href, '/wiki/') AND NOT {_any('href', _OTHERS)} AS is_article,
 {_any('href', ['pagefrom=', 'pageuntil=', 'pageupto='])} AS is_paging, starts_with(href, '/wiki/') AND NOT contains(href, '/wiki/Category') AS is_figure, {_any('href', [*_SUB, 'Category:'])} AS is_category_page
 FROM (SELECT regexp_replace(url, '^[a-zA-Z]+://[^/]*', '') AS href FROM article_records WHERE url IS NOT NULL UNION ALL SELECT * FROM (VALUES {_sql_values(LITERAL_HREFS)}) t(href))"""


def q04_group_links(spark: SparkSession, d: str) -> DataFrame:
    """Categories and figures in the groups of English category pages, one page for each record."""
    r = table(spark, d, "article_records").where("parent_categories is not null")
    parts = F.array_join(F.transform("parent_categories", lambda c: F.concat(F.lit('<li><a href="/wiki/Category:'), c, F.lit('"> '), c, F.lit("</a>"))), "")
    own = F.concat(F.lit('<a href="../wiki/./f'), F.col("ord").cast("string"), F.lit('">x</a><a href="/wiki/f'), F.col("ord").cast("string"), F.lit('?pagefrom=a"> F </a>'))
    html = F.concat(F.lit('<a href="/wiki/out">o</a><div class="x mw-category-group"><ul>'), parts, own, F.lit("</ul></div>"))
    pages = r.select("ord", F.lit("https://h/wiki/Category:c").alias("page"), F.concat(F.lit("c"), F.col("ord").cast("string")).alias("of"), html.alias("html"))
    return links.group_links(pages, "ord", "page", "of")


SQL_Q04_GROUPS = """WITH r AS (SELECT ord, parent_categories FROM article_records WHERE parent_categories IS NOT NULL)
 SELECT ord, 'category' AS kind, i::INTEGER AS pos, trim(parent_categories[i]) AS name, 'https://h/wiki/Category:' || parent_categories[i] AS url, NULL AS category FROM (SELECT ord, parent_categories, unnest(range(1, len(parent_categories) + 1)) AS i FROM r)
 UNION ALL SELECT ord, 'figure', (len(parent_categories) + 2)::INTEGER, 'F', 'https://h/wiki/f' || ord || '?pagefrom=a', 'c' || ord FROM r"""


def q05_whole_walk(spark: SparkSession, d: str) -> DataFrame:
    """All categories that can be reached from one, and how far they are."""
    r = table(spark, d, "article_records")
    edges = r.select(F.explode("parent_categories").alias("parent"), trim(F.col("category")).alias("child"), "ord").where("parent is not null and child <> ''").groupBy("parent", "child").agg(F.min("ord").alias("ord"))
    root = edges.where("parent < child").groupBy().agg(F.min("parent").alias("node"))
    return graph.walk(cut_edges(edges), root).select("node", "depth")


SQL_Q05_WHOLE = """WITH RECURSIVE e AS (SELECT DISTINCT parent, trim(category) AS child FROM (SELECT unnest(parent_categories) AS parent, category FROM article_records) WHERE parent IS NOT NULL AND trim(category) <> ''),
 d AS (SELECT min(parent) AS node, 0 AS depth FROM e WHERE parent < child UNION SELECT e.child, d.depth + 1 FROM d JOIN e ON e.parent = d.node WHERE d.depth < 60)
 SELECT node, min(depth)::INTEGER AS depth FROM d GROUP BY 1"""


def q09_fetched_wikitext(spark: SparkSession, d: str) -> DataFrame:
    """Wikitext of articles out of a snapshot of API responses; missing pages and empty contents drop out."""
    from ..sources import pages as snapshots

    t = table(spark, d, "train_phase_1").where("url is not null").groupBy("url").agg(F.min("rec_id").alias("rec_id"), F.min("text").alias("text"))
    page = F.to_json(F.struct(F.struct(F.create_map(F.when(F.col("rec_id") % 5 == 0, "-1").otherwise("7"), F.struct(F.array(F.struct(F.struct(F.struct(F.col("text").alias("*")).alias("main")).alias("slots"))).alias("revisions"))).alias("pages")).alias("query")))
    found = snapshots.fetched(table(spark, d, "article_records").select("ord", "url"), t.select("url", page.alias("response")), "url", "response")
    return found.select("ord", snapshots.wikitext_of(F.col("response")).alias("wikitext")).where("wikitext is not null and wikitext <> ''")


SQL_Q09_FETCHED = """SELECT ord, text AS wikitext FROM article_records JOIN (SELECT url, min(rec_id) AS rec_id, min(text) AS text FROM train_phase_1 WHERE url IS NOT NULL GROUP BY 1) USING (url) WHERE rec_id % 5 <> 0 AND text <> ''"""


def q05_category_walk(spark: SparkSession, d: str) -> DataFrame:
    """Categories within three steps of one: an edge leads from each parent of a record to its category."""
    r = table(spark, d, "article_records")
    edges = r.select(F.explode("parent_categories").alias("parent"), trim(F.col("category")).alias("child"), "ord").where("parent is not null and child <> ''").groupBy("parent", "child").agg(F.min("ord").alias("ord"))
    root = edges.where("parent < child").groupBy().agg(F.min("parent").alias("node"))
    return graph.walk(cut_edges(edges), root, 3).select("node", "depth", F.array_join("parents", " > ").alias("path"))


def cut_edges(edges: DataFrame) -> DataFrame:
    from ..runtime import cut

    return cut(edges)


SQL_Q05 = """WITH RECURSIVE e AS (SELECT parent, child, min(ord) AS ord FROM (SELECT unnest(parent_categories) AS parent, trim(category) AS child, ord FROM article_records) WHERE parent IS NOT NULL AND child <> '' GROUP BY 1, 2),
 d AS (SELECT min(parent) AS node, 0 AS depth FROM e WHERE parent < child UNION SELECT e.child, d.depth + 1 FROM d JOIN e ON e.parent = d.node WHERE d.depth < 3),
 m AS (SELECT node, min(depth) AS depth FROM d GROUP BY 1),
 p0 AS (SELECT node, CAST([] AS VARCHAR[]) AS parents FROM m WHERE depth = 0),
 p1 AS (SELECT e.child AS node, min(list_append(p.parents, p.node)) AS parents FROM p0 p JOIN e ON e.parent = p.node JOIN m ON m.node = e.child AND m.depth = 1 GROUP BY 1),
 p2 AS (SELECT e.child AS node, min(list_append(p.parents, p.node)) AS parents FROM p1 p JOIN e ON e.parent = p.node JOIN m ON m.node = e.child AND m.depth = 2 GROUP BY 1),
 p3 AS (SELECT e.child AS node, min(list_append(p.parents, p.node)) AS parents FROM p2 p JOIN e ON e.parent = p.node JOIN m ON m.node = e.child AND m.depth = 3 GROUP BY 1)
 SELECT node, depth, array_to_string(parents, ' > ') AS path FROM (SELECT *, 0 AS depth FROM p0 UNION ALL SELECT *, 1 FROM p1 UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 3 FROM p3)"""


def q06_title_from_url(spark: SparkSession, d: str) -> DataFrame:
    extra = _values(spark, ["https://h/wiki/a/wiki/b", "https://h/x", "https://h/wiki/"], "url")
    return table(spark, d, "article_records").select("url").where("url is not null").unionByName(extra).select("url", urls.title_from_path(F.col("url")).alias("from_path"), urls.title_from_link(F.col("url")).alias("from_link"))


SQL_Q06 = """SELECT url, nullif(regexp_extract(url, '/wiki/(.+)$', 1), '') AS from_path, string_split(url, '/wiki/')[-1] AS from_link
 FROM (SELECT url FROM article_records WHERE url IS NOT NULL UNION ALL SELECT * FROM (VALUES ('https://h/wiki/a/wiki/b'), ('https://h/x'), ('https://h/wiki/')) t(url))"""


def q07_display_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article_records").select("ord", urls.display_title(urls.title_from_path(F.col("url"))).alias("display_title"))


SQL_Q07 = "SELECT ord, replace(url_decode(nullif(regexp_extract(url, '/wiki/(.+)$', 1), '')), '_', ' ') AS display_title FROM article_records"


def q08_safe_filename(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "article_records").select(F.concat_ws(": ", "title", "url").alias("title")).unionByName(_values(spark, ['a/b:c?"d"\\e|f', "<" * 120], "title"))
    return titles.select("title", urls.file_name(F.col("title")).alias("filename"))


SQL_Q08 = f"""SELECT title, substring(regexp_replace(title, '[<>:"/\\\\|?*]', '_', 'g'), 1, 100) || '.md' AS filename
 FROM (SELECT concat_ws(': ', title, url) AS title FROM article_records UNION ALL SELECT * FROM (VALUES {_sql_values(['a/b:c?"d"' + chr(92) + 'e|f', '<' * 120])}) t(title))"""

#: What the lines of a text are headed with to make wikitext of it, by line number.
_HEADS = ["", "== ", "* ", "# ", "'''b''' ''i'' [[A|l]] [[B]] ", "{{x ", "=== [[T|", "| cell ", "** <ref name=\"r\"/> k <ref>y</ref> ", "[[File:a.jpg|thumb|c]] "]


def _wikitext(spark: SparkSession, d: str) -> DataFrame:
    heads = F.array(*[F.lit(h) for h in _HEADS])
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.get(heads, i % len(_HEADS)), x))
    return table(spark, d, "train_phase_1").where("text is not null").select("rec_id", "title", F.array_join(lines, "\n").alias("wikitext")).distinct()


def q09_wikitext_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _wikitext(spark, d).select("rec_id", wikitext.to_markdown(F.col("wikitext")).alias("markdown"))


_HEADS_SQL = "[" + ", ".join("'" + h.replace("'", "''") + "'" for h in _HEADS) + "]"
_TRIM = "regexp_replace({0}, '^[\\s\\x1c-\\x1f\\x{{85}}\\x{{A0}}\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x0b\\x{{85}}\\x{{A0}}\\p{{Z}}]+$', '', 'g')"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\[\\[([^|\\]]+\\|)?([^\\]]+)\\]\\]', '\\2', 'g'), '''''''([^'']+)''''''', '**\\1**', 'g'), '''''([^'']+)''''', '*\\1*', 'g'), '<ref[^>]*>.*?</ref>', '', 'g'), '<ref[^>]*/>', '', 'g')"
SQL_Q09 = f"""WITH w AS (SELECT DISTINCT rec_id, text FROM train_phase_1 WHERE text IS NOT NULL),
 l AS (SELECT rec_id, i, {_TRIM.format('x')} AS x FROM (SELECT rec_id, i, ({_HEADS_SQL})[(i - 1) % {len(_HEADS)} + 1] || parts[i] AS x FROM (SELECT rec_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM w))),
 b AS (SELECT rec_id, i, CASE WHEN x = '' OR starts_with(x, '{{{{') OR starts_with(x, '[[Category:') OR starts_with(x, '[[تصنيف:') THEN NULL WHEN starts_with(x, '==') THEN 'h' WHEN starts_with(x, '*') OR starts_with(x, '#') THEN 'l'
  WHEN regexp_matches(x, '^[{{|!]') OR {_CLEAN.format('x')} = '' OR starts_with({_CLEAN.format('x')}, 'thumb|') THEN NULL ELSE 'p' END AS kind, x FROM l),
 t AS (SELECT rec_id, i, kind, lag(kind) OVER (PARTITION BY rec_id ORDER BY i) AS before, CASE kind
  WHEN 'h' THEN chr(10) || repeat('#', (len(regexp_extract(x, '^(=*)', 1)) // 2 + 1)::INTEGER) || ' ' || regexp_replace(regexp_replace(x, '^[= ]+|[= ]+$', '', 'g'), '\\[\\[([^|\\]]+\\|)?([^\\]]+)\\]\\]', '\\2', 'g') || chr(10) || chr(10)
  WHEN 'l' THEN (CASE WHEN starts_with(x, '*') THEN '- ' ELSE '1. ' END) || {_CLEAN.format(_TRIM.format('substring(x, 2)'))} || chr(10)
  ELSE {_CLEAN.format('x')} || chr(10) || chr(10) END AS text FROM b WHERE kind IS NOT NULL)
 SELECT w.rec_id, coalesce(m.markdown, '') AS markdown FROM w LEFT JOIN (SELECT rec_id, string_agg((CASE WHEN kind = 'p' AND before = 'l' THEN chr(10) ELSE '' END) || text, '' ORDER BY i) AS markdown FROM t GROUP BY 1) m USING (rec_id)"""


def q10_article_document(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "article_records").where("title is not null and url is not null")
    doc = wikitext.document(F.col("title"), F.col("url"), F.col("category"), F.col("parent_categories"), F.concat(F.lit("C "), F.col("ord").cast("string")))
    named = r.select("ord", urls.file_name(F.col("title")).alias("filename"), doc.alias("markdown"))
    return dedup.first_by(named, F.col("filename"), "ord", "filename").select("filename", "ord", "markdown")


SQL_Q10 = """SELECT filename, ord, markdown FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY ord) AS n FROM (SELECT ord, substring(regexp_replace(title, '[<>:"/\\\\|?*]', '_', 'g'), 1, 100) || '.md' AS filename,
 '# ' || title || chr(10) || chr(10) || '## [METADATA]' || chr(10) || chr(10) || '- **URL:** ' || url || chr(10) || '- **Category:** ' || coalesce(category, 'N/A') || chr(10)
 || CASE WHEN len(parent_categories) > 0 THEN '- **Parent Categories:** ' || array_to_string(parent_categories, ' > ') || chr(10) ELSE '' END || chr(10) || '---' || chr(10) || chr(10) || '## [CONTENT]' || chr(10) || chr(10) || 'C ' || ord AS markdown
 FROM article_records WHERE title IS NOT NULL AND url IS NOT NULL)) WHERE n = 1"""


def q11_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_phase_1").where("text is not null").select("rec_id", "text").distinct().select("rec_id", wikitext.summary(F.col("text")).alias("summary"))


SQL_Q11 = f"""WITH w AS (SELECT DISTINCT rec_id, text FROM train_phase_1 WHERE text IS NOT NULL), l AS (SELECT rec_id, i, {_TRIM.format('parts[i]')} AS x FROM (SELECT rec_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM w)),
 s AS (SELECT rec_id, min(i) AS stop FROM l WHERE starts_with(x, '==') GROUP BY 1),
 k AS (SELECT l.rec_id, i, x, row_number() OVER (PARTITION BY l.rec_id ORDER BY i) AS n FROM l LEFT JOIN s USING (rec_id) WHERE x <> '' AND NOT starts_with(x, '=') AND (stop IS NULL OR i < stop))
 SELECT w.rec_id, coalesce(summary, '') AS summary FROM w LEFT JOIN (SELECT rec_id, string_agg(x, ' ' ORDER BY n) AS summary FROM k WHERE n <= 3 GROUP BY 1) USING (rec_id)"""


def q12_infobox(spark: SparkSession, d: str) -> DataFrame:
    """Infoboxes written as templates and read back, one row per parameter."""
    f = table(spark, d, "egyptian_figures_data").where("infobox is not null").select("figure_id", "infobox").groupBy("figure_id").agg(F.first("infobox").alias("infobox"))
    body = F.array_join(F.transform(F.map_entries("infobox"), lambda e: F.concat(F.lit("\n| "), e["key"], F.lit(" = "), F.coalesce(e["value"], F.lit("")))), "")
    text = F.concat(F.lit("Before {{other|x=1}} {{ Infobox person"), body, F.lit("\n}} after [[A|b]]"))
    parsed = wikitext.parse_pages(f.select("figure_id", text.alias("wikitext")), ["figure_id"])
    return parsed.select("figure_id", F.explode("infobox").alias("name", "value"))


SQL_Q12 = f"""SELECT figure_id, name, arg_max(value, i) AS value FROM (SELECT figure_id, i, {_TRIM.format('k')} AS name, {_TRIM.format("coalesce(v, '')")} AS value FROM
 (SELECT figure_id, i, map_keys(infobox)[i] AS k, map_values(infobox)[i] AS v FROM (SELECT figure_id, any_value(infobox) AS infobox, unnest(range(1, cardinality(any_value(infobox))::BIGINT + 1)) AS i FROM egyptian_figures_data WHERE infobox IS NOT NULL GROUP BY figure_id))) GROUP BY 1, 2"""


def q00_corpus_slice(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: normalised texts of an accepted length by source, with what normalising saved."""
    docs = table(spark, d, "documents").where("text is not null")
    n = docs.select(F.lower(trim(F.coalesce("source", F.lit("(none)")))).alias("source"), F.length("text").alias("before"), normalize_arabic(F.col("text")).alias("normal"))
    kept = n.where(F.length("normal") >= 50)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("normal").cast("bigint")).alias("characters"), F.sum((F.col("before") - F.length("normal")).cast("bigint")).alias("saved"), F.sum(word_count(F.col("normal")).cast("bigint")).alias("words"))


_WHITE = r"[\s\x1c-\x1f\x0b\x{85}\x{A0}\p{Z}]"


def normal_text_sql(column: str) -> str:
    """The SQL of normalize_arabic."""
    s = f"regexp_replace({column}, '" + r"[\x{064B}-\x{0652}\x{0640}]" + "', '', 'g')"
    s = f"regexp_replace(replace({s}, 'ى', 'ي'), ' +', ' ', 'g')"
    s = f"regexp_replace({s}, '" + r"\n" + _WHITE + r"*\n+" + "', chr(10) || chr(10), 'g')"
    return _TRIM.format(f"replace(replace(replace({s}, chr(8204), ''), '—', '-'), '…', '...')")


_SOURCE = _TRIM.format("coalesce(source, '(none)')")
SQL_Q00 = f"""SELECT source, count(*) AS documents, sum(len(n))::BIGINT AS characters, sum(b - len(n))::BIGINT AS saved, sum(len(list_filter(regexp_split_to_array(n, '{_WHITE}+'), lambda w: w <> '')))::BIGINT AS words
 FROM (SELECT lower({_SOURCE}) AS source, len(text) AS b, {normal_text_sql('text')} AS n FROM documents WHERE text IS NOT NULL) WHERE len(n) >= 50 GROUP BY 1"""


QUERIES = {f.__name__: f for f in (q00_corpus_slice, q01_url_normalize, q02_url_dedupe_first, q02_duplicate_counts, q03_html_links, q04_category_links, q04_link_filters, q04_group_links, q05_category_walk, q05_whole_walk, q09_fetched_wikitext, q06_title_from_url, q07_display_title, q08_safe_filename, q09_wikitext_markdown, q10_article_document, q11_summary, q12_infobox)}
SQL = {"q00_corpus_slice": SQL_Q00, "q01_url_normalize": SQL_Q01, "q02_url_dedupe_first": SQL_Q02, "q02_duplicate_counts": SQL_Q02_COUNTS, "q03_html_links": SQL_Q03, "q04_category_links": SQL_Q04, "q04_link_filters": SQL_Q04_FILTERS, "q04_group_links": SQL_Q04_GROUPS, "q05_whole_walk": SQL_Q05_WHOLE, "q09_fetched_wikitext": SQL_Q09_FETCHED, "q05_category_walk": SQL_Q05, "q06_title_from_url": SQL_Q06, "q07_display_title": SQL_Q07, "q08_safe_filename": SQL_Q08, "q09_wikitext_markdown": SQL_Q09, "q10_article_document": SQL_Q10, "q11_summary": SQL_Q11, "q12_infobox": SQL_Q12}
