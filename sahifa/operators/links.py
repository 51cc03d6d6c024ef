"""Links of category pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import urls
from ..functions.text import trim


class _Scanner(HTMLParser):
    """Collects the page's main heading and its links with the section they stand in."""

    SECTIONS = {"mw-subcategories": "subcategories", "mw-pages": "pages"}
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.heading, self.links = "", []
        self.stack: list[tuple[str, str]] = []
        self.link: list | None = None
        self.in_heading = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        section = self.SECTIONS.get(a.get("id") or "", "group" if "mw-category-group" in classes else "") if tag == "div" else ""
        if tag not in self.VOID:
            self.stack.append((tag, section))
        if tag == "h1" and "firstHeading" in classes:
            self.in_heading = True
        if tag == "a" and a.get("href") is not None:
            inside = [s for _, s in self.stack if s]
            self.link = [inside[0] if inside else "", a["href"], ""]

    def handle_endtag(self, tag: str) -> None:
        if tag == "h1":
            self.in_heading = False
        if tag == "a" and self.link:
            self.links.append(tuple(self.link))
            self.link = None
        # tags left open inside are closed with it
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.in_heading:
            self.heading += data
        if self.link:
            self.link[2] += data


def page_links(df: DataFrame, key: str, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, heading, section, pos, href, label): one row per link of each page, in the order of the page.

    section is subcategories, pages, group or empty; keep names columns that are handed through. A page without links
    has one row with a null href; a null page none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    held = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for *own, text in zip(*(b[c].to_pylist() for c in held), b[html].to_pylist()):
                if text is None:
                    continue
                s = _Scanner()
                s.feed(text)
                s.close()
                found = s.links or [(None, None, None)]
                rows += [(*own, s.heading, section, i, href, label) for i, (section, href, label) in enumerate(found)]
            types = (*(b.schema.field(c).type for c in held), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            cols = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[*held, "heading", "section", "pos", "href", "label"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in held)
    return df.select(*held, html).mapInArrow(run, f"{schema}, heading string, section string, pos int, href string, label string")


def category_links(df: DataFrame, key: str, url: str, html: str = "html") -> DataFrame:
    """(key, category, kind, pos, url, label) of the pages that are category pages.

    kind is subcategory, article or paging by section and address; a link that is an article and leads to another page
    of the list as well has a row for each, other links give none. category is the page's heading without the
    namespace. Pages are filtered by address before they are parsed.
    """
    pages = df.where(urls.is_category_page(F.col(url))).select(key, F.col(url).alias("__base"), html)
    links = page_links(pages, key, html, ("__base",)).where("href is not null")
    h, section = F.col("href"), F.col("section")
    kinds = F.array_compact(F.array(
        F.when((section == "subcategories") & urls.is_subcategory_link(h), "subcategory"),
        F.when((section == "pages") & urls.is_article_link(h), "article"),
        F.when((section == "pages") & urls.is_paging_link(h), "paging"),
    ))
    category = trim(F.replace(F.col("heading"), F.lit("تصنيف:"), F.lit("")))
    return links.select(key, category.alias("category"), F.explode(kinds).alias("kind"), "pos", urls.resolve(F.col("__base"), h).alias("url"), trim(F.col("label")).alias("label"))


def group_links(df: DataFrame, key: str, url: str, category: str, html: str = "html") -> DataFrame:
    """(key, kind, pos, name, url, category) of the links in the groups of English category pages.

    kind is category (category is null) or figure, which carries the category of its page; other links give no row.
    """
    pages = df.select(key, F.col(url).alias("__base"), F.col(category).alias("__category"), html)
    links = page_links(pages, key, html, ("__base", "__category")).where("href is not null and section = 'group'")
    kind = F.when(urls.is_category_link(F.col("href")), "category").when(urls.is_figure_link(F.col("href")), "figure")
    rows = links.withColumn("kind", kind).where("kind is not null")
    return rows.select(key, "kind", "pos", trim(F.col("label")).alias("name"), urls.resolve(F.col("__base"), F.col("href")).alias("url"), F.when(F.col("kind") == "figure", F.col("__category")).alias("category"))
