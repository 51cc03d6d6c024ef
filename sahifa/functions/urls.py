"""Page addresses: normal forms, titles and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import percent_decode

_PARTS = "^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)"
#: What marks a category page, a sub-category on it, and a page that is no article.
CATEGORY_MARKS = ["تصنيف:", "%D8%AA%D8%B5%D9%86%D9%8A%D9%81:", "Category:"]
SUBCATEGORY_MARKS = ["تصنيف:", "%D8%AA%D8%B5%D9%86%D9%8A%D9%81:"]
NAMESPACE_MARKS = [
    "تصنيف:", "%D8%AA%D8%B5%D9%86%D9%8A%D9%81:", "Special:", "خاص:", "User:", "مستخدم:", "File:", "ملف:", "صورة:", "Template:", "قالب:",
    "Talk:", "نقاش:", "Wikipedia:", "ويكيبيديا:", "Help:", "مساعدة:", "Portal:", "بوابة:",
]
PAGING_MARKS = ["pagefrom=", "pageuntil=", "pageupto="]


def normalize(url: Column) -> Column:
    """scheme://authority/path with the scheme in lower case and the path decoded; no query, fragment, parameters of the last segment or closing slashes."""
    path = F.regexp_replace(F.regexp_extract(url, _PARTS, 3), "((?:^|/)[^/;]*);[^/]*$", "$1")
    return F.concat(F.lower(F.regexp_extract(url, _PARTS, 1)), F.lit("://"), F.regexp_extract(url, _PARTS, 2), F.regexp_replace(percent_decode(path), "/+$", ""))


def title_from_path(url: Column) -> Column:
    """What follows the first /wiki/; null where there is none."""
    return F.nullif(F.regexp_extract(url, "/wiki/(.+)$", 1), F.lit(""))


def title_from_link(link: Column) -> Column:
    """What follows the last /wiki/."""
    return F.element_at(F.split(link, "/wiki/"), -1)


def display_title(title: Column) -> Column:
    return F.replace(percent_decode(title), F.lit("_"), F.lit(" "))


def file_name(title: Column) -> Column:
    """A safe name: forbidden characters as underscores, at most 100 characters of the title, .md."""
    return F.concat(F.substring(F.regexp_replace(title, '[<>:"/\\\\|?*]', "_"), 1, 100), F.lit(".md"))


def _without_dots(path: Column) -> Column:
    """The path /a/./b/../c as /a/c; segments that would lead above the root are dropped."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(done: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))

    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


def resolve(base: Column, href: Column) -> Column:
    """A link as seen from its page: absolute, by scheme, authority, directory, query or fragment; dot segments of its path are resolved."""
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    authority = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(F.length(path) > F.length(authority), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.concat(authority, F.lit("/")))
    whole = F.when(href.startswith("/"), F.concat(authority, href)).otherwise(F.concat(folder, href))
    tail = F.regexp_extract(whole, "([?#].*)$", 1)
    body = F.substring(whole, F.lit(1), F.length(whole) - F.length(tail))
    dotted = body.rlike("/\\.\\.?(?:/|$)")
    settled = F.when(dotted, F.concat(authority, _without_dots(F.substring(body, F.length(authority) + 1, F.length(body))), tail)).otherwise(whole)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href == "", base)
        .when(href.startswith("?"), F.concat(path, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(settled)
    )


def contains_any(c: Column, marks: list[str]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | c.contains(m)
    return found


def is_category_page(url: Column) -> Column:
    return contains_any(url, CATEGORY_MARKS)


def is_subcategory_link(href: Column) -> Column:
    return href.startswith("/wiki/") & contains_any(href, SUBCATEGORY_MARKS)


def is_article_link(href: Column) -> Column:
    return href.startswith("/wiki/") & ~contains_any(href, NAMESPACE_MARKS)


def is_paging_link(href: Column) -> Column:
    return contains_any(href, PAGING_MARKS)


def is_category_link(href: Column) -> Column:
    """A category on an English category page."""
    return href.contains("/wiki/Category")


def is_figure_link(href: Column) -> Column:
    return href.startswith("/wiki/") & ~href.contains("/wiki/Category")
