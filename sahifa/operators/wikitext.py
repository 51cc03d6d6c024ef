"""Wiki markup: lines to Markdown, summaries, and infoboxes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import trim


def clean_line(c: Column) -> Column:
    """Links, bold and italic of a line as Markdown, references removed, in this order."""
    for pattern, to in (
        (r"\[\[([^|\]]+\|)?([^\]]+)\]\]", "$2"),
        (r"'''([^']+)'''", "**$1**"),
        (r"''([^']+)''", "*$1*"),
        (r"(?d)<ref[^>]*>.*?</ref>", ""),
        (r"<ref[^>]*/>", ""),
    ):
        c = F.regexp_replace(c, pattern, to)
    return c


def to_markdown(c: Column) -> Column:
    """The Markdown of a wikitext.

    Each line becomes a block or nothing; a paragraph after a list item gets a blank line before it. Which block came
    before is read from the array of blocks, so the text is neither folded nor windowed.
    """
    def block(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    nothing = F.lit(None).cast("struct<kind:string,text:string>")

    def line_block(x: Column) -> Column:
        level = F.length(F.regexp_extract(x, "^(=*)", 1))
        title = F.regexp_replace(F.regexp_replace(x, "^[= ]+|[= ]+$", ""), r"\[\[([^|\]]+\|)?([^\]]+)\]\]", "$2")
        heading = F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.floor(level / 2).cast("int") + 1), F.lit(" "), title, F.lit("\n\n"))
        item = clean_line(trim(F.substring(x, 2, 1 << 30)))
        text = clean_line(x)
        return (
            F.when((x == "") | x.startswith("{{") | x.startswith("[[Category:") | x.startswith("[[تصنيف:"), nothing)
            .when(x.startswith("=="), block("h", heading))
            .when(x.startswith("*"), block("l", F.concat(F.lit("- "), item, F.lit("\n"))))
            .when(x.startswith("#"), block("l", F.concat(F.lit("1. "), item, F.lit("\n"))))
            .when(x.rlike("^[{|!]") | (text == "") | text.startswith("thumb|"), nothing)
            .otherwise(block("p", F.concat(text, F.lit("\n\n"))))
        )

    blocks = F.filter(F.transform(F.transform(F.split(c, "\n", -1), trim), line_block), lambda b: b.isNotNull())
    joined = F.transform(blocks, lambda b, i: F.when((b["kind"] == "p") & (i > 0) & (F.get(blocks, i - 1)["kind"] == "l"), F.concat(F.lit("\n"), b["text"])).otherwise(b["text"]))
    return F.array_join(joined, "")


def summary(c: Column, lines: int = 3) -> Column:
    """The first lines before a heading, trimmed and joined by spaces; blank lines and those that begin with = are left out."""
    all_lines = F.transform(F.split(c, "\n", -1), trim)
    first = F.array_position(F.transform(all_lines, lambda x: x.startswith("==")), F.lit(True))
    before = F.when(first > 0, F.slice(all_lines, F.lit(1), (first - 1).cast("int"))).otherwise(all_lines)
    return F.array_join(F.slice(F.filter(before, lambda x: (x != "") & ~x.startswith("=")), 1, lines), " ")


def document(title: Column, url: Column, category: Column, parents: Column, content: Column) -> Column:
    """A Markdown document: heading, metadata, rule, content. A null category reads N/A; no parents, no line for them."""
    ancestry = F.when(F.size(parents) > 0, F.concat(F.lit("- **Parent Categories:** "), F.array_join(parents, " > "), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("# "), title, F.lit("\n\n## [METADATA]\n\n- **URL:** "), url, F.lit("\n- **Category:** "), F.coalesce(category, F.lit("N/A")), F.lit("\n"),
        F.coalesce(ancestry, F.lit("")), F.lit("\n---\n\n## [CONTENT]\n\n"), content,
    )


def _templates(text: str) -> Iterator[str]:
    """The bodies of the templates of a text, nested ones too, by matching braces; each at the place where it opens."""
    open_at: list[int] = []
    found = []
    i = 0
    while i < len(text) - 1:
        two = text[i : i + 2]
        if two == "{{":
            open_at.append(i + 2)
            i += 2
        elif two == "}}" and open_at:
            start = open_at.pop()
            found.append((start, text[start:i]))
            i += 2
        else:
            i += 1
    for _, body in sorted(found):
        yield body


def _fields(body: str) -> list[str]:
    """A template's body cut at the bars that are not inside a link or another template."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(body):
        pair = body[i : i + 2]
        if pair in ("{{", "[["):
            depth += 1
        elif pair in ("}}", "]]"):
            depth -= 1
        elif c == "|" and depth <= 0:
            parts.append(body[start:i])
            start = i + 1
    return [*parts, body[start:]]


_STRIP = [
    (re.compile(r"<!--.*?-->", re.S), ""), (re.compile(r"<ref[^>/]*/>"), ""), (re.compile(r"<ref[^>]*>.*?</ref>", re.S), ""), (re.compile(r"\{\{[^{}]*\}\}"), ""),
    (re.compile(r"\[\[(?:File|Image|ملف|صورة):[^\[\]]*\]\]"), ""), (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"), (re.compile(r"\[https?://\S+ ([^\]]*)\]"), r"\1"),
    (re.compile(r"'{2,5}"), ""), (re.compile(r"<br\s*/?>"), " "), (re.compile(r"</?[a-zA-Z][^<>]*>"), ""), (re.compile(r"^=+\s*(.*?)\s*=+\s*$", re.M), r"\1"),
]


def strip_markup(text: str) -> str:
    """Plain text of a wikitext: templates, references, tags and files removed, links by their label, heading marks gone."""
    last = None
    while last != text:
        last = text
        for pattern, to in _STRIP:
            text = pattern.sub(to, text)
    return text


def infobox(text: str) -> dict[str, str]:
    """Parameters of every template whose name holds 'infobox'; later ones overwrite. Parameters without a name are numbered."""
    out: dict[str, str] = {}
    for body in _templates(text):
        name, *fields = _fields(body)
        if "infobox" not in name.strip().lower():
            continue
        unnamed = 0
        for f in fields:
            key, sep, value = f.partition("=")
            if sep:
                out[key.strip()] = strip_markup(value.strip()).strip()
            else:
                unnamed += 1
                out[str(unnamed)] = strip_markup(f.strip()).strip()
    return out


def parse_pages(df: DataFrame, keys: list[str], column: str = "wikitext") -> DataFrame:
    """keys, infobox map<string,string> and plain text of each page. A null wikitext gives nulls."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b[column].to_pylist()
            boxes = [None if t is None else list(infobox(t).items()) for t in texts]
            plain = [None if t is None else strip_markup(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(boxes, pa.map_(pa.string(), pa.string())), pa.array(plain, pa.string())], names=[*keys, "infobox", "plain"])

    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", infobox map<string,string>, plain string"
    return df.select(*keys, column).mapInArrow(run, schema)


def figure_records(pages: DataFrame) -> DataFrame:
    """name, url, category, title, summary and infobox of pages(name, url, category, title, wikitext)."""
    parsed = parse_pages(pages, ["name", "url", "category", "title"])
    return parsed.select("name", "url", "category", "title", summary(F.col("plain")).alias("summary"), "infobox")
