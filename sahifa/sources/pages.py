"""Snapshots of pages in place of a network: address to content, and API responses to wikitext."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_RESPONSE = "struct<query:struct<pages:map<string,struct<title:string,pageprops:map<string,string>,revisions:array<struct<`*`:string,slots:struct<main:struct<`*`:string>>>>>>>>"


def fetched(requests: DataFrame, snapshot: DataFrame, on: str = "url", content: str = "html") -> DataFrame:
    """Requests with the content of their page; pages that are missing, null or empty drop out."""
    return requests.join(snapshot.select(on, content), on).where(F.col(content).isNotNull() & (F.col(content) != ""))


def wikitext_of(response: Column) -> Column:
    """The wikitext of an API response: that of its first page, in a slot or directly in its revision.

    Null for text that is not JSON, a response without pages, a missing page (id -1) or one without revisions.
    """
    pages = F.from_json(response, _RESPONSE)["query"]["pages"]
    first = F.when(F.size(pages) > 0, F.map_entries(pages)[0])
    revision = F.get(first["value"]["revisions"], F.lit(0))
    return F.when(first["key"] != "-1", F.coalesce(revision["slots"]["main"]["*"], revision["*"]))
