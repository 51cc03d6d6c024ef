"""Problem 4: exact token counts under a given tokenizer, and budgets by source, language and domain."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import script_of

#: A tokenizer's tables are gathered on the driver; more rows than this are refused.
TOKENIZER_BOUND = 2_000_000
#: Pieces whose token counts a worker keeps; the store is emptied when it is full.
CACHE_PIECES = 500_000
_SLICE = 512
#: The tokenizers of this process, by a digest of their tables. Tasks reach it through counter_of, a function of this
#: module, which they import; a global that a closure names would be copied into each task.
_loaded: dict[str, "Counter"] = {}


class Counter:
    """Token counts of texts. Pieces between spaces are independent of each other, so each distinct piece is encoded once.

    A space starts a piece and shows as the mark at its head; a text that does not begin with one gets it. Strings of
    special tokens are ordinary text. A character without a token counts as one unknown token.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], unknown: str = "[UNK]") -> None:
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, unk_token=unknown if unknown in vocab else None))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
        self.known: dict[str, int] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        parts = text.replace(" ", "▁").split("▁")
        return parts[1:] if parts[0] == "" and len(parts) > 1 else parts if text else []

    def counts(self, texts: list[str | None]) -> np.ndarray:
        found = [self.pieces(t) if t else [] for t in texts]
        lengths = np.array([len(f) for f in found], dtype=np.int64)
        flat = np.empty(int(lengths.sum()), dtype=object)
        at = 0
        for f in found:
            flat[at : at + len(f)] = f
            at += len(f)
        out = np.zeros(len(texts), dtype=np.int64)
        if not len(flat):
            return out
        codes, unique = pd.factorize(flat)
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        new = [p for p in unique if p not in self.known]
        # the mark stands before each piece: an empty piece is the mark alone
        for p, e in zip(new, self.tokenizer.encode_batch_fast(["▁" + p for p in new], add_special_tokens=False)):
            self.known[p] = len(e.ids)
        per = np.fromiter((self.known[p] for p in unique), dtype=np.int64, count=len(unique))
        ends = np.cumsum(lengths)
        total = np.concatenate(([0], np.cumsum(per[codes])))
        return total[ends] - total[ends - lengths]


def counter_of(digest: str, tables: Callable[[], tuple]) -> Counter:
    """The counter of this process for the tables with that digest; built when it is first asked for."""
    if digest not in _loaded:
        _loaded[digest] = Counter(*tables())
    return _loaded[digest]


def built() -> int:
    """How many counters this process has built."""
    return len(_loaded)


def tokenizer_tables(vocab: DataFrame, merges: DataFrame) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """vocab(token, id) and merges(merge_rank, left_token, right_token) as plain values; refused beyond TOKENIZER_BOUND."""
    v = vocab.select("token", "id").where("token is not null and id is not null").limit(TOKENIZER_BOUND + 1).collect()
    m = merges.select("merge_rank", "left_token", "right_token").where("merge_rank is not null").limit(TOKENIZER_BOUND + 1).collect()
    if max(len(v), len(m)) > TOKENIZER_BOUND:
        raise ValueError(f"more than {TOKENIZER_BOUND} tokens or merges")
    return {r[0]: r[1] for r in v}, [(r[1], r[2]) for r in sorted(m)]


def count_tokens(df: DataFrame, vocab: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lang and tokens of each row of df.

    df: the key columns and text; other columns are ignored. lang is 'ar' or 'en' by the letters of the text ('none'
    without any). A null or empty text has no tokens. The tokenizer is built once per worker process, whatever the number
    of its tasks.
    """
    tables = tokenizer_tables(vocab, merges)
    digest = hashlib.sha256(repr(tables).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(tables)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", lang string, tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counter = counter_of(digest, lambda: shared.value)
            for start in range(0, batch.num_rows, _SLICE):
                b = batch.slice(start, _SLICE)
                texts = b["text"].to_pylist()
                langs = [script_of(t) if t else "none" for t in texts]
                yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(langs), pa.array(counter.counts(texts), pa.int64())], names=[*keys, "lang", "tokens"])

    return df.select(*keys, "text").mapInArrow(run, schema)


def name_key(c: Column) -> Column:
    """A source or category as it is compared: trimmed, lower case, hyphens and spaces as underscores; blank and null as null."""
    s = F.regexp_replace(F.lower(F.trim(c)), "[\\s\\-]+", "_")
    return F.when(s != "", s)


def budget(counts: DataFrame) -> DataFrame:
    """Totals of counts(src_table, source, lang, category, tokens) over the cube of source, language and category.

    Missing values are the group '(none)'; a column that a row sums over is null. documents and tokens are exact.
    """
    held = counts.select("src_table", *[F.coalesce(F.col(c), F.lit("(none)")).alias(c) for c in ("source", "lang", "category")], "tokens")
    # one partial sum per finest cell before the cube multiplies the rows
    cells = held.groupBy("src_table", "source", "lang", "category").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    sets = [["src_table", *[c for c, on in zip(("source", "lang", "category"), (i & 4, i & 2, i & 1)) if on]] for i in range(8)]
    return cells.groupingSets(sets, "src_table", "source", "lang", "category").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
