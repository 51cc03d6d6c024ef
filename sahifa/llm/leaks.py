"""Problem 7: passages of held-out test items in a corpus, found by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import broadcast_if_small, cut
from .text import gram_hashes, word_hashes

#: Words of a shared passage from which it counts as a leak.
SPAN = 15
#: Words of a fingerprint; a window holds SPAN - GRAM + 1 of them, so every shared run of SPAN words shares a fingerprint.
GRAM = 8
#: Test fingerprints and hit documents up to these numbers are broadcast after they were counted, more are joined by shuffle.
FINGERPRINT_ROWS = 500_000
HIT_ROWS = 500_000
#: Items are broadcast up to this number and this many characters.
ITEM_ROWS, ITEM_CHARS = 20_000, 50_000_000
_SLICE = 256


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost smallest hash of each window of h, each once and in order.

    A text shorter than a window keeps the smallest of what it has.
    """
    n = len(h)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(h[::-1]))], dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    at = window - 1 - np.argmin(view[:, ::-1], axis=1) + np.arange(n - window + 1)
    return np.unique(at)


def fingerprints(df: DataFrame, key: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, fp, pos): the winnowed fingerprints of df.text. Texts under `span` words, null or empty give no row."""
    window = span - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                b = batch.slice(start, _SLICE)
                keys = b[key].to_pylist()
                w, offsets = word_hashes(b["text"].to_pylist())
                fps, places, owners = [], [], []
                for i, k in enumerate(keys):
                    own = w[offsets[i] : offsets[i + 1]]
                    if k is None or len(own) < span:
                        continue
                    h = gram_hashes(own, gram)
                    at = winnow(h, window)
                    fps.append(h[at].view(np.int64))
                    places.append(at.astype(np.int32))
                    owners.append(np.full(len(at), k, dtype=np.int64))
                if fps:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (owners, fps, places)], names=[key, "fp", "pos"])

    return df.select(key, "text").mapInArrow(run, f"{key} bigint, fp bigint, pos int")


def leaks(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, item_id, longest): documents that hold at least `span` consecutive words of an item, and the longest run.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Fingerprints of both sides are joined; each hit
    is then extended along its diagonal over the whole texts, so a chance hit gives no row. Rows with a null key or text
    give none; a repeated doc_id or item_id counts once per pair with its longest run.
    """
    test = cut(fingerprints(items, "item_id", span, gram)).withColumnRenamed("pos", "item_pos")
    corpus = fingerprints(docs, "doc_id", span, gram)
    # distinct diagonals are bounded by the words of one document and one item
    hits = corpus.join(broadcast_if_small(test, FINGERPRINT_ROWS), "fp").groupBy("doc_id", "item_id").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("shifts"))
    hits = cut(hits)
    texts = docs.select("doc_id", "text").join(broadcast_if_small(hits, HIT_ROWS, F.size("shifts"), 4 * HIT_ROWS), "doc_id")
    pairs = texts.join(broadcast_if_small(items.select("item_id", F.col("text").alias("item_text")), ITEM_ROWS, F.length("item_text"), ITEM_CHARS), "item_id")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                b = batch.slice(start, _SLICE)
                n = b.num_rows
                w, offsets = word_hashes(b["text"].to_pylist() + b["item_text"].to_pylist())
                longest = []
                for i, shifts in enumerate(b["shifts"].to_pylist()):
                    doc, item = w[offsets[i] : offsets[i + 1]], w[offsets[n + i] : offsets[n + i + 1]]
                    longest.append(max((_run(doc, item, s) for s in shifts), default=0))
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["item_id"], pa.array(longest, pa.int32())], names=["doc_id", "item_id", "longest"])

    found = pairs.select("doc_id", "item_id", "text", "item_text", "shifts").mapInArrow(extend, "doc_id bigint, item_id bigint, longest int")
    return found.where(F.col("longest") >= span).groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"))


def _run(doc: np.ndarray, item: np.ndarray, shift: int) -> int:
    """The longest run of equal words when item is laid on doc with its first word at `shift`."""
    lo, hi = max(0, shift), min(len(doc), len(item) + shift)
    if hi <= lo:
        return 0
    same = doc[lo:hi] == item[lo - shift : hi - shift]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max(initial=0))
