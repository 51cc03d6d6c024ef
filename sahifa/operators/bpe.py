"""Byte-pair encoding: training from piece counts, encoding, decoding and quality measures."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .corpus import MARK, pieces

#: Tokens that come first, in this order.
SPECIALS = ["[PAD]", "[UNK]", "[BOS]", "[EOS]"]
#: Distinct pieces from which merges are learned on the driver; more are refused (raise the least frequency instead).
PIECE_BOUND = 5_000_000


def learn(counts: dict[str, int], size: int, least: int, specials: list[str] = SPECIALS) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges from piece counts.

    The alphabet follows the special tokens in order of code point. Each step merges the most frequent neighbouring
    pair, of equal ones that with the smallest ids, until the vocabulary is full or the best pair is rarer than `least`.
    Pair counts are kept up to date in a heap; an entry that no longer holds is put back with its present count.
    """
    vocab = {t: i for i, t in enumerate(specials)}
    for c in sorted({c for w in counts for c in w}):
        vocab.setdefault(c, len(vocab))
    names = list(vocab)
    words = [[vocab[c] for c in w] for w in counts]
    often = list(counts.values())
    total: dict[tuple[int, int], int] = defaultdict(int)
    # words that hold or held the pair; one may stand there twice
    where: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        for p in zip(w, w[1:]):
            total[p] += often[i]
            where[p].append(i)
    heap = [(-n, p) for p, n in total.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    while len(vocab) < size and heap:
        n, pair = heapq.heappop(heap)
        if total[pair] != -n:
            if total[pair] > 0:
                heapq.heappush(heap, (-total[pair], pair))
            continue
        if -n < least:
            break
        a, b = pair
        token = names[a] + names[b]
        new = vocab.get(token)
        if new is None:
            new = vocab[token] = len(vocab)
            names.append(token)
        merges.append((names[a], names[b]))
        touched: set[tuple[int, int]] = set()
        for i in where.pop(pair):
            w, count = words[i], often[i]
            last, gone, j, at = len(w) - 1, 0, 0, []
            out: list[int] = []
            while j <= last:
                if w[j] == a and j < last and w[j + 1] == b:
                    # the pairs at j - 1, j and j + 1 go, each once
                    for k in range(max(gone, j - 1), min(j + 2, last)):
                        total[w[k], w[k + 1]] -= count
                    gone = j + 2
                    at.append(len(out))
                    out.append(new)
                    j += 2
                else:
                    out.append(w[j])
                    j += 1
            if not at:
                continue
            words[i] = out
            last, come = len(out) - 1, 0
            for j in at:
                for k in range(max(come, j - 1), min(j + 1, last)):
                    p = (out[k], out[k + 1])
                    total[p] += count
                    where[p].append(i)
                    touched.add(p)
                come = j + 1
        total[pair] = 0
        for p in touched:
            if total[p] > 0:
                heapq.heappush(heap, (-total[p], p))
    return vocab, merges


def train(counts: DataFrame, size: int, least: int) -> tuple[DataFrame, DataFrame]:
    """vocab(token, id) and merges(merge_rank, left_token, right_token) from counts(piece, n).

    Counting is distributed; the merges need all counts at once and are learned from the table of distinct pieces, which
    is bounded by PIECE_BOUND and refused beyond it.
    """
    spark = counts.sparkSession
    rows = counts.limit(PIECE_BOUND + 1).collect()
    if len(rows) > PIECE_BOUND:
        raise ValueError(f"more than {PIECE_BOUND} distinct pieces")
    vocab, merges = learn({r["piece"]: r["n"] for r in rows}, size, least)
    return (
        spark.createDataFrame(list(vocab.items()), "token string, id int"),
        spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "merge_rank int, left_token string, right_token string"),
    )


def merge_piece(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """A piece's symbols after all merges that apply, lowest rank first."""
    while len(symbols) > 1:
        best = min(((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:]))))
        if best[0] == 1 << 60:
            break
        pair = (symbols[best[1]], symbols[best[1] + 1])
        out, j = [], 0
        while j < len(symbols):
            if j + 1 < len(symbols) and (symbols[j], symbols[j + 1]) == pair:
                out.append(pair[0] + pair[1])
                j += 2
            else:
                out.append(symbols[j])
                j += 1
        symbols = out
    return symbols


def encode(df: DataFrame, key: str, vocab: DataFrame, merges: DataFrame, text: str = "text") -> DataFrame:
    """(key, tokens, ids) of each text; a character without a token is the unknown token. A null text gives nulls.

    Merges are applied to each distinct piece of a batch once; the tables go to the workers by broadcast and are refused beyond PIECE_BOUND rows.
    """
    kind = df.schema[key].dataType.simpleString()
    tables = [t.limit(PIECE_BOUND + 1).collect() for t in (vocab.select("token", "id"), merges.select("left_token", "right_token", "merge_rank"))]
    if max(map(len, tables)) > PIECE_BOUND:
        raise ValueError(f"more than {PIECE_BOUND} tokens or merges")
    v = {r["token"]: r["id"] for r in tables[0]}
    m = {(r["left_token"], r["right_token"]): r["merge_rank"] for r in tables[1]}
    shared = df.sparkSession.sparkContext.broadcast((v, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ranks = shared.value
        unknown = SPECIALS[1]
        for b in batches:
            seen: dict[str, list[str]] = {}
            tokens = []
            for cut in b["pieces"].to_pylist():
                if cut is None:
                    tokens.append(None)
                    continue
                out: list[str] = []
                for p in cut:
                    if p not in seen:
                        seen[p] = [t if t in table else unknown for t in merge_piece([c if c in table else unknown for c in p], ranks)]
                    out += seen[p]
                tokens.append(out)
            ids = [None if t is None else [table.get(x, table.get(unknown, 1)) for x in t] for t in tokens]
            yield pa.RecordBatch.from_arrays([b[key], pa.array(tokens, pa.list_(pa.string())), pa.array(ids, pa.list_(pa.int32()))], names=[key, "tokens", "ids"])

    return df.select(key, pieces(F.col(text)).alias("pieces")).mapInArrow(run, f"`{key}` {kind}, tokens array<string>, ids array<int>")


def decode(tokens: Column) -> Column:
    """The text of tokens: special ones skipped, marks as spaces, the first space dropped."""
    shown = F.filter(tokens, lambda t: ~t.isin(SPECIALS))
    return F.regexp_replace(F.replace(F.array_join(shown, ""), F.lit(MARK), F.lit(" ")), "^ ", "")


def padded(df: DataFrame, key: str, ids: str = "ids", pad: int = 0) -> DataFrame:
    """(key, ids, valid): ids filled up with `pad` to the longest row, and which places are real. Null ids give nulls."""
    longest = df.agg(F.coalesce(F.max(F.size(ids)), F.lit(0)).alias("__n"))
    wide = df.select(key, F.col(ids).alias("ids")).crossJoin(F.broadcast(longest))  # one row
    missing = F.col("__n") - F.size("ids")
    return wide.select(key, F.concat("ids", F.array_repeat(F.lit(pad), missing)).alias("ids"), F.concat(F.array_repeat(F.lit(True), F.size("ids")), F.array_repeat(F.lit(False), missing)).alias("valid"))


def token_ids(df: DataFrame, key: str, vocab: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(key, pos, token, id): tokens looked up in the vocabulary, those without an entry as the unknown one."""
    unknown = F.lit(1)
    rows = df.select(key, F.posexplode(tokens).alias("pos", "token"))
    return rows.join(vocab.select("token", "id"), "token", "left").select(key, "pos", "token", F.coalesce("id", unknown).alias("id"))


def length_histogram(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(length, tokens) in order of length."""
    return tokens.groupBy(F.length(token).alias("length")).agg(F.count(F.lit(1)).alias("tokens")).orderBy("length")


def read_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")


def write_tokenizer(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    merges.write.mode("overwrite").parquet(f"{path}/merges")
