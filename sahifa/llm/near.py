"""Problem 6: records that repeat others with small edits, by T-occurrence search over inverted lists (DivideSkip).

A record is the set of its k-word shingles; the inverted list of a shingle has the records that hold it. For a threshold
t, a record x of a shingles can only match y if they have at least T = ceil(t / (1 + t) * (a + b)) shingles in common. The
shingles of x are ordered by their frequency in the corpus; the L = ceil(t * a) - 1 most frequent ones are its long lists,
the rest its short lists. Whatever matches x occurs at least T - L times in the short lists. These are merged, and only
the records that pass are probed in the long lists by binary search.

The merge is a join of equal shingles that counts by pair, on the map side first; in one process a heap would do it.
Common shingles are kept apart: a list of n records is cut into blocks of at most LIST_BLOCK, and blocks meet in pairs,
so a third of all records in one list makes no large task.

Frequencies come from a sketch (one row of a count-min sketch over all shingles) of at most 2**SKETCH_BITS buckets. Any
total order gives the same result; the sketch only decides how short the short lists are: in a corpus of more shingles
than buckets it tells those apart that are more frequent than a bucket's usual load. A shingle that is alone in its
bucket occurs once in the corpus and needs no list. Sketch and index
read the shingle sets, which are written once and dropped when the index stands; only the texts of candidates are read
again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import broadcast_if_small, cut, discard
from .quality import not_prose
from .text import gram_hashes, mix64, word_hashes

#: log2 of the most buckets of the frequency sketch (one byte each where it is broadcast).
SKETCH_BITS = 25
_CHUNK_BITS = 16
#: Records of a list that meet those of another block of it in one group.
LIST_BLOCK = 2_000
#: Records up to this number are broadcast after they were counted; beyond it they are joined by shuffle.
CANDIDATE_ROWS = 500_000
#: A shingle in this share of the records of a chunk (and in so many of them at least) is common. There are at most
#: 1 / COMMON_SHARE times the shingles of a record for each chunk.
COMMON_SHARE, COMMON_LEAST, COMMON_CHUNK = 0.01, 32, 4096
_SLICE = 256


def shingle_sets(texts: list[str | None], k: int, least_words: int) -> list[np.ndarray | None]:
    """The sorted distinct shingle hashes of each text; None for a text of fewer than `least_words` (or k) words."""
    w, offsets = word_hashes(texts, alef=False)
    grams = gram_hashes(w, k)  # those that run into the next text are never read
    return [np.unique(grams[a : b - k + 1]) if b - a >= max(k, least_words) else None for a, b in zip(offsets.tolist(), offsets[1:].tolist())]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _SLICE):
            yield batch.slice(start, _SLICE)


def record_sets(df: DataFrame, k: int, least_words: int) -> DataFrame:
    """(row, src, rec_id, a, sig, keys): the shingle set of each row of df(src, rec_id, text), its size and a signature of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            rows: list[tuple] = []
            for src, rec, s in zip(b["src"].to_pylist(), b["rec_id"].to_pylist(), shingle_sets(b["text"].to_pylist(), k, least_words)):
                if s is not None:
                    keys = _of_src(s, src)
                    rows.append((src, rec, len(s), _signature(keys), keys.view(np.int64)))
            yield _batch(rows, {"src": pa.int32(), "rec_id": pa.int64(), "a": pa.int32(), "sig": pa.int64(), "keys": pa.list_(pa.int64())})

    return cut(df.mapInArrow(run, "src int, rec_id bigint, a int, sig bigint, keys array<bigint>").withColumn("row", F.monotonically_increasing_id()))


def _of_src(shingles: np.ndarray, src: int) -> np.ndarray:
    """Records of different src have no shingle in common."""
    return mix64(shingles ^ np.uint64((src * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) % (1 << 64)))


def _signature(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix64(keys)).view(np.int64))


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(cols, types.values())], names=list(types))


def frequency_sketch(sets: DataFrame, most_bits: int) -> tuple[np.ndarray, int]:
    """uint8 per bucket: 0 for at most one shingle in it, else about 4 * log2 of their number; and log2 of the buckets.

    There are twice as many buckets as shingles, but 2**most_bits at most. A task sends on the buckets that it met.
    """
    total = sets.agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
    bits = min(most_bits, max(8, int(2 * total).bit_length()))
    chunk = min(bits, _CHUNK_BITS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.uint32)
        for b in _slices(batches):
            at, n = np.unique(b["keys"].values.to_numpy().view(np.uint64) >> np.uint64(64 - bits), return_counts=True)
            counts = counts if len(counts) else np.zeros(1 << bits, dtype=np.uint32)
            counts[at] += n.astype(np.uint32)
        met = np.flatnonzero(counts)
        for c, start, end in zip(*_groups(met >> chunk)):
            at, n = met[start:end], counts[met[start:end]]
            wide = np.uint8 if n.max() < 256 else np.uint32
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([(at & ((1 << chunk) - 1)).astype(np.uint16).tobytes()], pa.binary()), pa.array([n.astype(wide).tobytes()], pa.binary())], names=["chunk", "at", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, at, n in zip(*(b[x].to_pylist() for x in ("chunk", "at", "n"))):
                at = np.frombuffer(at, dtype=np.uint16)
                own = sums.setdefault(c, np.zeros(1 << chunk, dtype=np.int64))
                own[at] += np.frombuffer(n, dtype=np.uint8 if len(n) == len(at) else np.uint32)
        for c, s in sums.items():
            level = np.where(s <= 1, 0, np.minimum(127, np.rint(4 * np.log2(np.maximum(s, 1))))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["chunk", "level"])

    rows = sets.select("keys").mapInArrow(partial, "chunk int, at binary, n binary").repartition("chunk").mapInArrow(merge, "chunk int, level binary").collect()
    sketch = np.zeros(1 << bits, dtype=np.uint8)
    for c, level in rows:
        sketch[c << chunk : (c + 1) << chunk] = np.frombuffer(level, dtype=np.uint8)
    return sketch, bits


def _groups(sorted_: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Values, starts and ends of the runs of a sorted array."""
    starts = np.flatnonzero(np.diff(sorted_, prepend=-1))
    return sorted_[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_)]


def keyed(shingles: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    """Shingles as 63-bit keys in the global order: frequency level first, then 56 bits of the hash; sorted."""
    level = sketch[(shingles >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(56)) | (shingles & np.uint64((1 << 56) - 1))).view(np.int64)


def short_lists(a: int, t: float) -> int:
    """How many of the a shingles of a record, in the global order, are its short lists."""
    return a - math.ceil(t * a - 1e-9) + 1


def least_own(a: Column, t: float) -> Column:
    """What a record of a shingles must at least have in common with any match."""
    return F.ceil(F.lit(t) * a - 1e-9)


def least_overlap(a: Column, b: Column, t: float) -> Column:
    return F.ceil(F.lit(t / (1 + t)) * (a + b) - 1e-9)


def short_index(sets: DataFrame, sketch: object, t: float) -> tuple[DataFrame, DataFrame]:
    """(x, src, rec_id, a, sig, short): the short lists of each record of sets(row, src, rec_id, sig, keys), and the common shingles (key) in them.

    short leaves out what occurs once; a record without any has no row. Common are shingles in at least COMMON_SHARE of
    the records of some chunk of a task, as all are that are in this share of all records. They are kept apart when
    lists are merged; whether one is taken for common or not changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = sketch.value
        types = {"x": pa.int64(), "src": pa.int32(), "rec_id": pa.int64(), "a": pa.int32(), "sig": pa.int64(), "short": pa.list_(pa.int64()), "common": pa.list_(pa.int64())}
        seen: list[np.ndarray] = []

        def common() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(seen), return_counts=True)
            return _batch([(None, None, None, None, None, None, found[n >= max(COMMON_LEAST, COMMON_SHARE * len(seen))])], types)

        for b in _slices(batches):
            rows: list[tuple] = []
            keys = b["keys"]
            for i, (row, src, rec, sig) in enumerate(zip(*(b[c].to_pylist() for c in ("row", "src", "rec_id", "sig")))):
                own = keyed(keys[i].values.to_numpy().view(np.uint64), table, bits)
                short = own[: short_lists(len(own), t)]
                lists = short[short >= (1 << 56)]  # level 0: no other record has it
                if len(lists):
                    rows.append((row, src, rec, len(own), sig, lists, None))
                    seen.append(lists)
            yield _batch(rows, types)
            if len(seen) >= COMMON_CHUNK:
                yield common()
                seen = []
        if seen:
            yield common()

    both = cut(sets.select("row", "src", "rec_id", "sig", "keys").mapInArrow(run, "x bigint, src int, rec_id bigint, a int, sig bigint, short array<bigint>, common array<bigint>"))
    return both.where("common is null").drop("common"), both.where("common is not null").select(F.explode("common").alias("key")).distinct()


def merged(index: DataFrame, common: DataFrame, t: float) -> DataFrame:
    """(x, y, xa, ya): pairs of records, x < y, that are together in so many short lists that they may match.

    Of two records one's short lists end first; what they have in common up to there is in the short lists of both, and
    what is beyond is in its long lists.
    """
    postings = index.select("x", "a", F.explode("short").alias("key"))
    apart = cut(common)
    rare = postings.join(broadcast_if_small(apart, CANDIDATE_ROWS), "key", "left_anti").select("key", "x", "a")
    often = postings.join(broadcast_if_small(apart, CANDIDATE_ROWS), "key", "left_semi")
    # counted by partial sums, as many as there are tasks, however long the list
    lists = cut(often.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / LIST_BLOCK).cast("int")
    own, every = F.pmod(F.xxhash64("x"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    often = often.join(broadcast_if_small(lists, CANDIDATE_ROWS), "key")

    def pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        l, r = left.alias("l"), right.alias("r")
        same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
        sizes = (F.col("r.a") >= least_own(F.col("l.a"), t)) & (F.col("l.a") >= least_own(F.col("r.a"), t))
        return l.join(r, same).where((F.col("l.x") < F.col("r.x")) & sizes).select(F.col("l.x").alias("x"), F.col("r.x").alias("y"), F.col("l.a").alias("xa"), F.col("r.a").alias("ya"))

    both = pairs(rare, rare, ["key"]).unionByName(pairs(often.withColumn("lb", own).withColumn("rb", every), often.withColumn("rb", own).withColumn("lb", every), ["key", "lb", "rb"]))
    counted = both.groupBy("x", "y", "xa", "ya").agg(F.count(F.lit(1)).alias("n"))
    most_long = least_own(F.greatest("xa", "ya"), t) - 1
    return counted.where(F.col("n") >= least_overlap(F.col("xa"), F.col("ya"), t) - most_long).select("x", "y", "xa", "ya")


def probed(candidates: DataFrame, index: DataFrame, base: DataFrame, sketch: object, k: int, t: float) -> DataFrame:
    """(x, y, overlap, similarity) of the candidates that reach the threshold, with the long lists of the one whose short lists end first looked up in the other by binary search."""
    ends = cut(candidates.select(F.explode(F.array("x", "y")).alias("x")).distinct().join(index.select("x", "src", "rec_id", "sig"), "x"))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = sketch.value
        for b in _slices(batches):
            rows = []
            for x, src, sig, s in zip(*(b[c].to_pylist() for c in ("x", "src", "sig")), shingle_sets(b["text"].to_pylist(), k, 0)):
                if s is not None and _signature(own := _of_src(s, src)) == sig:  # another text of the same rec_id is another record
                    rows.append((x, keyed(own, table, bits)))
            yield _batch(rows, {"x": pa.int64(), "keys": pa.list_(pa.int64())})

    texts = base.join(broadcast_if_small(ends, CANDIDATE_ROWS), ["src", "rec_id"]).select("x", "src", "sig", "text")
    # a row that was delivered twice gives its keys twice
    sides = cut(texts.mapInArrow(keys_of, "x bigint, keys array<bigint>")).groupBy("x").agg(F.first("keys").alias("keys"))
    rows = candidates.join(sides.withColumnRenamed("keys", "x_keys"), "x").join(sides.select(F.col("x").alias("y"), F.col("keys").alias("y_keys")), "y").select("x", "y", "x_keys", "y_keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found: list[tuple] = []
            xk, yk = b["x_keys"], b["y_keys"]
            for i, (x, y) in enumerate(zip(b["x"].to_pylist(), b["y"].to_pylist())):
                one, two = xk[i].values.to_numpy(), yk[i].values.to_numpy()
                p, q = short_lists(len(one), t), short_lists(len(two), t)
                if two[q - 1] < one[p - 1]:
                    one, two, p, q = two, one, q, p
                n = len(np.intersect1d(one[:p], two[:q], assume_unique=True))
                long = one[p:]
                at = np.minimum(np.searchsorted(two, long), len(two) - 1)
                overlap = n + int((two[at] == long).sum())
                similarity = overlap / (len(one) + len(two) - overlap)
                if similarity >= t - 1e-9:
                    found.append((x, y, overlap, round(similarity, 6)))
            yield _batch(found, {"x": pa.int64(), "y": pa.int64(), "overlap": pa.int32(), "similarity": pa.float64()})

    return rows.mapInArrow(run, "x bigint, y bigint, overlap int, similarity double")


def near_records(df: DataFrame, k: int = 5, t: float = 0.8, least_words: int = 20, prose_only: bool = True, bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """Pairs between classes of equal records, and the classes.

    df: src int, rec_id bigint, text string; other columns are ignored. Records of one src are compared with each other.
    Returns pairs(src, rep_a, rep_b, overlap, similarity), rep_a < rep_b, of all classes whose shingle sets have a Jaccard
    similarity of at least t, and members(src, rep, rec_id), one row per rec_id of a class that has a partner or several
    members. rep is the smallest rec_id of a class. Rows with a null src, rec_id or text, texts under `least_words` words
    and, with prose_only, lists, tables and junk take no part (they are judged among the records that have a partner). A
    class keeps its links as long as one of its members is left. Rows delivered twice count once.
    """
    base = df.select("src", "rec_id", "text").where("src is not null and text is not null and rec_id is not null")
    sets = record_sets(base, k, least_words)
    small = sets.select("src", "sig", "a", "rec_id", "row")
    # copies meet on the map side; a class is named by one of its rows
    classes = small.groupBy("src", "sig", "a").agg(F.min("row").alias("cls"), F.count(F.lit(1)).alias("rows"))
    repeated = cut(classes.where("rows > 1").drop("rows"))
    copies = cut(small.join(broadcast_if_small(repeated, CANDIDATE_ROWS), ["src", "sig", "a"]).select("src", "cls", "rec_id", "row"))
    single = sets.join(broadcast_if_small(copies.where("row <> cls").select("row"), CANDIDATE_ROWS), "row", "left_anti")
    sketch = base.sparkSession.sparkContext.broadcast(frequency_sketch(single, bits))
    index, common = short_index(single, sketch, t)
    discard(sets)
    candidates = cut(merged(index, common, t))
    found = cut(probed(candidates, index, base, sketch, k, t))

    linked = found.select(F.explode(F.array("x", "y")).alias("row")).distinct()
    alone = index.select("src", F.col("x").alias("row"), "rec_id").join(broadcast_if_small(linked, CANDIDATE_ROWS), "row", "left_semi").select("src", F.col("row").alias("cls"), "rec_id")
    # a class of several rows with a partner has its first row among the linked ones as well
    several = copies.groupBy("cls").agg((F.max("rec_id") > F.min("rec_id")).alias("several"))
    wanted = several.where("several").select("cls").unionByName(linked.withColumnRenamed("row", "cls")).distinct()
    shared = copies.join(broadcast_if_small(wanted, CANDIDATE_ROWS), "cls", "left_semi").select("src", "cls", "rec_id")
    members = cut(alone.unionByName(shared).distinct())
    if prose_only:
        texts = base.join(broadcast_if_small(members.select("src", "rec_id"), CANDIDATE_ROWS), ["src", "rec_id"])
        other = not_prose(texts.select(F.col("src").cast("string").alias("src_table"), "rec_id", "text")).select(F.col("src_table").cast("int").alias("src"), "rec_id")
        members = cut(members.join(other, ["src", "rec_id"], "left_anti"))
    reps = members.groupBy("cls").agg(F.min("src").alias("src"), F.min("rec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    reps = cut(reps)
    a, b = (reps.select(F.col("cls").alias(c), "src", F.col("rep").alias(r)) for c, r in (("x", "rep_x"), ("y", "rep_y")))
    named = found.join(a, "x").join(b.drop("src"), "y")
    pairs = cut(named.select("src", F.least("rep_x", "rep_y").alias("rep_a"), F.greatest("rep_x", "rep_y").alias("rep_b"), "overlap", "similarity"))
    ends = pairs.select("src", F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct().withColumn("linked", F.lit(True))
    kept = reps.join(ends, ["src", "rep"], "left").where("linked or size > 1").select("cls", "rep")
    return pairs, members.join(kept, "cls").select("src", "rep", "rec_id")


def record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(src, rec_a, rec_b), rec_a < rec_b: the pairs of records behind the pairs of classes and the classes themselves."""
    a = members.select("src", F.col("rep").alias("rep_a"), F.col("rec_id").alias("a"))
    b = members.select("src", F.col("rep").alias("rep_b"), F.col("rec_id").alias("b"))
    across = pairs.select("src", "rep_a", "rep_b").join(a, ["src", "rep_a"]).join(b, ["src", "rep_b"])
    within = a.withColumn("rep_b", F.col("rep_a")).join(b, ["src", "rep_b"]).where("a < b")
    both = across.select("src", "a", "b").unionByName(within.select("src", "a", "b"))
    return both.select("src", F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b"))


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(src, rec_id, rep, links): each member with its class and the number of other classes it is linked to."""
    links = pairs.select("src", F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("src", "rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(links, ["src", "rep"], "left").select("src", "rec_id", "rep", F.coalesce("links", F.lit(0)).alias("links"))
