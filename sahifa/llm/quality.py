"""Problem 3: statistics of each text, outlier scores from exact ranks, and the records that are not prose.

A score is the sum of -ln of empirical tail probabilities: how few texts of running prose have so many entries, figures,
odd marks or echoes of themselves, or so few of the words that sentences need. Each way in which a text fails to be prose is a
signature of two statistics; the highest sum is the outlier score of the text, and its signature tells the kind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import broadcast_if_small, cut
from .prose import STATISTICS, measures
from .text import script_of

#: For each signature its kind, its two statistics with the side of the tail, and the least that the first one must be
#: for a text to be mostly that. Of equal scores the first counts.
SIGNATURES = [
    ("table", ("figure_cell_share", "up"), ("common_word_share", "down"), 0.2),
    ("junk", ("noise_share", "up"), ("symbol_ratio", "up"), 0.3),
    ("table", ("bar_share", "up"), ("common_word_share", "down"), 0.2),
    ("junk", ("unreadable_share", "up"), ("common_word_share", "down"), 0.05),
    ("junk", ("echo_share", "up"), ("distinct_word_share", "down"), 0.5),
    ("junk", ("single_letter_share", "up"), ("letter_run_length", "down"), 0.3),
    ("list", ("entry_share", "up"), ("common_word_share", "down"), 0.5),
]
SIDES = dict(x for _, a, b, _ in SIGNATURES for x in (a, b))
#: A text mostly of closed sentences is running prose: what the others are ranked among.
REFERENCE_SHARE = 0.5
#: Tails below one in TAIL_FLOOR count as that: in a large corpus some lists get among the running prose, and a tail
#: cannot tell more than their share.
TAIL_FLOOR = 1000
#: Part of the highest possible sum from which a text is an outlier: both statistics far out, or nearly so.
OUTLIER_PART = 0.8
#: A language with fewer texts of running prose is ranked among those of all languages; under LEAST_RANKED of these the
#: tails tell nothing: the least values of the signatures decide alone, where words that sentences need are under RARELY.
LEAST_PROSE, LEAST_RANKED, RARELY = 1000, 20, 0.05
#: More distinct (language, statistic, value) rows than this are joined by shuffle.
BROADCAST_ROWS = 200_000


def measured(texts: list[str | None]) -> list[pa.Array]:
    """Columns of a batch: lang and STATISTICS of each text; null for a null or blank one."""
    rows = [(script_of(t), measures(t)) if t and t.strip() else (None, None) for t in texts]
    return [pa.array([x for x, _ in rows], pa.string()), *(pa.array([m and m[s] for _, m in rows], pa.float64()) for s in STATISTICS)]


MEASURED = "lang string, " + ", ".join(f"{s} double" for s in STATISTICS)


def profile(df: DataFrame) -> DataFrame:
    """One row per (src_table, rec_id) with the statistics of its text.

    df: src_table string, rec_id bigint, text string; other columns are ignored. Rows with a null or blank text give no
    row. Of several rows with one key the smallest profile stays (rows delivered twice have equal ones).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["src_table"], b["rec_id"], *measured(b["text"].to_pylist())], names=["src_table", "rec_id", "lang", *STATISTICS])

    rows = df.select("src_table", F.col("rec_id").cast("bigint").alias("rec_id"), "text").mapInArrow(run, f"src_table string, rec_id bigint, {MEASURED}").where("lang is not null")
    best = F.min(F.struct("lang", *STATISTICS)).alias("m")
    return rows.groupBy("src_table", "rec_id").agg(best).select("src_table", "rec_id", "m.*")


def ranks(values: DataFrame, weight: Column | None = None) -> DataFrame:
    """Exact ranks within (lang, stat): values(lang, stat, value) -> one row per distinct value with below, upto and total.

    below and upto are the numbers of rows under and up to the value; a row counts `weight` times (once if not given), so
    one of weight 0 has a rank among the others without being one of them. Distinct values are counted before anything is
    sorted, then sorted by ranges; a range adds the counts of the ranges before it, so no task sees a whole group.
    """
    counts = values.groupBy("lang", "stat", "value").agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    parts = cut(counts.repartitionByRange("lang", "stat", "value").withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("lang", "stat", "part").agg(F.sum("n").alias("in_part"))
    before = Window.partitionBy("lang", "stat").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("lang", "stat")
    offsets = sums.select("lang", "stat", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"), F.sum("in_part").over(whole).alias("total"))
    inside = Window.partitionBy("lang", "stat", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = parts.withColumn("run", F.sum("n").over(inside))
    joined = running.join(offsets, ["lang", "stat", "part"])
    return joined.select("lang", "stat", "value", (F.col("offset") + F.col("run") - F.col("n")).alias("below"), (F.col("offset") + F.col("run")).alias("upto"), "total")


def score(profiles: DataFrame, keys: list[str], part: float = OUTLIER_PART) -> DataFrame:
    """profiles(keys, lang, statistics) with outlier_score and kind.

    Tails are one-sided, among the distinct profiles of running prose in the language, the ranked text counted as one
    more of them: a shape scores the same however common it is, and copies count once. Texts without letters and
    languages with too little prose are ranked among the prose of all languages. A text is an outlier from `part` of the
    highest sum on that its reference allows. Words and short sentences are prose and score nothing.
    """
    used = list(SIDES)
    # copies of a text have one profile and count once
    single = profiles.where("short = 0").select("lang", "closed_share", *used).distinct()
    is_prose = (F.col("closed_share") >= REFERENCE_SHARE) & (F.col("lang") != "none")
    sizes = {r["lang"]: r["n"] for r in single.groupBy("lang").agg(F.sum(is_prose.cast("int")).alias("n")).collect()}  # three rows at most
    own = [x for x, n in sizes.items() if n >= LEAST_PROSE]
    group = F.when(F.col("lang").isin(own), F.col("lang")).otherwise(F.lit("all"))
    ranked = single.select(group.alias("lang"), is_prose.cast("int").alias("weight"), *used)
    if len(own) < len(sizes):
        ranked = ranked.unionByName(single.where(F.col("lang").isin(own) & is_prose).select(F.lit("all").alias("lang"), F.lit(1).alias("weight"), *used))
    stats = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in used])).alias("s")
    found = ranks(ranked.select("lang", "weight", stats).select("lang", "weight", "s.stat", "s.value"), F.col("weight"))
    beyond = F.when(F.col("stat").isin([s for s, side in SIDES.items() if side == "up"]), F.col("total") - F.col("below")).otherwise(F.col("upto"))
    surprise = -F.log(F.greatest((beyond + 1) / (F.col("total") + 1), F.lit(1 / (TAIL_FLOOR + 1))))
    tails = cut(found.select("lang", "stat", "value", surprise.alias("surprise"), F.col("total").alias("reference")))
    long = profiles.where("short = 0").select(*keys, group.alias("lang"), stats).select(*keys, "lang", "s.stat", "s.value")
    each = [F.max(F.when(F.col("stat") == s, F.col("surprise"))).alias(f"t_{s}") for s in used]
    scores = long.join(broadcast_if_small(tails, BROADCAST_ROWS), ["lang", "stat", "value"]).groupBy(*keys).agg(F.max("reference").alias("reference"), *each)
    joined = profiles.join(scores, keys, "left")
    told = F.col("reference") >= LEAST_RANKED
    sums = F.array(*[F.when(F.col(a) >= least, F.when(told, F.col(f"t_{a}") + F.col(f"t_{b}")).when((F.lit(b) != "common_word_share") | (F.col("common_word_share") < RARELY), F.lit(0.0))) for _, (a, _), (b, _), least in SIGNATURES])
    most = F.coalesce(F.array_max(sums), F.lit(0.0))
    highest = 2 * F.log(F.least(F.col("reference"), F.lit(TAIL_FLOOR)) + 1)
    outlier = F.array_max(sums).isNotNull() & (~told | (most >= part * highest))
    kinds = F.array(*[F.lit(k) for k, *_ in SIGNATURES])
    kind = F.when(outlier, F.get(kinds, (F.array_position(sums, most) - 1).cast("int"))).otherwise(F.lit("prose"))
    return joined.withColumn("outlier_score", F.round(most, 6)).withColumn("kind", kind).drop("reference", *[f"t_{s}" for s in used])


def quality(df: DataFrame, part: float = OUTLIER_PART) -> DataFrame:
    """Statistics, outlier_score and kind (prose, list, table or junk) of each text; see profile for the input, score for the rest. Empty input gives no rows."""
    return score(cut(profile(df)), ["src_table", "rec_id"], part)


def not_prose(df: DataFrame, part: float = OUTLIER_PART) -> DataFrame:
    """(src_table, rec_id, kind) of the records that are mostly not prose."""
    return quality(df, part).where("kind <> 'prose'").select("src_table", "rec_id", "kind")
