"""Problem 8: a mix of sources to target shares of its tokens, by raking and calibrated sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut
from .tokens import name_key

#: Cells (source, language, topic) are aggregates and are raked on the driver; more than this are refused, as are more
#: sources with a target than SOURCE_BOUND.
CELL_BOUND, SOURCE_BOUND = 1_000_000, 100_000
ROUNDS, PRECISION = 200, 1e-9
#: Relative distance from a wanted total within which a marginal counts as reached by the weights.
TOLERANCE = 1e-3


def source_totals(shares: np.ndarray, supply: np.ndarray, total: float) -> np.ndarray:
    """Tokens of each source: its share of the total, or all it can supply; what is missing goes to the others in proportion to their shares."""
    got = np.zeros(len(shares))
    open_ = (shares > 0) & (supply > 0)
    while open_.any():
        rest = total - got[~open_].sum()
        want = rest * shares / shares[open_].sum()
        short = open_ & (want >= supply)
        if not short.any():
            got[open_] = want[open_]
            break
        got[short] = supply[short]
        open_ &= ~short
    return got


def rake(tokens: np.ndarray, caps: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, bool]:
    """Iterative proportional fitting of a weight for each cell, at most its cap; and whether the weights came to rest.

    axes: for each marginal the group of each cell; targets: the tokens wanted of each group. The first axis is fitted
    last in a round and once more at the end, so its targets hold where its cells' caps allow. Marginals that caps make
    impossible stay unmet: compare what the weights give with the targets.
    """
    w = np.ones(len(tokens))

    def fit(axis: int) -> None:
        group, target = axes[axis], targets[axis]
        for _ in range(50):  # cells at their cap leave their share to the others of their group
            now = np.bincount(group, w * tokens, len(target))
            free = np.bincount(group, np.where(w < caps, w * tokens, 0), len(target))
            with np.errstate(divide="ignore", invalid="ignore"):
                down = np.where(now > 0, target / now, 1.0)
                up = np.where(free > 0, (target - now + free) / free, 1.0)
            grows = (target > now)[group]
            new = np.where(grows, np.where(w < caps, np.minimum(w * up[group], caps), w), w * down[group])
            moved = np.abs(new - w).max(initial=0)
            w[:] = new
            if moved < PRECISION:
                break

    rested = False
    for _ in range(ROUNDS):
        before = w.copy()
        for axis in range(len(axes) - 1, -1, -1):
            fit(axis)
            w[:] = np.maximum(w, 1e-12)
        if np.abs(w - before).max(initial=0) < PRECISION:
            rested = True
            break
    fit(0)
    return np.where(tokens > 0, w, np.minimum(1.0, caps)), rested


AXES = ("source", "lang", "topic")


def mix(counts: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """The documents of the mix with how often each is used, and what was wanted of each source, language and topic.

    counts: doc_id, source, lang, category, tokens; targets: source, target_share, max_repeats; other columns are
    ignored. Sources are compared by name_key; documents of a source without a target (or with a null one) and those
    with a null doc_id take no part. A doc_id that occurs again counts once (unique says that none does, which saves a
    shuffle). total is the size of the mix in tokens, by default that of all documents with a target. Weights are raked
    to the targets of the sources and to the language and topic marginals that the documents have; a document is used
    floor(weight) times and once more with the probability of the rest, decided by a hash of its id, so runs agree. No
    document is used more than max_repeats times. Documents used 0 times give no row; neither does an empty table or
    one without targets. More cells than CELL_BOUND raise.

    Returns (doc_id, source, lang, topic, tokens, weight, copies) and the goals (axis, value, target_share,
    wanted_share, planned_share, max_repeats, rested) for reached().
    """
    spark = counts.sparkSession
    wanted = targets.select(name_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    listed = wanted.limit(SOURCE_BOUND + 1).collect()
    if len(listed) > SOURCE_BOUND:
        raise ValueError(f"more than {SOURCE_BOUND} sources")
    goals = {r["source"]: r for r in listed}
    known = spark.createDataFrame([(s,) for s in goals], "source string")
    docs = counts.select("doc_id", name_key(F.col("source")).alias("source"), "lang", F.coalesce(F.col("category"), F.lit("(none)")).alias("topic"), "tokens").where("doc_id is not null")
    docs = docs.join(F.broadcast(known), "source", "left_semi").select("doc_id", *AXES, "tokens")  # at most SOURCE_BOUND rows
    docs = cut(docs if unique else docs.dropDuplicates(["doc_id"]))
    rows = docs.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")).limit(CELL_BOUND + 1).collect()
    if len(rows) > CELL_BOUND:
        raise ValueError(f"more than {CELL_BOUND} cells of source, language and topic")
    weights, report = cell_weights(rows, goals, total)
    table = spark.createDataFrame(weights, "source string, lang string, topic string, weight double, cap int")
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("u")
    joined = docs.join(F.broadcast(table), list(AXES)).withColumn("u", u)  # at most CELL_BOUND rows
    copies = F.least(F.floor("weight") + (F.col("u") < F.col("weight") - F.floor("weight")).cast("int"), F.col("cap")).cast("int")
    mixed = joined.withColumn("copies", copies).where("copies > 0").select("doc_id", *AXES, "tokens", F.round("weight", 6).alias("weight"), "copies")
    return mixed, spark.createDataFrame(report, "axis string, value string, target_share double, wanted_share double, planned_share double, max_repeats int, rested boolean")


def cell_weights(rows: list, goals: dict, total: float | None) -> tuple[list[tuple], list[tuple]]:
    """A weight for each cell (source, lang, topic, tokens) from goals[source] with share and cap; and, for each group
    of an axis, its target, what of it can be had, and what the weights come to."""
    share_sum = sum(g["share"] for g in goals.values())
    absent = [("source", s, float(g["share"]), 0.0, 0.0, int(g["cap"]), True) for s, g in sorted(goals.items()) if s not in {r["source"] for r in rows}]
    if not rows:
        return [], absent
    tokens = np.array([r["tokens"] or 0 for r in rows], dtype=float)
    caps = np.array([goals[r["source"]]["cap"] for r in rows], dtype=float)
    keys = [sorted({r[k] for r in rows}) for k in AXES]
    axes = [np.array([at[r[k]] for r in rows]) for k, at in zip(AXES, ({x: i for i, x in enumerate(ks)} for ks in keys))]
    size = float(total) if total is not None else tokens.sum()
    shares = np.array([goals[s]["share"] for s in keys[0]])
    # sources without documents have no cell; their shares go to the others
    supply = np.bincount(axes[0], tokens * caps, len(keys[0]))
    by_source = source_totals(shares / share_sum, supply, size)
    corpus = tokens.sum()
    held = [np.bincount(a, tokens, len(k)) / max(corpus, 1) for a, k in zip(axes, keys)]
    marginals = [by_source, *(h * by_source.sum() for h in held[1:])]
    w, rested = rake(tokens, caps, axes, marginals)
    whole, planned = max(by_source.sum(), 1e-12), max((w * tokens).sum(), 1e-12)
    report = absent
    for axis, ks, group, h, goal in zip(AXES, keys, axes, held, marginals):
        got = np.bincount(group, w * tokens, len(ks)) / planned
        for i, k in enumerate(ks):
            source = goals[k] if axis == "source" else None
            report.append((axis, k, float(source["share"] if source else h[i]), float(goal[i] / whole), float(got[i]), int(source["cap"]) if source else None, rested))
    return [(r["source"], r["lang"], r["topic"], float(x), int(c)) for r, x, c in zip(rows, w, caps)], report


def reached(mixed: DataFrame, goals: DataFrame) -> DataFrame:
    """One row per source, language and topic (axis, value): its target, and what the mix came to.

    target_share: the share that was asked for, or that the documents have (languages, topics); wanted_share: what is
    left of it where sources are missing or too small; planned_share: what the weights give; residual: how far planned
    is from wanted, relative to it; met: whether that is within TOLERANCE; rested: whether raking came to rest;
    documents, tokens, most_used, reached_share: the mix itself.
    """
    cells = mixed.groupBy(*AXES).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_used"))
    each = cells.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in AXES])).alias("g"), "documents", "tokens", "most_used")
    used = each.groupBy("g.axis", "g.value").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.max("most_used").alias("most_used"))
    whole = used.where("axis = 'source'").agg(F.sum("tokens").alias("whole"))
    out = goals.join(used, ["axis", "value"], "left").crossJoin(F.broadcast(whole))  # one row
    residual = F.round(F.coalesce(F.try_divide(F.col("planned_share"), F.col("wanted_share")) - 1, F.lit(0.0)), 6)
    return out.select(
        "axis", "value", *[F.round(c, 6).alias(c) for c in ("target_share", "wanted_share", "planned_share")], residual.alias("residual"), (F.abs(residual) <= TOLERANCE).alias("met"), "rested", "max_repeats",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("documents", "tokens", "most_used")], F.round(F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0)), 6).alias("reached_share"),
    )
