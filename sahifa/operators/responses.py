"""Model responses: prompts, parsing, validation and output records. Responses come as a table, never from a network."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import json_string, trim, word_count

#: The accepted lengths in words, and the pairs a response must have.
ARTICLE_WORDS, ANSWER_WORDS, PAIRS = (50, 2000), (1, 100), 2
#: The reasons that are counted even where they do not occur.
SKIP_REASONS = ["not_a_person", "insufficient_data", "not_egypt_related", "unknown"]
RESPONSE = "struct<skip:variant,skip_reason:string,title:string,article:string,qa_pairs:array<struct<question:string,answer:string>>>"


def pretty_json(m: Column) -> Column:
    """A string map as JSON indented by two, entries in their order; {} for an empty one."""
    entry = F.transform(F.map_entries(m), lambda e: F.concat(F.lit("  "), json_string(e["key"]), F.lit(": "), F.when(e["value"].isNull(), F.lit("null")).otherwise(json_string(e["value"]))))
    return F.when(F.size(m) == 0, F.lit("{}")).otherwise(F.concat(F.lit("{\n"), F.array_join(entry, ",\n"), F.lit("\n}")))


def seed_text(name: Column, category: Column, summary: Column, infobox: Column) -> Column:
    """What a prompt tells of a figure: its name, and category, summary and infobox where they are not empty."""
    def part(c: Column, before: str, text: Column) -> Column:
        return F.when(c, F.concat(F.lit(before), text, F.lit("\n"))).otherwise(F.lit(""))

    return F.concat(
        F.lit("الاسم: "), F.coalesce(name, F.lit("Unknown")), F.lit("\n"),
        part(F.coalesce(category, F.lit("")) != "", "التصنيف: ", F.coalesce(category, F.lit(""))),
        part(F.coalesce(summary, F.lit("")) != "", "\nالملخص:\n", F.coalesce(summary, F.lit(""))),
        part(F.coalesce(F.size(infobox), F.lit(0)) > 0, "\nمعلومات إضافية:\n", F.coalesce(pretty_json(infobox), F.lit(""))),
    )


def prompt(template: str, **parts: Column) -> Column:
    """A template with {name} marks filled from columns; the template's other braces are kept."""
    pieces, last = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.group(1) in parts:
            pieces += [F.lit(template[last : m.start()]), parts[m.group(1)]]
            last = m.end()
    return F.concat(*pieces, F.lit(template[last:]))


def unfence(raw: Column) -> Column:
    """The text inside a code fence, without its language mark; other texts are only trimmed."""
    t = trim(raw)
    return F.when(t.startswith("```"), trim(F.regexp_replace(F.split_part(t, F.lit("```"), F.lit(2)), "^json", ""))).otherwise(t)


def repair(text: str | None) -> str | None:
    """A conservative repair of almost-JSON: text around the outer braces, trailing commas, raw line breaks in strings, missing closers. Null if it still does not parse."""
    if text is None:
        return None
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    out, closers, inside, escaped = [], [], False, False
    for c in text[start:]:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
            elif c in "\n\r\t":
                c = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c]
        elif c == '"':
            inside = True
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
        elif c in "}]":
            if not closers:
                break
            closers.pop()
        out.append(c)
        if c in "}]" and not inside and not closers:
            break
    fixed = "".join(out) + ('"' if inside else "") + "".join(reversed(closers))
    fixed = re.sub(r",(\s*[}\]])", r"\1", fixed)
    try:
        return json.dumps(json.loads(fixed), ensure_ascii=False)
    except ValueError:
        return None


def repaired(df: DataFrame, column: str) -> DataFrame:
    """df with the column repaired where it is not JSON; only those rows go through Python."""
    good = F.try_parse_json(F.col(column)).isNotNull()
    order = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fixed = pa.array([repair(t) for t in b[column].to_pylist()], pa.string())
            yield b.set_column(b.schema.get_field_index(column), column, fixed)

    # null does not parse either and stays null
    return df.where(good).unionByName(df.where(~good).mapInArrow(run, df.schema).select(*order))


def _truthy(v: Column) -> Column:
    """Truth of a JSON value: false, 0, the empty string, array and object, and null are false."""
    return ~F.coalesce(F.to_json(F.struct(v.alias("v"))), F.lit("{}")).isin('{"v":false}', '{"v":0}', '{"v":0.0}', '{"v":""}', '{"v":[]}', '{"v":{}}', '{"v":null}', "{}")


def validate(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with status (kept, skipped or rejected), skip_reason, title, article and qa_pairs, in place of `raw`.

    A response must be an object with a key skip. If that is true it is skipped, with the reason unknown where none is
    given. Else it needs title, article and qa_pairs, two pairs in a list, and an article of an accepted length; pairs
    without question and answer, blank ones and those with answers of another length are dropped, and the record stays.
    """
    j = unfence(F.col(raw))
    d = df.withColumn("__j", j)
    keys = F.when(F.try_parse_json("__j").isNotNull() & F.col("__j").startswith("{"), F.json_object_keys("__j"))
    d = d.withColumn("__keys", keys).withColumn("__v", F.try_parse_json("__j"))

    def has(k: str) -> Column:
        return F.coalesce(F.array_contains("__keys", k), F.lit(False))

    def text(path: str) -> Column:
        return F.try_variant_get("__v", path, "string")

    pairs = F.from_json(F.get_json_object("__j", "$.qa_pairs"), "array<struct<question:string,answer:string>>")
    is_list = F.coalesce(F.schema_of_variant(F.try_variant_get("__v", "$.qa_pairs", "variant")).startswith("ARRAY"), F.lit(False))
    d = d.withColumn("__skip", has("skip") & _truthy(F.try_variant_get("__v", "$.skip", "variant"))).withColumn("__pairs", F.when(is_list, pairs))
    count = word_count(text("$.article"))
    complete = has("title") & has("article") & has("qa_pairs") & (F.coalesce(F.size("__pairs"), F.lit(-1)) == PAIRS) & F.coalesce(count.between(*ARTICLE_WORDS), F.lit(False))
    status = F.when(~has("skip"), "rejected").when(F.col("__skip"), "skipped").when(complete, "kept").otherwise("rejected")
    d = d.withColumn("status", status)
    kept = F.col("status") == "kept"
    good = F.filter("__pairs", lambda p: (trim(p["question"]) != "") & (trim(p["answer"]) != "") & word_count(p["answer"]).between(*ANSWER_WORDS))
    return d.select(
        *[c for c in df.columns if c != raw],
        "status",
        F.when(F.col("status") == "skipped", F.when(has("skip_reason"), text("$.skip_reason")).otherwise("unknown")).alias("skip_reason"),
        F.when(kept, text("$.title")).alias("title"),
        F.when(kept, text("$.article")).alias("article"),
        F.when(kept, good).alias("qa_pairs"),
    )


def output_records(validated: DataFrame) -> DataFrame:
    """The records that are written: skipped ones with a reason, kept ones with their content; rejected ones are left for a rerun."""
    skipped = F.col("status") == "skipped"
    blank = F.lit("")
    return validated.where("status <> 'rejected'").select(
        *[F.coalesce(F.col(c), blank).alias(c) for c in ("name", "url", "category")],
        skipped.alias("skip"),
        "skip_reason",
        *[F.when(~skipped, F.coalesce(F.col(c), blank)).alias(c) for c in ("title", "article")],
        F.when(~skipped, F.col("qa_pairs")).alias("qa_pairs"),
    )


def reason_counts(records: DataFrame, reasons: list[str] = SKIP_REASONS) -> DataFrame:
    """(skip_reason, records): skipped records by reason, with a row for each known reason."""
    spark = records.sparkSession
    counted = records.where("skip").groupBy(F.coalesce("skip_reason", F.lit("unknown")).alias("skip_reason")).agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(r,) for r in reasons], "skip_reason string")
    return known.join(counted, "skip_reason", "full").select("skip_reason", F.coalesce("n", F.lit(0)).alias("records"))


def occurring(counts: DataFrame) -> DataFrame:
    """The reasons that occur."""
    return counts.where("records > 0")


def going_on(flagged: DataFrame) -> DataFrame:
    """The items that were flagged as related."""
    return flagged.where("flag")


def name_flags(items: DataFrame, name: str, related: DataFrame, unrelated: DataFrame) -> DataFrame:
    """items with flag: true if its name is in related, else false if it is in unrelated, else null (not decided)."""
    yes = related.select(F.col(name)).distinct().withColumn("__yes", F.lit(True))
    no = unrelated.select(F.col(name)).distinct().withColumn("__no", F.lit(True))
    joined = items.join(yes, name, "left").join(no, name, "left")
    return joined.withColumn("flag", F.when(F.col("__yes"), True).when(F.col("__no"), False)).drop("__yes", "__no")


def batch_flags(items: DataFrame, answers: DataFrame, name: str = "name", fail_open: bool = True) -> DataFrame:
    """items(batch, name) with flag from answers(batch, related, unrelated, failed), one row per batch at most.

    A name in related is true, one in unrelated false, any other not decided (null). Of a batch that failed or has no
    answer all names are true with fail_open, else not decided.
    """
    joined = items.join(answers.select("batch", "related", "unrelated", F.coalesce("failed", F.lit(False)).alias("__bad"), F.lit(True).alias("__there")), "batch", "left")
    bad = F.col("__there").isNull() | F.col("__bad")
    flag = F.when(bad, F.lit(True if fail_open else None).cast("boolean")).when(F.array_contains("related", F.col(name)), True).when(F.array_contains("unrelated", F.col(name)), False)
    return joined.withColumn("flag", flag).drop("related", "unrelated", "__bad", "__there")
