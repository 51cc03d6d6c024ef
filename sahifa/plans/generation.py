"""Queries over generated records: batches, prompts, responses, output records and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import trim, word_count
from ..operators import dedup, responses
from ..runtime import table
from .pages import _TRIM

BATCH = 40


def q13_classify_batches(spark: SparkSession, d: str) -> DataFrame:
    """Category names in batches of forty, as the list that goes into a prompt."""
    placed = dedup.batches(table(spark, d, "category_links").select("name", "link"), ["name", "link"], BATCH)
    lists = placed.groupBy("batch").agg(F.count(F.lit(1)).alias("items"), F.sort_array(F.collect_list(F.struct("position", "name"))).alias("names"))
    return lists.select(F.col("batch").cast("bigint").alias("batch"), "items", F.concat(F.lit("Names: ['"), F.array_join(F.transform("names", lambda x: x["name"]), "', '"), F.lit("']")).alias("prompt"))


SQL_Q13 = f"""SELECT batch, count(*) AS items, 'Names: [''' || string_agg(name, ''', ''' ORDER BY position) || ''']' AS prompt
 FROM (SELECT name, position, position // {BATCH} AS batch FROM (SELECT name, row_number() OVER (ORDER BY name, link) - 1 AS position FROM category_links)) GROUP BY 1"""


def q13_batch_flags(spark: SparkSession, d: str) -> DataFrame:
    """Categories flagged batch by batch; the second batch failed, which leaves its names in."""
    items = dedup.batches(table(spark, d, "category_links").select("name", "link", "is_egypt_related"), ["name", "link"], BATCH)
    answers = items.groupBy("batch").agg(F.collect_set(F.when(F.col("is_egypt_related"), F.col("name"))).alias("related"), F.collect_set(F.when(~F.col("is_egypt_related"), F.col("name"))).alias("unrelated")).withColumn("failed", F.col("batch") == 1)
    return responses.batch_flags(items.select("batch", "name", "link"), answers).select(F.col("batch").cast("bigint").alias("batch"), "name", "link", "flag")


SQL_Q13_BATCH = f"""WITH i AS (SELECT name, link, is_egypt_related AS e, (row_number() OVER (ORDER BY name, link) - 1) // {BATCH} AS batch FROM category_links)
 SELECT batch, name, link, CASE WHEN batch = 1 THEN true WHEN bool_or(coalesce(e, false)) OVER (PARTITION BY batch, name) THEN true WHEN bool_or(coalesce(NOT e, false)) OVER (PARTITION BY batch, name) THEN false END AS flag FROM i"""


def q13_name_flags(spark: SparkSession, d: str) -> DataFrame:
    """Categories by whether a list of names holds them; names that came back altered stay undecided."""
    c = table(spark, d, "category_links")
    related = c.where("is_egypt_related").select("name")
    unrelated = c.where("not is_egypt_related").select(F.when(F.length("name") % 5 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"))
    return responses.name_flags(c.select("name", "link"), "name", related, unrelated)


SQL_Q13_FLAGS = """SELECT c.name, link, CASE WHEN y.name IS NOT NULL THEN true WHEN n.name IS NOT NULL THEN false END AS flag FROM category_links c
 LEFT JOIN (SELECT DISTINCT name FROM category_links WHERE is_egypt_related) y ON y.name = c.name
 LEFT JOIN (SELECT DISTINCT CASE WHEN len(name) % 5 = 0 THEN upper(name) ELSE name END AS name FROM category_links WHERE NOT is_egypt_related) n ON n.name = c.name"""


def q13_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    f = q13_name_flags(spark, d)
    return f.agg(F.count_if(F.col("flag")).alias("related"), F.count_if(~F.col("flag")).alias("unrelated"), F.count_if(F.col("flag").isNull()).alias("undecided"))


SQL_Q13_COUNTS = f"SELECT count(*) FILTER (WHERE flag) AS related, count(*) FILTER (WHERE NOT flag) AS unrelated, count(*) FILTER (WHERE flag IS NULL) AS undecided FROM ({SQL_Q13_FLAGS})"


def _figures(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "egyptian_figures_data")
    return dedup.first_by(f, F.col("figure_id"), "fetched_at", "figure_id")


def q14_seed_prompt(spark: SparkSession, d: str) -> DataFrame:
    seed = responses.seed_text(F.col("name"), F.col("category"), F.col("summary"), F.col("infobox"))
    text = responses.prompt("Write about {name} {as JSON}.\n\n{seed}", name=F.coalesce("name", F.lit("Unknown")), seed=seed)
    return _figures(spark, d).select("figure_id", text.alias("prompt"))


SQL_Q14 = """WITH f AS (SELECT figure_id, any_value(name) AS name, any_value(category) AS category, any_value(summary) AS summary, any_value(infobox) AS infobox FROM egyptian_figures_data GROUP BY 1),
 j AS (SELECT figure_id, string_agg('  ' || to_json(map_keys(infobox)[i])::VARCHAR || ': ' || coalesce(to_json(map_values(infobox)[i])::VARCHAR, 'null'), ',' || chr(10) ORDER BY i) AS body FROM (SELECT figure_id, infobox, unnest(range(1, cardinality(infobox)::BIGINT + 1)) AS i FROM f WHERE infobox IS NOT NULL) GROUP BY 1)
 SELECT figure_id, 'Write about ' || coalesce(name, 'Unknown') || ' {as JSON}.' || chr(10) || chr(10) || 'الاسم: ' || coalesce(name, 'Unknown') || chr(10)
 || CASE WHEN coalesce(category, '') <> '' THEN 'التصنيف: ' || category || chr(10) ELSE '' END || CASE WHEN coalesce(summary, '') <> '' THEN chr(10) || 'الملخص:' || chr(10) || summary || chr(10) ELSE '' END
 || CASE WHEN body IS NOT NULL THEN chr(10) || 'معلومات إضافية:' || chr(10) || '{' || chr(10) || body || chr(10) || '}' || chr(10) ELSE '' END AS prompt FROM f LEFT JOIN j USING (figure_id)"""

#: Responses that show the edges of the rules: (name, raw text, status, reason).
LITERAL_RESPONSES = [
    ("l1", '{"skip": true, "skip_reason": "not_a_person"}', "skipped", "not_a_person"),
    ("l2", '{"skip":true}', "skipped", "unknown"),
    ("l3", '{"skip":"false"}', "skipped", "unknown"),
    ("l4", "[1]", "rejected", None),
    ("l5", '{"title":"t"}', "rejected", None),
    ("l6", '```json\n{"skip":1,"skip_reason":null}\n```', "skipped", None),
    ("l7", '{"skip":false,"title":"t","article":"a b","qa_pairs":[]}', "rejected", None),
    ("l8", "no JSON at all", "rejected", None),
    ("l9", '{"skip":0,"title":"t","qa_pairs":[{"question":"q","answer":"a"},{"question":"q","answer":"a"}]}', "rejected", None),
    ("l10", 'Here it is: {"skip": true, "skip_reason": "cut off', "skipped", "cut off"),
]


def _records(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "output_dataset").select("rec_id", "name", "url", "category", "skip", "skip_reason", "title", "article", "qa_pairs")
    return dedup.first_by(r, F.col("rec_id"), "rec_id", "rec_id").drop("copies")


def _validated(spark: SparkSession, d: str) -> DataFrame:
    """Records written as responses, in a fence for every other one, and validated."""
    r = _records(spark, d)
    body = F.to_json(F.struct("skip", "skip_reason", "title", "article", "qa_pairs"), {"ignoreNullFields": "true"})
    raw = F.when(F.col("rec_id") % 2 == 0, F.concat(F.lit(" ```json\n"), body, F.lit("\n```\n"))).otherwise(body)
    literal = spark.createDataFrame([(n, x) for n, x, _, _ in LITERAL_RESPONSES], "name string, raw string")
    rows = r.select("name", "url", "category", raw.alias("raw")).unionByName(literal.select("name", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("category"), "raw"))
    return responses.validate(responses.repaired(rows.withColumn("raw", responses.unfence(F.col("raw"))), "raw"))


def _flat(df: DataFrame) -> DataFrame:
    pairs = F.array_join(F.transform("qa_pairs", lambda p: F.concat(p["question"], F.lit(" => "), p["answer"])), " | ")
    return df.withColumn("qa_pairs", pairs)


def q15_response_validate(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_validated(spark, d)).select("name", "url", "status", "skip_reason", "title", "article", "qa_pairs")


_WORDS = "len(list_filter(regexp_split_to_array({0}, '[\\s\\x1c-\\x1f\\x0b\\x{{85}}\\x{{A0}}\\p{{Z}}]+'), lambda w: w <> ''))"
_LITERALS = ", ".join(f"('{n}', '{s}', {'NULL' if r is None else chr(39) + r + chr(39)})" for n, _, s, r in LITERAL_RESPONSES)
SQL_VALIDATED = f"""SELECT rec_id, name, url, category, status, CASE WHEN status = 'skipped' THEN coalesce(skip_reason, 'unknown') END AS skip_reason, CASE WHEN status = 'kept' THEN title END AS title, CASE WHEN status = 'kept' THEN article END AS article,
 CASE WHEN status = 'kept' THEN array_to_string(list_transform(list_filter(qa_pairs, lambda p: {_TRIM.format('p.question')} <> '' AND {_TRIM.format('p.answer')} <> '' AND {_WORDS.format('p.answer')} BETWEEN 1 AND 100), lambda p: p.question || ' => ' || p.answer), ' | ') END AS qa_pairs
 FROM (SELECT *, CASE WHEN skip IS NULL THEN 'rejected' WHEN skip THEN 'skipped' WHEN title IS NOT NULL AND article IS NOT NULL AND coalesce(len(qa_pairs), 0) = 2 AND {_WORDS.format('article')} BETWEEN 50 AND 2000 THEN 'kept' ELSE 'rejected' END AS status
 FROM (SELECT DISTINCT ON (rec_id) rec_id, name, url, category, skip, skip_reason, title, article, qa_pairs FROM output_dataset WHERE rec_id IS NOT NULL))
 UNION ALL SELECT NULL, name, NULL, NULL, status, skip_reason, NULL, NULL, NULL FROM (VALUES {_LITERALS}) t(name, status, skip_reason)"""
SQL_Q15 = f"SELECT name, url, status, skip_reason, title, article, qa_pairs FROM ({SQL_VALIDATED})"


def q16_output_record(spark: SparkSession, d: str) -> DataFrame:
    return _flat(responses.output_records(_validated(spark, d)))


SQL_Q16 = f"""SELECT coalesce(name, '') AS name, coalesce(url, '') AS url, coalesce(category, '') AS category, status = 'skipped' AS skip, skip_reason, title, article, qa_pairs FROM ({SQL_VALIDATED}) WHERE status <> 'rejected'"""


def q17_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    return responses.reason_counts(_records(spark, d))


_REASONS = ", ".join(f"('{r}')" for r in responses.SKIP_REASONS)
SQL_Q17 = f"""WITH c AS (SELECT coalesce(skip_reason, 'unknown') AS skip_reason, count(DISTINCT rec_id) AS n FROM output_dataset WHERE skip GROUP BY 1)
 SELECT coalesce(c.skip_reason, k.skip_reason) AS skip_reason, coalesce(n, 0) AS records FROM (VALUES {_REASONS}) k(skip_reason) FULL JOIN c ON c.skip_reason = k.skip_reason"""


def q17_occurring_reasons(spark: SparkSession, d: str) -> DataFrame:
    return responses.occurring(q17_skip_reasons(spark, d))


SQL_Q17_OCCURRING = "SELECT coalesce(skip_reason, 'unknown') AS skip_reason, count(DISTINCT rec_id) AS records FROM output_dataset WHERE skip AND rec_id IS NOT NULL GROUP BY 1"


def q13_related_categories(spark: SparkSession, d: str) -> DataFrame:
    """The categories that go on after they were flagged."""
    return responses.going_on(q13_name_flags(spark, d)).select("name", "link")


SQL_Q13_RELATED = f"SELECT name, link FROM ({SQL_Q13_FLAGS}) WHERE flag"


def q18_missing_files(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose file is not written: the files of every third one are there."""
    from ..functions import urls

    r = table(spark, d, "article_records").where("title is not null").select("ord", "title")
    written = r.where("ord % 3 = 0").select(urls.file_name(F.col("title")).alias("filename"))
    return dedup.not_written(r, urls.file_name(F.col("title")), written).select("ord", "filename")


_FILE = """substring(regexp_replace(title, '[<>:"/\\\\|?*]', '_', 'g'), 1, 100) || '.md'"""
SQL_Q18_FILES = f"SELECT ord, {_FILE} AS filename FROM article_records WHERE title IS NOT NULL AND {_FILE} NOT IN (SELECT {_FILE} FROM article_records WHERE title IS NOT NULL AND ord % 3 = 0)"


def q18_resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Figures whose name no written record has; skipped ones are done as well."""
    return dedup.not_yet(_figures(spark, d).select("figure_id", F.coalesce("name", F.lit("")).alias("name")), _records(spark, d).select(F.coalesce("name", F.lit("")).alias("name")), ["name"])


SQL_Q18 = "SELECT DISTINCT figure_id, coalesce(name, '') AS name FROM egyptian_figures_data WHERE coalesce(name, '') NOT IN (SELECT coalesce(name, '') FROM output_dataset)"


def q18_new_articles(spark: SparkSession, d: str) -> DataFrame:
    """Crawled pages that the corpus has no text of, once per address."""
    from ..functions import urls

    r = table(spark, d, "article_records").select("ord", "url")
    return dedup.new_first(r, table(spark, d, "train_phase_1").select("url"), urls.normalize(F.col("url")), "ord").select("key", "ord")


def _new_articles_sql() -> str:
    from .pages import _NORMAL

    return f"SELECT key, min(ord) AS ord FROM (SELECT {_NORMAL.format('url')} AS key, ord FROM article_records WHERE url IS NOT NULL) WHERE key NOT IN (SELECT {_NORMAL.format('url')} FROM train_phase_1 WHERE url IS NOT NULL) GROUP BY 1"


def q19_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampling operator: the first hundred records in an order that a seed fixes."""
    return dedup.seeded_sample(table(spark, d, "article_records").select("ord", "url"), "ord", "ord", 100, 7)


SQL_Q19 = "SELECT ord, url, md5(ord || ':7') AS shuffle_key FROM (SELECT ord, url FROM article_records ORDER BY ord LIMIT 100)"


def q20_token_usage(spark: SparkSession, d: str) -> DataFrame:
    """Words of prompts (questions) and completions (answers), and their sum."""
    p = _records(spark, d).select(F.explode("qa_pairs").alias("p"))
    return p.agg(*[F.coalesce(F.sum(word_count(F.coalesce(c, F.lit(""))).cast("bigint")), F.lit(0)).alias(n) for n, c in (("prompt_tokens", F.col("p.question")), ("completion_tokens", F.col("p.answer")))]).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


SQL_Q20 = f"""SELECT sum(q)::BIGINT AS prompt_tokens, sum(a)::BIGINT AS completion_tokens, (sum(q) + sum(a))::BIGINT AS total_tokens FROM (SELECT {_WORDS.format("coalesce(p.question, '')")} AS q, {_WORDS.format("coalesce(p.answer, '')")} AS a FROM (SELECT unnest(qa_pairs) AS p FROM (SELECT DISTINCT ON (rec_id) rec_id, qa_pairs FROM output_dataset)))"""

QUERIES = {f.__name__: f for f in (q13_classify_batches, q13_batch_flags, q13_name_flags, q13_flag_counts, q13_related_categories, q14_seed_prompt, q15_response_validate, q16_output_record, q17_skip_reasons, q17_occurring_reasons, q18_resume_anti_join, q18_missing_files, q18_new_articles, q19_seeded_sample, q20_token_usage)}
SQL = {"q13_classify_batches": SQL_Q13, "q13_batch_flags": SQL_Q13_BATCH, "q13_name_flags": SQL_Q13_FLAGS, "q13_flag_counts": SQL_Q13_COUNTS, "q14_seed_prompt": SQL_Q14, "q15_response_validate": SQL_Q15, "q16_output_record": SQL_Q16, "q17_skip_reasons": SQL_Q17, "q17_occurring_reasons": SQL_Q17_OCCURRING, "q13_related_categories": SQL_Q13_RELATED, "q18_missing_files": SQL_Q18_FILES, "q18_resume_anti_join": SQL_Q18, "q18_new_articles": _new_articles_sql(), "q19_seeded_sample": SQL_Q19, "q20_token_usage": SQL_Q20}
