import json
import random

import pytest
from pyspark.sql import functions as F

from sahifa.operators import dedup, graph, links, responses, wikitext


def test_first_by_keeps_the_first_and_counts(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), (None, 0, "n"), ("b", 2, None)], "k string, ord int, v string")
    assert {tuple(r) for r in dedup.first_by(df, F.col("k"), "ord").select("key", "ord", "v", "copies").collect()} == {("a", 1, "y", 2), ("b", 2, None, 1)}
    assert dedup.first_by(df.limit(0), F.col("k"), "ord").count() == 0


def test_duplicate_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert dedup.duplicate_counts(df, F.col("k")).first().asDict() == {"loaded": 3, "kept": 2, "duplicates": 1}
    assert dedup.duplicate_counts(df.limit(0), F.col("k")).first().asDict() == {"loaded": 0, "kept": 0, "duplicates": 0}


def test_batches_number_all_rows(spark):
    df = spark.range(1005).select((1000 - F.col("id")).alias("id"))
    got = [(r.id, r.position, r.batch) for r in dedup.batches(df, ["id"], 40).orderBy("id").collect()]
    assert got == [(v, i, i // 40) for i, v in enumerate(sorted(1000 - x for x in range(1005)))]


def test_seeded_sample_is_a_set_of_the_first(spark):
    df = spark.range(50).select(F.col("id").alias("ord"))
    a, b = dedup.seeded_sample(df, "ord", "ord", 10, 1), dedup.seeded_sample(df, "ord", "ord", 10, 2)
    assert {r.ord for r in a.collect()} == set(range(10)) == {r.ord for r in b.collect()}
    assert [r.ord for r in a.orderBy("shuffle_key").collect()] != [r.ord for r in b.orderBy("shuffle_key").collect()]
    keys = [r.shuffle_key for r in a.collect()]
    assert keys == sorted(keys)


def test_walk_against_brute_force(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}", i) for i in range(90)]
    df = spark.createDataFrame([*edges, (None, "n1", 0), ("n1", None, 0)], "parent string, child string, ord int")
    roots = spark.createDataFrame([("n0",), ("n0",)], "node string")
    for limit in (0, 2, None):
        depth = {"n0": 0}
        todo = ["n0"]
        while todo and (limit is None or depth[todo[0]] < limit):
            new = []
            for p in todo:
                for a, b, _ in edges:
                    if a == p and b not in depth:
                        depth[b] = depth[p] + 1
                        new.append(b)
            todo = new
        rows = graph.walk(df, roots, limit).collect()
        assert {r.node: r.depth for r in rows} == depth
        assert len(rows) == len(depth)
        assert all(len(r.parents) == r.depth and (not r.parents or r.parents[0] == "n0") for r in rows)


GOLDEN = {
    "'''Bold''' and ''it'' [[A|b]] <ref>z</ref>": "**Bold** and *it* b \n\n",
    'x <ref name="r"/> keep <ref>y</ref> z': "x  z\n\n",
    "[[File:a.jpg|thumb|cap]]": "",
    "'''''both'''''": "***both***\n\n",
    "<references />": "",
    "it''s ''x''": "it*s *x''\n\n",
    "== H ==": "\n## H\n\n",
    "==== H ====": "\n### H\n\n",
    "====": "\n### \n\n",
    "==[[A|b]]==": "\n## b\n\n",
    "* a\np": "- a\n\np\n\n",
    "* a\n\np": "- a\n\np\n\n",
    "* a\n== H ==\np": "- a\n\n## H\n\np\n\n",
    "** x": "- * x\n",
    "#REDIRECT [[X]]": "1. REDIRECT X\n",
    "{{box\n|k=v\n}}": "}}\n\n",
    "": "",
}


def test_markdown(spark):
    texts = list(GOLDEN)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", wikitext.to_markdown(F.col("t")).alias("m")).orderBy("i").collect()
    assert {texts[r.i]: r.m for r in rows} == GOLDEN
    assert spark.sql("select cast(null as string) t").select(wikitext.to_markdown(F.col("t"))).first()[0] is None


def test_infobox_and_plain_text(spark):
    t = "{{Infobox x|name = '''A'''|born={{date|1|2}} 1900|link=[[B|c]]}} [[D|d]] ''e''<ref>f</ref>\n{{other|a=b}} {{infobox y|name=Z|raw}}"
    df = spark.createDataFrame([(1, t), (2, None), (3, "{{broken"), (4, "")], "id int, wikitext string")
    got = {r.id: (r.infobox, r.plain) for r in wikitext.parse_pages(df, ["id"]).collect()}
    assert got[1][0] == {"name": "Z", "born": "1900", "link": "c", "1": "raw"}
    assert got[1][1].strip() == "d e"
    assert got[2] == (None, None) and got[3][0] == {} and got[4] == ({}, "")


def test_page_links(spark):
    html = '<h1 class="firstHeading">تصنيف: X</h1><div id="mw-subcategories"><a href="/wiki/تصنيف:s">s</a></div><div id="mw-pages"><p>open<a href="/wiki/a"><b>a</b> &amp; b</a><a>none</a><a href="/wiki/User:u">u</a></div><a href="/wiki/z">z</a>'
    df = spark.createDataFrame([(1, "https://h/wiki/تصنيف:X", html), (2, "https://h/wiki/x", html), (3, "https://h/wiki/تصنيف:Y", None)], "id int, url string, html string")
    got = {tuple(r) for r in links.category_links(df, "id", "url").collect()}
    assert got == {(1, "X", "subcategory", 0, "https://h/wiki/تصنيف:s", "s"), (1, "X", "article", 1, "https://h/wiki/a", "a & b")}


def test_links_of_two_kinds(spark):
    html = '<h1 class="firstHeading">X</h1><div id="mw-pages"><a href="/wiki/A?pagefrom=b">n</a></div><div class="mw-category-group"><a href="/wiki/Category:B">B</a><a href="/wiki/Talk:C"> C</a><a href="http://o/">o</a></div>'
    df = spark.createDataFrame([(1, "https://h/wiki/Category:X", html, "X")], "id int, url string, html string, of string")
    assert [(r.kind, r.url) for r in links.category_links(df, "id", "url").collect()] == [("article", "https://h/wiki/A?pagefrom=b"), ("paging", "https://h/wiki/A?pagefrom=b")]
    assert [tuple(r)[1:] for r in links.group_links(df, "id", "url", "of").collect()] == [("category", 1, "B", "https://h/wiki/Category:B", None), ("figure", 2, "C", "https://h/wiki/Talk:C", "X")]


def test_files_that_are_missing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "ord int, title string")
    done = spark.createDataFrame([("a.md",), ("a.md",)], "filename string")
    name = F.concat("title", F.lit(".md"))
    assert [r.ord for r in dedup.not_written(df, name, done).collect()] == [2]
    assert dedup.not_written(df, name, done, force=True).count() == 2


def test_repair():
    assert json.loads(responses.repair('x {"a": [1, 2,], "b": "c')) == {"a": [1, 2], "b": "c"}
    assert json.loads(responses.repair('{"a": "x\ny"} tail')) == {"a": "x\ny"}
    assert responses.repair(None) is None and responses.repair("none") is None


def test_unfence_and_prompt(spark):
    df = spark.createDataFrame([("```json\n{}\n```",), (" x ",), (None,)], "raw string")
    assert [r[0] for r in df.select(responses.unfence(F.col("raw"))).collect()] == ["{}", "x", None]
    out = spark.range(1).select(responses.prompt("a {x} {y} {z}", x=F.lit(1).cast("string"), z=F.lit("2"))).first()[0]
    assert out == "a 1 {y} 2"


def words(n):
    return " ".join(["w"] * n)


@pytest.mark.parametrize(
    ("response", "status", "pairs"),
    [
        ({"skip": True, "skip_reason": "r"}, "skipped", None), ({"skip": "false"}, "skipped", None), ([1], "rejected", None), ({"title": "t"}, "rejected", None),
        *[({"skip": False, "title": "t", "article": words(n), "qa_pairs": [{"question": "q", "answer": "a"}] * 2}, "kept" if 50 <= n <= 2000 else "rejected", 2 if 50 <= n <= 2000 else None) for n in (49, 50, 2000, 2001)],
        ({"skip": False, "title": "t", "article": words(60), "qa_pairs": [{"question": "q", "answer": "a"}, {"question": "q", "answer": " "}]}, "kept", 1),
        ({"skip": False, "title": "t", "article": words(60), "qa_pairs": [{"question": "q", "answer": words(100)}, {"question": "q", "answer": words(101)}]}, "kept", 1),
        ({"skip": 0, "title": "t", "article": words(60), "qa_pairs": [{"question": "q", "answer": "a"}] * 3}, "rejected", None),
        ({"skip": False, "title": "t", "article": words(60), "qa_pairs": "x"}, "rejected", None),
        ({"skip": False, "title": "t", "qa_pairs": []}, "rejected", None),
    ],
)
def test_validate(spark, response, status, pairs):
    r = responses.validate(spark.createDataFrame([("n", json.dumps(response))], "name string, raw string")).first()
    assert (r.status, None if r.qa_pairs is None else len(r.qa_pairs)) == (status, pairs)


def test_validate_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("n", None), ("m", "")], "name string, raw string")
    assert {r.status for r in responses.validate(responses.repaired(df, "raw")).collect()} == {"rejected"}
    assert responses.validate(df.limit(0)).count() == 0


def test_figure_records(spark):
    page = ("n", "u", None, "t", "{{Infobox x|a=1}}First line.\n\nSecond.\n=x\nThird.\nFourth.\n== H ==\nFifth.")
    r = wikitext.figure_records(spark.createDataFrame([page], "name string, url string, category string, title string, wikitext string")).first()
    assert (r.summary, r.infobox, r.category) == ("First line. Second. Third.", {"a": "1"}, None)


def test_batch_flags(spark):
    items = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "d"), (2, "e")], "batch int, name string")
    answers = spark.createDataFrame([(0, ["a"], ["b", "a"], None), (1, None, None, True)], "batch int, related array<string>, unrelated array<string>, failed boolean")
    assert {r.name: r.flag for r in responses.batch_flags(items, answers).collect()} == {"a": True, "b": False, "c": None, "d": True, "e": True}
    assert {r.name: r.flag for r in responses.batch_flags(items, answers, fail_open=False).collect()}["d"] is None
