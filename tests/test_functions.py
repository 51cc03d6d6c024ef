import random
from urllib.parse import unquote, urljoin, urlparse

from pyspark.sql import functions as F

from sahifa.functions import text, urls


def column(spark, items, f):
    rows = spark.createDataFrame(list(enumerate(items)), "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_normalize_arabic(spark):
    cases = {"أَنْ": "أن", "على": "علي", "a   b\n \n\n\nc": "a b\n\nc", "a ‌ b": "a  b", "x—y…": "x-y...", "ٰa": "ٰa", "a\n  b": "a\n b", "  ": "", "": "", None: None}
    assert column(spark, cases, text.normalize_arabic) == list(cases.values())


def test_normalize_is_idempotent(spark):
    rnd = random.Random(3)
    items = ["".join(rnd.choice("ab \n\tىيَـ ") for _ in range(30)) for _ in range(200)]
    once = column(spark, items, text.normalize_arabic)
    assert column(spark, once, text.normalize_arabic) == once


def test_trim_and_words(spark):
    items = [" a b  ", "　", "", None, "x\x1cy", "a " * 50_000]
    assert column(spark, items, text.trim) == [None if x is None else x.strip() for x in items]
    assert column(spark, items, text.word_count) == [-1 if x is None else len(x.split()) for x in items] or column(spark, items, text.word_count) == [None if x is None else len(x.split()) for x in items]


def test_percent_decode(spark):
    items = ["a+b%20c%zz", "%D8%A7", "%", "%e9x", "", None]
    assert column(spark, items, text.percent_decode) == [None if x is None else unquote(x) for x in items]


def test_url_normal_form(spark):
    items = ["https://h/a b?x#f", "HTTPS://H/w/index.php?title=X&pagefrom=Y", "https://h/a;p", "https://h/", "http://u@h:80/x//", "https://h/a;b/c;d", "https://h", "https://h/%D8%A7_%D8%A8/"]

    def expected(u):
        p = urlparse(u)
        return f"{p.scheme}://{p.netloc}{unquote(p.path).rstrip('/')}"

    assert column(spark, items, urls.normalize) == [expected(u) for u in items]
    assert column(spark, [None], urls.normalize) == [None]


def test_titles_and_names(spark):
    assert column(spark, ["https://h/wiki/a/wiki/b", "https://h/x"], urls.title_from_path) == ["a/wiki/b", None]
    assert column(spark, ["https://h/wiki/a/wiki/b"], urls.title_from_link) == ["b"]
    assert column(spark, ["%D8%A7_x"], urls.display_title) == ["ا x"]
    assert column(spark, ['a/b:c?"d"\\e|f', "x" * 300], urls.file_name) == ["a_b_c__d__e_f.md", "x" * 100 + ".md"]


def test_links(spark):
    hrefs = ["/wiki/تصنيف:س", "/wiki/س", "/wiki/File:x", "/w/i?pagefrom=a", "/wiki/%D8%AA%D8%B5%D9%86%D9%8A%D9%81:s", None, "/wiki/Category:A"]
    assert column(spark, hrefs, urls.is_subcategory_link) == [True, False, False, False, True, None, False]
    assert column(spark, hrefs, urls.is_article_link) == [False, True, False, False, False, None, True]
    assert column(spark, hrefs, urls.is_paging_link) == [False, False, False, True, False, None, False]


def test_resolve(spark):
    hrefs = ["/wiki/x", "x", "x/y?z", "?q=1", "#f", "", "//o/p", "https://o/q", "mailto:a@b", "../c", "./d", "../../../e", "/a/./b/../c?x=../y", "f/..", ".", "..", "/g/.."]
    for base in ("https://h/a/b?c#d", "https://h", "https://h/a/"):
        assert column(spark, hrefs, lambda c: urls.resolve(F.lit(base), c)) == [urljoin(base, h) if not (h == "" and "#" in base) else base for h in hrefs]
