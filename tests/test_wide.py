import datetime

import pytest
from pyspark.sql import functions as F

from sahifa.operators import wide

FIELDS = [("born", "date", ["birth date", "المولد"]), ("height_cm", "int", ["height"]), ("kids", "int", ["children"]), ("active_from", "int", ["years active"]), ("done", "boolean", ["retired"]), ("place", "string", ["birth place"])]


@pytest.fixture(scope="module")
def fields(spark):
    return spark.createDataFrame(FIELDS, "field string, value_type string, labels array<string>")


def values(spark, f, items, kind):
    df = spark.createDataFrame(list(enumerate(items)), "i int, x string")
    return [r.y for r in df.select("i", wide.typed(wide.known(F.col("x")), f, kind).alias("y")).orderBy("i").collect()]


def test_dates(spark):
    d = datetime.date(1881, 6, 22)
    known = ["1881-06-22", "1881/6/22", "22.06.1881", "22/6/1881", "22 June 1881", "22 Jun. 1881", "22nd of June, 1881", "June 22, 1881", "Jun 22 1881", "1881 June 22", "٢٢ يونيو ١٨٨١", "22 يونيو، 1881م", "(1881-06-22) 22 June 1881", "22 June 1881 Mit Zibik", "born 22 june 1881"]
    unknown = ["1881", "c. 1881", "حوالي 1881", "1880s", "June 1881", "unknown", "", None, "31 February 1881", "22/13/1881"]
    assert values(spark, "born", known, "date") == [d] * len(known)
    assert values(spark, "born", unknown, "date") == [None] * len(unknown)


def test_integers(spark):
    heights = {"1.74 m": 174, "1,74 m": 174, "174cm": 174, "١٧٤ سم": 174, "1.74 m (174 cm)": 174, "174": 174, "5 ft 9 in": 175, "5 feet 9 inches": 175, "6'4\"": 193, "1.89 متر": 189, "tall": None, "N/A": None}
    assert values(spark, "height_cm", heights, "int") == list(heights.values())
    kids = {"3": 3, "5 (2 sons, 3 daughters)": 5, "٤ أبناء": 4, "Seven": 7, "ثلاثة": 3, "?": None, "—": None, "1,234 books": 1234, "٣٬٢٠٠": 3200}
    assert values(spark, "kids", kids, "int") == list(kids.values())
    years = {"1901–1950": 1901, "from 1901 to 1950": 1901, "منذ ١٩٠١": 1901, "1901–50": 1901, "1901-present": 1901, "young": None}
    assert values(spark, "active_from", years, "int") == list(years.values())


def test_booleans_and_strings(spark):
    flags = {"Yes": True, "Y": True, "1": True, "نعم": True, "FALSE": False, "لا": False, "0": False, "TBD": None, "maybe": None}
    assert values(spark, "done", flags, "boolean") == list(flags.values())
    places = {"\n Mit  Zibik,  x ": "Mit Zibik, x", " ": None, "none given": None, "غير معروف": None, "-": None}
    assert values(spark, "place", places, "string") == list(places.values())


def test_widen(spark, fields):
    rows = spark.createDataFrame(
        [(1, "Birth_Date", "1881-06-22"), (1, "birth-date:", "unknown"), (1, "‎children", "2"), (1, "caption", "x"), (1, None, "x"), (1, "height", None), (3, "place", "A"), (3, "PLACE", "A"), (None, "place", "B"), (9, "place", "not an entity")],
        "id bigint, name string, value string",
    )
    entities = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c"), (None, "d")], "id bigint, position string")
    got = {r.id: r for r in wide.widen(entities, rows, fields, "id").collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].born, got[1].kids, got[1].height_cm) == (datetime.date(1881, 6, 22), 2, None)
    assert got[2].place is None and got[3].place == "A"
    cells = wide.cells_of(wide.widen(entities, rows, fields, "id"), "id", [f for f, _, _ in FIELDS])
    assert {tuple(r) for r in cells.collect()} == {(1, "born", "1881-06-22"), (1, "kids", "2"), (3, "place", "A")}


def test_widen_of_nothing(spark, fields):
    rows = spark.createDataFrame([], "id bigint, name string, value string")
    entities = spark.createDataFrame([(1,)], "id bigint")
    assert wide.widen(entities, rows, fields, "id").first().born is None
    assert wide.widen(entities.limit(0), rows, fields, "id").count() == 0
    assert wide.widen(entities, rows, fields.limit(0), "id").columns == ["id"]
    assert wide.cells_of(wide.widen(entities, rows, fields.limit(0), "id"), "id", []).count() == 0


def test_hot_entity_and_long_value(spark, fields):
    rows = spark.range(20_000).select(F.lit(1).cast("bigint").alias("id"), F.lit("children").alias("name"), F.lit("4").alias("value"))
    rows = rows.unionByName(spark.createDataFrame([(1, "place", "x" * 1_000_000)], "id bigint, name string, value string"))
    r = wide.widen(rows.select("id"), rows, fields, "id").collect()
    assert len(r) == 1 and r[0].kids == 4 and len(r[0].place) == 1_000_000
