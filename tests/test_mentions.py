"""Names held as data, log search, frequent values with proof, daily bitmaps and wide workbook rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tabwright.functions import mentions, names
from tabwright.operators import activity, columns as C, hitters
from tabwright.plans.documents import workbook_bytes
from tabwright.sources import store as S
from tabwright.sources.workbook import read_workbooks


def one_by_one(files, existing):
    """Table names for (order, file), each after the other."""
    taken, out = list(existing), {}
    for order, file in sorted(files):
        out[order] = names.table_name(file, taken)
        taken.append(out[order])
    return out


def free(spark, files, existing):
    df = spark.createDataFrame(files, "i int, file string")
    there = spark.createDataFrame([(x,) for x in existing], "table_name string")
    return {r["i"]: r["table_name"] for r in names.free_table_names(df, "file", there, ["i"]).collect()}


def test_table_names_equal_giving_them_one_by_one(spark):
    rng = random.Random(2)
    stems = ["Sales Data.csv", "sales-data.json", "2020.csv", "???.csv", "a.csv", "b"]
    files = [(i, rng.choice(stems)) for i in range(60)]
    existing = ["sales_data", "tbl_2020__raw", "a_2", "a_3__raw", "a_7", "other"]
    assert free(spark, files, existing) == one_by_one(files, existing)


def test_names_that_look_like_suffixed_ones(spark):
    files = [(1, "a.csv"), (2, "a.csv"), (3, "a_2.csv"), (4, "a.csv"), (5, "a_2.csv")]
    got = free(spark, files, [])
    assert len(set(got.values())) == 5 and got[1] == "a" and got[3] == "a_2" and got[5] == "a_2_2"
    assert sorted(got[i] for i in (2, 4)) == ["a_3", "a_4"]
    assert free(spark, [], ["a"]) == {}


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_name_similarity_is_that_of_common_subsequences(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choice("abcé_") for _ in range(rng.randrange(9))), "".join(rng.choice("abcé_") for _ in range(rng.randrange(9)))) for _ in range(80)]
    df = spark.createDataFrame([*pairs, ("orders", "order_s"), ("", ""), ("a", "")], "a string, b string")
    for r in df.select("a", "b", names.similarity(F.col("a"), F.col("b")).alias("s")).collect():
        size = len(r["a"]) + len(r["b"])
        assert r["s"] == pytest.approx(200 * common(r["a"], r["b"]) / size if size else 100)


def test_log_search_by_many_entities(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeü ") for _ in range(n))
    questions = [word(rng.randrange(1, 40)) for _ in range(400)] + ["x", "ab", None, ""]
    entities = [word(rng.randrange(1, 7)) for _ in range(10_000)] + ["x", "ab", "zzz", None, "", "100%"]
    for some in (entities[9_000:9_040] + entities[-6:], [e for e in entities if e and len(e) > 4]):
        log = spark.createDataFrame([(q,) for q in questions], "question string")
        asked = spark.createDataFrame([(e,) for e in some], "entity string")
        got = sorted(r[0] for r in S.query_log_search(log, asked).collect())
        assert got == sorted({q for q in questions if q and any(e and e in q for e in some)})
    assert S.query_log_search(log, asked.limit(0)).count() == 0


def test_log_search_pairs_no_question_with_an_entity_it_does_not_hold(spark):
    """Every question holds every three letters of every entity, and none holds one of them but those it equals."""
    rng = random.Random(11)
    every = ["".join(p) for p in itertools.product("abc", repeat=5)]
    questions = ["-".join(rng.sample(every, len(every))) for _ in range(60)]
    entities = [f"{a}{b}" for a in every[:40] for b in every[40:60]] + [questions[7][100:180], questions[9]]
    log, asked = (spark.createDataFrame([(x,) for x in some], f"{c} string") for some, c in ((questions, "question"), (entities, "entity")))
    found = S.query_log_search(log, asked)
    assert sorted(r[0] for r in found.collect()) == sorted([questions[7], questions[9]])
    words = spark.createDataFrame([(e,) for e in entities], "entity string")
    cut = mentions.pieces(mentions.entity_filter(words), sorted({len(e) for e in entities}))
    numbered = spark.createDataFrame(list(enumerate(questions)), "id long, question string")
    assert numbered.mapInArrow(cut, "id long, piece string").count() < 60 * 30


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 4 + ["warm"] * 2 + [f"v{i}" for i in range(30)]), i, rng.choice([1.5, 2.5, 1.5]), "long " * 30 + str(i % 3), None) for i in range(4000)]
    return spark.createDataFrame(rows, "label string, id long, x double, text string, none string")


def test_leaders_are_proven_and_the_rest_is_counted(skewed):
    columns = ["label", "id", "x", "text", "none"]
    got, full = hitters.top_values(skewed, columns, 2)
    assert set(full) == {"id"}
    want = C.top_values(C.value_counts(skewed, columns), 2).select(*hitters._COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ties_at_the_end_are_counted_in_full(spark):
    flat = spark.range(40_000).selectExpr("CAST(id % 20000 AS STRING) AS v", "IF(id < 30000, 'a', CAST(id % 4 AS STRING)) AS w")
    got, full = hitters.top_values(flat, ["v", "w"], 3)
    assert full == ["v"]
    want = C.top_values(C.value_counts(flat, ["v", "w"]), 3).select(*hitters._COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.fixture(scope="module")
def visits(spark):
    rng = random.Random(9)
    rows = [(f"u{rng.randrange(200)}", f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}") for _ in range(900)]
    rows += [(None, "2024-01-01"), ("u1", None), ("only", "2024-12-31")]
    return spark.createDataFrame(rows, "who string, day string")


def test_periods_from_daily_bitmaps(visits):
    rows = [r for r in visits.collect() if r["who"] and r["day"]]
    numbers = activity.entity_numbers(visits, "who")
    assert sorted(r["number"] for r in numbers.collect()) == list(range(1, len({r["who"] for r in rows}) + 1))
    days = activity.daily_bitmaps(visits, "who", "day", numbers)
    month = F.substring(F.col("day").cast("string"), 1, 7)
    got = {r["period"]: r["entities"] for r in activity.active_entities(days, month).collect()}
    by_month = {}
    for r in rows:
        by_month.setdefault(r["day"][:7], set()).add(r["who"])
    assert got == {m: len(v) for m, v in by_month.items()}
    following = F.substring(F.add_months(F.col("day"), 1).cast("string"), 1, 7)
    back = {r["period"]: (r["entities"], r["returned"]) for r in activity.returning(days, month, following).collect()}
    after = lambda m: f"2024-{int(m[5:]) + 1:02d}"
    assert back == {m: (len(v), len(v & by_month.get(after(m), set()))) for m, v in by_month.items()}


def test_later_loads_keep_the_numbers(visits):
    first, second = visits.filter("day < '2024-07'"), visits.filter("day >= '2024-07'")
    known = activity.entity_numbers(first, "who")
    numbers = activity.entity_numbers(second, "who", known)
    assert {(r["entity"], r["number"]) for r in known.collect()} <= {(r["entity"], r["number"]) for r in numbers.collect()}
    assert sorted(r["number"] for r in numbers.collect()) == list(range(1, numbers.count() + 1))
    parts = activity.merged_days(activity.daily_bitmaps(first, "who", "day", known), activity.daily_bitmaps(second, "who", "day", numbers))
    all_of_it = activity.active_entities(parts, F.lit("all")).first()["entities"]
    assert all_of_it == visits.filter("day IS NOT NULL").select("who").na.drop().distinct().count()


def test_cells_right_of_the_header_are_kept(spark):
    book = workbook_bytes(["a", "b"], [[1, 2], [3, 4, "z"], [5, 6, 7, 8], [9]])
    files = spark.createDataFrame([("x.xlsx", bytearray(book))], "path string, content binary")
    df = read_workbooks(files)
    assert df.columns == ["a", "b", "Unnamed: 2", "Unnamed: 3"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("1", "2", None, None), ("3", "4", "z", None), ("5", "6", "7", "8"), ("9", None, None, None)], key=str)


def test_no_whole_texts_as_keys_of_duplicate_rows(spark):
    plan = C.duplicate_rows(spark.createDataFrame([("t", 1)], "text string, n int"))._jdf.queryExecution().executedPlan().toString()
    assert "md5(" in plan
