import datetime

import pandas as pd
import pytest

from tabwright.operators import clean, columns as C, quality


@pytest.fixture
def people(spark):
    rows = [
        (" Alice  ", "  30  ", "$50,000", " note 1 ", "2023-01-15 ", "yes "),
        (" Bob    ", "  25  ", "$65,000", "        ", "2022-05-10 ", "no  "),
        (" Charlie", "      ", "$70,000", None, "2021-11-01 ", "true "),
        (" Alice  ", "  30  ", "$50,000", " note 1 ", "2023-01-15 ", "yes "),
        (" ", None, " ", " ", None, " "),
        (" David  ", "  40  ", "$90,000", None, "2020-03-20 ", "false"),
        (" Eva    ", "  35  ", "$80,000", None, "2024-02-01 ", "1 "),
    ]
    return spark.createDataFrame(rows, "name string, AGE string, salary string, notes string, joined_date string, is_active string")


def test_messy_people(people):
    cleaned = clean.clean_table(people)
    assert dict(cleaned.df.dtypes) == {
        "name": "string", "age": "double", "salary": "double", "notes": "string",
        "joined_date": "timestamp_ntz", "is_active": "boolean",
    }
    rows = {r["name"]: r for r in cleaned.df.collect()}
    assert set(rows) == {"Alice", "Bob", "Charlie", "David", "Eva"}
    assert rows["Alice"]["salary"] == 50000 and rows["Alice"]["is_active"] is True
    assert rows["Alice"]["joined_date"] == datetime.datetime(2023, 1, 15)
    assert rows["Charlie"]["age"] is None
    report = cleaned.report("people").first()
    assert (report["rows_before"], report["rows_after"], report["duplicates_removed"]) == (7, 5, 1)
    assert report["columns_renamed"] == {"AGE": "age"}
    assert 0 <= report["raw_score"] < report["clean_score"] <= 100
    assert report["nulls_per_column_after"]["age"] == 1


def test_cleaning_again_changes_nothing(people):
    once = clean.clean_table(people.drop("notes")).df
    again = clean.clean_table(once)
    assert not again.dropped_columns and again.df.schema == once.schema
    assert again.df.exceptAll(once).count() == 0 and again.df.count() == once.count()


def test_staged_rows_give_the_same_result(spark, people, tmp_path):
    def stage(df):
        df.write.parquet(str(tmp_path / "stage"))
        return spark.read.parquet(str(tmp_path / "stage"))

    staged, lazy = clean.clean_table(people, stage=stage).df, clean.clean_table(people).df
    assert staged.schema == lazy.schema and staged.exceptAll(lazy).count() == 0


def test_columns_filled_by_half_are_kept(spark):
    rows = [(i, f"val_{i}" if i < 12 else None, f"rare_{i}" if i < 2 else None, i if i < 10 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, mostly_present string, mostly_empty string, half int")
    cleaned = clean.clean_table(df)
    assert cleaned.df.columns == ["id", "mostly_present", "half"]
    assert cleaned.dropped_columns == ["mostly_empty"]


@pytest.mark.parametrize("empty, kept, warned", [(4, 10, True), (2, 8, False), (0, 10, False)])
def test_row_rail(spark, empty, kept, warned):
    rows = [("val", i) for i in range(10 - empty)] + [(None, None)] * empty
    df, notes = clean.drop_empty_rows_guarded(spark.createDataFrame(rows, "col1 string, col2 int"))
    assert df.count() == kept and bool(notes) == warned
    assert not notes or "4/10 rows (40%)" in notes[0]


def test_minimal_steps(spark):
    df = spark.createDataFrame(
        [(" Alice ", 25.0, None), ("Bob ", 30.0, None), ("Charlie", 35.0, None), ("  ", None, None)],
        "`  First Name  ` string, ` Age ` double, EmptyCol string",
    )
    named = clean.trim_strings(clean.clean_names(df))
    rows = clean.drop_empty_rows(clean.drop_empty_columns(named)).collect()
    assert [r.asDict() for r in rows] == [
        {"first_name": "Alice", "age": 25.0}, {"first_name": "Bob", "age": 30.0}, {"first_name": "Charlie", "age": 35.0},
    ]


def test_colliding_and_odd_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`a b` int, `A-B` int, `a_b_2` int, `9 lives` int")
    assert clean.clean_names(df).columns == ["a_b", "a_b_2", "a_b_2_2", "col_9_lives"]


@pytest.fixture
def messy_sales(spark):
    rows = [
        (1, "2023-01-15 ", "$50,000", "completed ", "active"),
        (2, "2023-01-16 ", "$60,000", "pending   ", "active"),
        (3, "invalid_date", "$70,000", None, "active"),
        (1, "2023-01-15 ", "$50,000", "completed ", "active"),
        (5, None, None, "completed ", "active"),
    ]
    return spark.createDataFrame(rows, "id int, order_date string, amount string, status string, constant_col string")


def test_quality_before_and_after(messy_sales):
    cleaned = clean.clean_table(messy_sales)
    raw, after = quality.quality_score(messy_sales).first(), quality.quality_score(cleaned.df).first()
    # 22 of 25 cells, 1 of 5 rows repeated, 1 of 4 dates bad, 1 of 5 columns text numbers, 1 constant.
    assert raw["score"] == round(25 * 22 / 25 + 20 * 4 / 5 + 15 * 3 / 4 + 15 * 4 / 5 + 15 * 4 / 5 + 10)
    assert after["score"] > raw["score"] and after["duplicate_rows"] == 0


def test_issues_of_messy_sales(messy_sales):
    found = {(r["attribute"], r["description"]) for r in quality.quality_issues(messy_sales).collect()}
    assert found == {
        ("order_date", "Column 'order_date' has 20.0% missing values."),
        ("amount", "Column 'amount' has 20.0% missing values."),
        ("status", "Column 'status' has 20.0% missing values."),
        ("order_date", "Column 'order_date' contains 1 date value(s) that failed date parsing."),
        ("amount", "Column 'amount' contains numeric values stored as text/string."),
        ("constant_col", "Column 'constant_col' contains a single constant value."),
        (None, "Found 1 duplicate row(s) (20.0% of dataset)."),
    }


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert quality.quality_score(df).first()["score"] == 0
    assert [r["description"] for r in quality.quality_issues(df).collect()] == ["Dataset is completely empty."]


def test_negative_amounts(spark):
    df = spark.createDataFrame([(1, "-5", -1), (2, "6", 3)], "k int, `Unit Price` string, balance int")
    found = {r["attribute"]: r["severity"] for r in quality.quality_issues(df).filter("description like '%negative%'").collect()}
    assert found == {"Unit Price": "high", "balance": "high"}


DATES = ["2024-02-29", "2024-02-30", "1/2/2023", "13/02/2023", "05-10-2022", "25-12-1998", "2021/3/4", " 2020-01-01 ",
         "2020-01-01T10:20:30", "2020-01-01 10:20", "30", "2019", "yes", "", "99/99/2020",
         "2024-01-05T10:00:00Z", "2024-01-05T10:00:00+02:00", "2024-01-05 10:00:00.25-0530", "Jan 5, 2024", "5 January 2024",
         "5-Jan-2024", "20240105", "20241305", "01/05/24", "01/05/2024 10:30", "01/05/2024 10:00:00 AM",
         "1/5/2024 12:15 AM", "1/5/2024 12:15 PM", "01/05/2024 3:15 pm", "Fri, 05 Jan 2024 10:00:00", "Mayor 5, 2024", "hello"]


def test_dates_read_as_the_frame_library_reads_them(spark):
    from tabwright.functions import parse

    df = spark.createDataFrame([(d,) for d in DATES], "d string").selectExpr("d", f"{parse.read_date('d')} AS read")
    for d, read in df.collect():
        expected = pd.to_datetime(pd.Series([d.strip()]), format="mixed", errors="coerce")[0]
        if d in ("2019", "30"):  # bare numbers stay numbers
            expected = pd.NaT
        if not pd.isna(expected) and expected.tzinfo:  # zones are resolved to UTC
            expected = expected.tz_convert("UTC").tz_localize(None)
        assert (read is None and pd.isna(expected)) or read == expected.to_pydatetime(), d


def test_two_digit_years_have_a_fixed_turn(spark):
    from tabwright.functions import parse

    df = spark.createDataFrame([("13/05/69",), ("05/13/68",)], "d string")
    assert [str(r[0])[:10] for r in df.selectExpr(parse.read_date("d")).collect()] == ["1969-05-13", "2068-05-13"]


def test_currency_and_booleans(spark):
    from tabwright.functions import parse

    texts = ["$50,000", "€ 1,234.50", "12", "1.2.3", "abc", "", " £7 ", "NaN", "-3", "1e3", "12 USD"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = {x: (n, c) for x, n, c in df.selectExpr("x", parse.read_currency("x"), parse.is_currency("x")).collect()}
    assert got == {
        "$50,000": (50000.0, True), "€ 1,234.50": (1234.5, True), "12": (12.0, True), "1.2.3": (None, False),
        "abc": (None, False), "": (None, False), " £7 ": (7.0, True), "NaN": (None, False), "-3": (-3.0, False),
        "1e3": (1000.0, False), "12 USD": (None, False),
    }
    words = spark.createDataFrame([(w,) for w in [" Yes", "N ", "T", "0", "maybe", None]], "w string")
    assert [r[0] for r in words.selectExpr(parse.read_bool("w")).collect()] == [True, False, True, False, None, None]


def test_strip_removes_what_python_strips(spark):
    from tabwright.functions import parse

    texts = ["  a b 　", "\t\r\n x", "  ", "plain", "\x1cq\x1f", " é "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.selectExpr(parse.strip("t")).collect()] == [t.strip() for t in texts]


def test_texts_are_judged_once_for_each_different_value(spark):
    long = "1," + "0" * 80
    rows = [("yes", "2024-01-05"), ("yes", "2024-01-05"), (None, "5 Jan 2024"), ("no", long), ("no", long), ("1,000", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    seen = {r["attribute"]: r for r in C.text_evidence(df, ["a", "b"], {"letters": lambda x: f"length({x})"}).collect()}
    assert (seen["a"]["filled"], seen["a"]["distinct_count"], seen["a"]["letters"]) == (5, 3, 3 + 3 + 2 + 2 + 5)
    assert (seen["b"]["filled"], seen["b"]["distinct_count"], seen["b"]["letters"]) == (5, 3, 10 + 10 + 10 + 82 + 82)
    evidence = {r["attribute"]: r for r in clean.type_evidence(df).collect()}
    assert [evidence["a"][k] for k in ("filled", "booleans", "dates", "currency")] == [5, 4, 0, 1]
    assert [evidence["b"][k] for k in ("filled", "booleans", "dates", "currency")] == [5, 0, 3, 2]


def test_evidence_of_texts_is_one_expression_for_any_number_of_columns(spark):
    plan = lambda n: clean.type_evidence(spark.createDataFrame([("x",) * n], [f"c{i}" for i in range(n)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(40).count("RLIKE") == plan(2).count("RLIKE") > 0
