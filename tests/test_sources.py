import io
import json
import zipfile

import pytest

from tabwright.plans.documents import workbook_bytes
from tabwright.sources import readers, store as S
from tabwright.sources.workbook import sheet_rows


def test_csv_tokens_and_types(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('id,name,score,active,joined,gap\n1,"Ann ""A"", x",1.5,TRUE,2020-01-02,NA\n2,null,,false,NaN,\n\n3,Bob,2,true,2021-05-06')
    df = readers.read_any(spark, str(path))
    assert dict(df.dtypes) == {
        "id": "bigint", "name": "string", "score": "double", "active": "boolean", "joined": "string", "gap": "string",
    }
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 'Ann "A", x', 1.5, True, "2020-01-02", None), (2, None, None, False, None, None),
        (3, "Bob", 2.0, True, "2021-05-06", None),
    ]


def test_json_arrays_and_lines(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "array.json").write_text("\n " + json.dumps(rows, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    for name in ("array", "lines"):
        df = readers.read_any(spark, str(tmp_path / f"{name}.json"))
        assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x"), (2, None)]


def test_folder_of_workbooks(spark, tmp_path):
    (tmp_path / "one.xlsx").write_bytes(workbook_bytes(["id", "name", "score"], [[1, "A & <b>", 2.5], [2, "", 3.0]]))
    (tmp_path / "two.xlsx").write_bytes(workbook_bytes(["name", "id"], [["C", 3]]))
    df = readers.read_any(spark, f"{tmp_path}/*.xlsx")
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "score": "double"}
    assert sorted(tuple(r) for r in df.collect()) == [(1, "A & <b>", 2.5), (2, None, 3.0), (3, "C", None)]


def test_cells_of_every_kind():
    parts = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="B" r:id="rId7"/><sheet name="A" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet9.xml"/>'
        '<Relationship Id="rId7" Target="/xl/worksheets/first.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>day</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" '
        'formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/>'
        '<xf numFmtId="171"/></cellXfs></styleSheet>',
        "xl/worksheets/first.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row r="2"><c r="A2" s="1"><v>45000.5</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="e"><v>#N/A</v></c>'
        '<c r="AA2" s="2"><v>45000</v></c><c r="AB2" s="3"><v>7</v></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    first, second = sheet_rows(out.getvalue())
    assert first == ["day", None, "rich"]
    assert second[:3] == ["2023-03-15T12:00:00", "true", None] and second[26:] == ["2023-03-15T00:00:00", "7"]


@pytest.mark.parametrize("path", ["notes.txt", "folder", "old.xls", "x.tar.gz"])
def test_other_kinds_are_refused(spark, path):
    with pytest.raises(ValueError, match="Unsupported file type"):
        readers.read_any(spark, path)


def test_nan_becomes_null(spark):
    df = readers.missing_to_null(spark.createDataFrame([(float("nan"), "a"), (1.0, None)], "v double, s string"))
    assert [r[0] for r in df.collect()] == [None, 1.0]


def test_versions_have_no_gaps(spark, store):
    reports = spark.createDataFrame([("a", 10), ("b", 20)], "table_name string, rows_clean bigint")
    for _ in range(3):
        store.append_report(reports)
    store.append_report(reports.filter("table_name = 'b'"))
    log = store.read("_dataset_reports")
    found = sorted((r["table_name"], r["version"]) for r in log.collect())
    assert found == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3), ("b", 4)]
    assert {(r["table_name"], r["version"]) for r in S.report_get(log).collect()} == {("a", 3), ("b", 4)}
    assert S.report_get(log, version=4).count() == 1


def test_metadata_keeps_the_newest(spark, store):
    report = spark.createDataFrame([(5,)], "rows_after int")
    store.save_metadata("t", report, {"A b": "a_b"})
    store.save_metadata("t", report.selectExpr("rows_after + 1 AS rows_after"), {"C d": "c_d"})
    assert json.loads(store.metadata("_cleaning_reports").first()["report"]) == {"rows_after": 6}
    assert store.metadata("_column_mappings").first()["mapping"] == {"C d": "c_d"}


def test_raw_twin_and_working_view(spark, store):
    raw = spark.createDataFrame([(" x ",)], "`Odd, name` string")
    store.write_raw("t", raw)
    store.write_clean("t", raw.selectExpr("trim(`Odd, name`) AS odd_name"))
    assert store.read("t__raw").columns == ["Odd, name"]
    assert spark.table("user_data").first()[0] == spark.table("t").first()[0] == "x"


def test_summaries_skip_internal_tables(spark):
    tables = spark.sql("SELECT * FROM VALUES ('a', 1), ('a__raw', 2), ('_m', 3), ('b', 4), ('c', NULL) AS t(table_name, loaded_at)")
    reports = spark.sql("SELECT 'a' AS table_name, v AS version, v * 10 AS rows_clean, 'HR' AS domain, 90 AS clean_score FROM VALUES (1), (2) AS t(v)")
    got = [tuple(r)[:5] for r in S.report_summaries(tables, reports).collect()]
    assert got == [("b", 1, 0, "Unknown", 0), ("a", 2, 20, "HR", 90), ("c", 1, 0, "Unknown", 0)]


def test_query_log(spark):
    log = spark.sql(
        "SELECT * FROM VALUES ('q1', 'a', 's1', 1), ('q1', 'b', 's2', 2), ('q2', 'c', 's3', 1) AS t(question, intent, sql, logged_at)"
    )
    assert {tuple(r)[:3] for r in S.query_log_latest(log).collect()} == {("q1", "b", "s2"), ("q2", "c", "s3")}
    assert [r["question"] for r in S.query_log_lookup(log, ["2"]).collect()] == ["q2"]
    assert S.query_log_lookup(log, []).count() == 0


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from tabwright import session

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "yarn", "applicationId": "x"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(Far)
