"""Quoted CSV read by many tasks against Spark's reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from tabwright.sources import quoted, readers


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def fields(rng):
    odd = ["a,b", "line\nbreak", 'two\n\nbreaks, and ""quotes""', "", '""', "\r\nwin", 'x,\n""y""\n,', "\n" * rng.randint(1, 4) + "long " * rng.randint(1, 1200)]
    k = rng.random()
    if k < 0.3:
        return f'"{rng.choice(odd)}"'
    return str(rng.choice([7, 'in"ches 5"', "", "plain", "  spaced ", "é日本"]))


def write(folder, eol, files=3, rows=150, seed=1):
    rng = random.Random(seed)
    folder.mkdir()
    for f in range(files):
        lines = ["id,x,y,z"] + [",".join([str(i), *(fields(rng) for _ in range(3))]) for i in range(rows)]
        (folder / f"{f}.csv").write_bytes((eol.join(lines) + eol * (f % 2)).encode())
    return str(folder)


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2])
def test_rows_equal_those_of_whole_files(spark, tmp_path, small_splits, eol, seed):
    path = write(tmp_path / "in", eol, seed=seed)
    whole = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    split = quoted.read_quoted(spark, path)
    assert split.columns == whole.columns
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))
    assert quoted.lines_of(spark, path, ",").rdd.getNumPartitions() > 20


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    path = write(tmp_path / "in", "\n", files=1, rows=300)
    rows = quoted.read_quoted(spark, path)
    tasks = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    assert rows.count() == 300 and tasks > 10
    assert readers.read_csv(spark, path).count() == 300


def test_a_schema_another_separator_and_plain_files(spark, tmp_path, small_splits):
    path = tmp_path / "a.csv"
    path.write_text('id;note\n1;"a;\nb"\n2;c,d\n')
    got = readers.read_csv(spark, str(path), schema="id int, note string", sep=";")
    assert sorted(map(tuple, got.collect())) == [(1, "a;\nb"), (2, "c,d")]
    plain = tmp_path / "b.csv"
    plain.write_text('id,note\n1,"a ""quoted"" word"\n2,x\n')
    assert sorted(map(tuple, readers.read_csv(spark, str(plain)).collect())) == [(1, 'a "quoted" word'), (2, "x")]


def test_lines_that_open_quotes(spark):
    lines = {'a,"b': True, 'a,"b"': False, '"': True, '""': False, '"""': True, 'x"y': False, 'x"y,"z': True, '"a""': True, '"a"",': True, '"a,",b': False, "": False, '"a","': True}
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r["line"]: r["o"] for r in df.select("line", quoted.opens_quote(F.col("line")).alias("o")).collect()} == lines
