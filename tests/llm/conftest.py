import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, size int, score double"
WORDS = [f"w{i}" for i in range(4000)]


def doc(i, text, source="a"):
    """A row with columns whose names clash with the operators' own."""
    return (i, text, "en", source, len(text or ""), -1, "x", 7, 0.5)


def run_of(a, n):
    return " ".join(WORDS[a : a + n])


@pytest.fixture(scope="session")
def corpus(spark):
    """Nulls, empty, one-word and very long texts, copies, near copies, ties, repeated rows and a hot source."""
    base = run_of(0, 120)
    rows = [
        doc(0, base), doc(1, base), doc(2, base + " extra words at end"), doc(3, None), doc(4, ""), doc(5, "  \n\t "),
        doc(6, "one"), doc(7, "one"), doc(8, run_of(500, 30) + " " + run_of(20, 40) + " " + run_of(900, 30), None),
        doc(9, " ".join([run_of(1000, 1500)] * 14), "b"), doc(None, run_of(10, 60)), doc(6, "one"),
        doc(10, "Zeile eins\nZeile eins\n\nü é 日本 text\x0bhere"), doc(11, "a b a b a b a b"), doc(12, run_of(700, 13)),
        doc(13, run_of(700, 12)), doc(14, "x " + run_of(700, 13), "c"), doc(15, run_of(2000, 300)), doc(16, run_of(2000, 299) + " end"),
    ]
    rows += [doc(100 + i, run_of(3000 + i % 7, 20 + i % 5), "hot") for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
