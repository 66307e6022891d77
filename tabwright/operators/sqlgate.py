"""Read-only SQL entry: one query, no commands, a row limit on the outside."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from tabwright.session import staged

DEFAULT_ROWS = 10_000
MAX_ROWS = 50_000

# Spark expressions that call arbitrary JVM code.
_UNSAFE_EXPRESSIONS = {"CallMethodViaReflection", "TryReflect"}


class RejectedSQL(ValueError):
    """The text is not a single read-only query."""


def strip_fences(text: str) -> str:
    """Drop code fences and one trailing semicolon."""
    bare = re.sub(r"```(?:sql)?", "", text, flags=re.IGNORECASE).strip()
    return bare[:-1].rstrip() if bare.endswith(";") else bare


@contextmanager
def _quoted_identifiers(spark: SparkSession):
    """Read "name" as a column while parsing, as in standard SQL, and no path as a table."""
    wanted = {"spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.runSQLOnFiles": "false"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _sequence(scala_seq) -> list:
    return [scala_seq.apply(i) for i in range(scala_seq.size())]


def _has_outer_limit(plan) -> bool:
    kind = plan.getClass().getSimpleName()
    if kind == "UnresolvedWith":
        return _has_outer_limit(plan.child())
    return kind in ("GlobalLimit", "LocalLimit")


def _check_expressions(plan) -> None:
    """Walk the analyzed plan, its expressions and its subquery plans."""
    plans, expressions = [plan], []
    while plans or expressions:
        if plans:
            node = plans.pop()
            plans.extend(_sequence(node.children()) + _sequence(node.innerChildren()))
            expressions.extend(_sequence(node.expressions()))
        else:
            node = expressions.pop()
            expressions.extend(_sequence(node.children()))
        if node.getClass().getSimpleName() in _UNSAFE_EXPRESSIONS:
            raise RejectedSQL("Forbidden function in query.")


def _checked(spark: SparkSession, text: str, default: int | None, cap: int | None) -> tuple[DataFrame, int | None]:
    """The query's rows and the limit that holds for them, if any."""
    query = strip_fences(text)
    if not query:
        raise RejectedSQL("Empty SQL statement.")
    with _quoted_identifiers(spark):
        parser = spark._jsparkSession.sessionState().sqlParser()
        try:
            parsed = parser.parseQuery(query)
        except Exception as error:
            if isinstance(error, ParseException) or "ParseException" in str(type(error)) + str(error):
                raise RejectedSQL(f"Only a single SELECT/WITH query is allowed: {error}") from error
            raise
        df = spark.sql(query)
    _check_expressions(df._jdf.queryExecution().analyzed())
    held = [cap] if _has_outer_limit(parsed) else [default, cap]
    return df, min((n for n in held if n is not None), default=None)


def safe_sql(spark: SparkSession, text: str, default: int | None = DEFAULT_ROWS, cap: int | None = MAX_ROWS) -> DataFrame:
    """Run one query. Spark's own query grammar admits SELECT, WITH and set operations only.

    Unknown tables and columns surface here, before any job runs. At most ``default`` rows come
    back, or ``cap`` where the query has a limit of its own; :func:`safe_rows` says if there are more.
    None lifts either limit.
    """
    df, limit = _checked(spark, text, default, cap)
    return df if limit is None else df.limit(limit)


def safe_rows(
    spark: SparkSession, text: str, default: int | None = DEFAULT_ROWS, cap: int | None = MAX_ROWS
) -> tuple[DataFrame, bool]:
    """Rows of :func:`safe_sql`, written once, and whether the limit cut them."""
    df, limit = _checked(spark, text, default, cap)
    if limit is None:
        return staged(df, "answer"), False
    found = staged(df.limit(limit + 1), "answer")
    cut = found.count() > limit
    # Which row is left out is as open as which rows a limit takes, but it's the same in every reading.
    return (staged(found.limit(limit), "answer") if cut else found), cut
