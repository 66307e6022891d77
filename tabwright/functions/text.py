"""Small helpers for SQL text. Expressions over many columns are written as text: one call
hands a whole aggregation to Spark, where building it column by column takes thousands."""

from __future__ import annotations


def name(column: str) -> str:
    """Quoted column name."""
    return "`" + column.replace("`", "``") + "`"


def quoted(value: str) -> str:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(regex: str) -> str:
    """Regular expression literal."""
    return 'r"' + regex + '"'


def one_of(x: str, values) -> str:
    return f"{x} IN ({', '.join(quoted(v) for v in values)})"
