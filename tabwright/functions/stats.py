"""Aggregate expressions as SQL text, with small samples and zero variance settled."""

from __future__ import annotations


def sample_std(x: str) -> str:
    """Sample deviation; 0 for a single value."""
    return f"CASE WHEN count({x}) > 0 THEN coalesce(stddev_samp({x}), 0D) END"


def adjusted_skew(x: str) -> str:
    """Bias-adjusted skewness; 0 for fewer than three values or a constant column."""
    n = f"double(count({x}))"
    factor = f"try_divide(sqrt({n} * ({n} - 1)), CASE WHEN {n} > 2 THEN {n} - 2 END)"
    return f"coalesce(skewness({x}) * {factor}, 0D)"


def adjusted_kurtosis(x: str) -> str:
    """Bias-adjusted excess kurtosis; null below four values, 0 for a constant column."""
    n = f"double(count({x}))"
    scale = f"try_divide({n} - 1, CASE WHEN {n} > 3 THEN ({n} - 2) * ({n} - 3) END)"
    return f"CASE WHEN {n} > 3 THEN coalesce({scale} * (({n} + 1) * kurtosis({x}) + 6), 0D) END"


def percent(part: str, whole: str, digits: int) -> str:
    return f"round(try_divide(100D * {part}, {whole}), {digits})"
