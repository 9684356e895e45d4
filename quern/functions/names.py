"""Column names that may hold anything: dots, backticks, and names that an operator would like to use itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of just this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores before those that are taken (in upper or lower case)."""
    lower, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in lower:
            name = "_" + name
        lower.add(name.lower())
        out.append(name)
    return out
