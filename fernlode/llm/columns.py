"""Columns by name, whatever the name holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def own_columns(docs: DataFrame) -> list[Column]:
    return [column(c) for c in docs.columns]
