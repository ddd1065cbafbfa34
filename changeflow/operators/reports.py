"""Report pages over logs and metadata: optional filters, search, newest first."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.text import row_json

PAGE_ROWS, MAX_PAGE_ROWS = 50, 500


def maybe_where(rows: DataFrame, **equal: Any) -> DataFrame:
    """Equality filters; a filter given as None is left out."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def search(rows: DataFrame, term: str) -> DataFrame:
    """Rows whose JSON text holds ``term``, upper and lower case alike."""
    return rows.where(F.lower(row_json(*[F.col(c) for c in rows.columns])).contains(term.lower()))


def newest(rows: DataFrame, order: str, tie: str, limit: int = 100) -> DataFrame:
    """The newest rows; ``tie`` settles equal times."""
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(limit)


def page(rows: DataFrame, order: str, tie: str, limit: int = PAGE_ROWS, offset: int = 0) -> DataFrame:
    """One page, newest first."""
    if not 1 <= limit <= MAX_PAGE_ROWS or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")
    return rows.orderBy(F.desc(order), F.desc(tie)).offset(offset).limit(limit)


def page_after(rows: DataFrame, order: str, tie: str, last: tuple, limit: int = PAGE_ROWS) -> DataFrame:
    """The page that follows the row with ``last`` = (order, tie), at the same cost however far down it is."""
    at, key = last
    same = F.col(tie) < F.lit(key)
    if at is None:
        return page(rows.where(F.col(order).isNull() & same), order, tie, limit)
    older = (F.col(order) < F.lit(at)) | ((F.col(order) == F.lit(at)) & same) | F.col(order).isNull()
    return page(rows.where(older), order, tie, limit)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def newest_in_order(rows: DataFrame, order: str, tie: str, limit: int = 30) -> DataFrame:
    """The newest rows, oldest of them first, for charts."""
    return newest(rows, order, tie, limit).orderBy(order, tie)


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull()).distinct()


def preview(value: Column, length: int = 120) -> Column:
    """Start of a JSON text, as lists show it; the full text stays in the source row."""
    return F.substring(value, 1, length)
