"""Values of one-row tables as columns of other tables, by scalar subqueries instead of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame


def with_values(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a table of one row; a second row would be an error at run time."""
    return df.select("*", *[one_row.select(f"`{c}`").scalar().alias(c) for c in one_row.columns])
