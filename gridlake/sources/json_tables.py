"""Tables returned by an extraction service as JSON, in any of its shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRID = "array<array<string>>"
_TABLE = (
    f"rows {_GRID}, data {_GRID}, rowsData {_GRID}, columns array<string>, "
    "page string, table_index string, `index` string, "
    f"`table` struct<rows: {_GRID}, page: string, table_index: string>"
)


#: all up to the next number that stands outside quotes, and that number; possessive, so no text is read twice
_NEXT_NUMBER = r'\G((?:[^"0-9-]++|"(?:[^"\\]++|\\.)*+")*+)(-?[0-9][0-9.eE+-]*+)'


def numbers_as_texts(text: Column) -> Column:
    """The same JSON with every number in quotes, so that its digits stay as they were written."""
    return F.regexp_replace(text, _NEXT_NUMBER, '$1"$2"')


def _elements(text: Column) -> Column:
    """The tables of an answer as raw JSON texts, so that one odd element spoils no other; else null."""
    text = numbers_as_texts(text)
    as_array = F.from_json(text, "array<string>")
    as_object = F.from_json(text, "struct<tables: array<string>>")
    return F.when(F.ltrim(text).startswith("["), as_array).otherwise(as_object["tables"])


def _whole(text: Column) -> Column:
    """A whole number written as a number or as text, ``1.0`` included."""
    value = text.try_cast("double")
    return F.when(value == F.floor(value), value.cast("bigint"))


def table_json_errors(df: DataFrame, json_col: str = "json", key: str = "page_id") -> DataFrame:
    """``page_id, table_idx, error`` of answers and elements that hold no table.

    ``table_idx`` is null when the answer as a whole is at fault.
    """
    text = F.col(json_col)
    found = df.select(F.col(key).alias("page_id"), _elements(text).alias("found"), text.alias("text"))
    whole = found.where(F.col("text").isNotNull() & F.col("found").isNull()).select(
        "page_id", F.lit(None).cast("int").alias("table_idx"), F.lit("no list of tables").alias("error")
    )
    each = found.select("page_id", F.posexplode("found").alias("table_idx", "raw"))
    odd = each.where(F.coalesce(~F.ltrim("raw").startswith("{"), F.lit(True))).select(
        "page_id", "table_idx", F.lit("not a table").alias("error")
    )
    return whole.unionAll(odd)


def normalize_table_json(df: DataFrame, json_col: str = "json", key: str = "page_id") -> DataFrame:
    """Grid rows of every table in the JSON, plus ``service_page`` and ``service_index``.

    The top level is an array or ``{"tables": [...]}``.  Rows are the first non-null of
    rows, columns+data, data and table.rows; empty rows fall back to columns+data, then
    columns+rowsData; tables that stay empty are skipped.  ``table_idx`` is the position
    in the answer.  What holds no table is listed by :func:`table_json_errors`.
    """
    tables = F.transform(_elements(F.col(json_col)), lambda raw: F.from_json(raw, f"struct<{_TABLE}>"))
    t = F.col("t")
    header = F.array(t["columns"])
    with_data = F.when(
        t["columns"].isNotNull() & t["data"].isNotNull(), F.concat(header, t["data"])
    )
    with_rows_data = F.when(
        t["columns"].isNotNull() & t["rowsData"].isNotNull(), F.concat(header, t["rowsData"])
    )
    given = F.coalesce(t["rows"], with_data, t["data"], t["table"]["rows"])
    empty = F.coalesce(F.size(given), F.lit(0)) <= 0
    rows = F.when(empty, F.coalesce(with_data, with_rows_data)).otherwise(given)
    return (
        df.select(F.col(key).alias("page_id"), F.posexplode(tables).alias("table_idx", "t"))
        .select(
            "page_id",
            F.lit("pdf-batch").alias("kind"),
            "table_idx",
            F.coalesce(_whole(t["page"]), _whole(t["table"]["page"])).alias("service_page"),
            F.coalesce(
                _whole(t["table_index"]), _whole(t["index"]), _whole(t["table"]["table_index"])
            ).alias("service_index"),
            rows.alias("rows"),
        )
        .where(F.size("rows") > 0)
        .select(
            "page_id",
            "kind",
            "table_idx",
            "service_page",
            "service_index",
            F.posexplode("rows").alias("row_idx", "cells"),
        )
        .withColumn("row_idx", F.col("row_idx").cast("bigint"))
        .withColumn("cells", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))))
    )
