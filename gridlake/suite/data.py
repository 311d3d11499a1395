"""Inputs of the registered queries, derived from the star schema inside Spark.

Pages are cut so that no page can grow with the data: blocks of a unique key, or
blocks of neighbouring rows of the scan.  The collected lists are bounded by that.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import format_number
from ..sources.render import html_page, html_row_of, html_table, html_table_of

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CUSTOMER_BLOCK, ORDER_BLOCK, SHIPMENT_BLOCK = 500, 50, 64

SHEET_HEADER = ["Key", "Name", "Balance", "Segment"]
ORDER_HEADER = ["Order", "Total", "Date", "Level", "Priority", "Buyer", "Share"]
SHIPMENT_HEADER = ["Order", "Line", "Quantity", "Price", "Discount", "Shipped"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(value: str | Column) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def money(value: Column, eu: Column) -> Column:
    thousand = F.when(eu, F.lit(".")).otherwise(F.lit(","))
    decimal = F.when(eu, F.lit(",")).otherwise(F.lit("."))
    return F.concat(F.lit("$ "), format_number(value, thousand, decimal, 2))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of neighbouring rows with one page_id, joined."""
    page, held = None, []

    def out(pages: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array(list(pages.values()), pa.string())], ["page_id", "body"])

    for batch in batches:
        done = {}
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != page:
                if held:
                    done[page] = "".join(held)
                page, held = key, []
            held.append(text)
        if done:
            yield out(done)
    if held:
        yield out({page: "".join(held)})


def shipment_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Delivery notes: 64 neighbouring lineitems per page.

    Neighbours come one after the other out of the scan, so their rows are joined as they pass and whole pages are dealt out.
    """
    row = html_row_of(
        text("l_orderkey"),
        text("l_linenumber"),
        text(F.col("l_quantity").cast("bigint")),
        F.concat(F.lit("$"), format_number("l_extendedprice", decimals=2)),
        F.concat(text(F.round(F.col("l_discount") * 100).cast("int")), F.lit("%")),
        F.date_format("l_shipdate", "dd/MM/yyyy"),
    )
    at = F.monotonically_increasing_id()
    rows = table(spark, sf, "lineitem").select(at.alias("at"), row.alias("row"))
    return (
        rows.select(F.expr(f"at div {SHIPMENT_BLOCK}").alias("page_id"), "row")
        .mapInArrow(_joined, "page_id bigint, body string")
        .repartition("page_id")
        .select("page_id", html_page(html_table_of(SHIPMENT_HEADER, F.col("body"))).alias("html"))
    )


def customer_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """``page_id, nation, eu, people``: customers of a nation, at most 500 keys per page."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    joined = c.join(n, c.c_nationkey == n.n_nationkey)
    eu = F.col("n_regionkey") % 2 == 1
    person = F.struct(
        "c_custkey",
        F.array(
            text("c_custkey"),
            F.col("c_name"),
            F.when(F.col("c_acctbal") < -900, F.lit("")).otherwise(money(F.col("c_acctbal"), eu)),
            F.col("c_mktsegment"),
        ).alias("cells"),
    )
    page = F.expr(f"c_nationkey * 1000000L + c_custkey div {CUSTOMER_BLOCK}")
    return (
        joined.select(page.alias("page_id"), F.col("n_name").alias("nation"), eu.alias("eu"), person.alias("p"))
        .groupBy("page_id", "nation", "eu")
        .agg(F.sort_array(F.collect_list("p")).alias("people"))
        .withColumn("rows", F.transform("people", lambda p: p["cells"]))
    )


def customer_pages(spark: SparkSession, sf: str) -> DataFrame:
    sheets = customer_sheets(spark, sf)
    return sheets.select("page_id", html_page(html_table(SHEET_HEADER, F.col("rows"))).alias("html"))


def hard_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Layout wrapper around the data table, a sparse layout table, two small summaries.

    Pages whose block number is a multiple of three hold the layout tables only.
    """
    sheets = customer_sheets(spark, sf)
    n = F.size("rows").cast("string")
    data = html_table(SHEET_HEADER, F.col("rows"), ' id="people"')
    wrapper = F.concat(
        F.lit('<table role="presentation" name="GroupContainer"><tr><td>'), data, F.lit("</td></tr></table>")
    )
    layout = F.lit(
        "<table><tr>" + "<td></td>" * 24 + "<td>menu</td></tr><tr>" + "<td> </td>" * 25 + "</tr></table>"
    )
    summary = F.concat(F.lit("<table><tr><th>Rows</th><th>Nation</th></tr><tr><td>"), n, F.lit("</td><td>"), F.col("nation"), F.lit("</td></tr></table>"))
    only_layout = F.col("page_id") % 3 == 0
    body = F.when(only_layout, F.concat(layout, layout)).otherwise(
        F.concat(wrapper, layout, summary, summary)
    )
    return sheets.select("page_id", html_page(body).alias("html"))


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row of texts per order, with every irregularity the typing rules care about."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.expr(f"o_orderkey div {ORDER_BLOCK}").alias("page_id"),
        (key + 1).alias("row_idx"),
        text("o_orderkey").alias("Order"),
        F.when(key % 13 == 0, F.lit("")).otherwise(money(F.col("o_totalprice"), F.lit(True))).alias("Total"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"),
        F.substring("o_orderpriority", 1, 1).alias("Level"),
        F.col("o_orderpriority").alias("Priority"),
        F.when(key % 17 == 0, F.lit("N/A")).otherwise(text("o_custkey")).alias("Buyer"),
        F.concat(text(key % 40), F.lit(",50%")).alias("Share"),
    )


def order_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Order books of fifty order keys each."""
    cells = F.array(*[F.col(h) for h in ORDER_HEADER])
    return (
        order_rows(spark, sf)
        .select("page_id", F.struct("row_idx", cells.alias("cells")).alias("r"))
        .groupBy("page_id")
        .agg(F.sort_array(F.collect_list("r")).alias("rows"))
        .select(
            "page_id",
            html_page(html_table(ORDER_HEADER, F.transform("rows", lambda r: r["cells"]))).alias("html"),
        )
    )


def as_grid(df: DataFrame, key: Column, kind: str, rows: Column) -> DataFrame:
    """Grid rows straight from an array of rows, without a text detour."""
    return df.select(
        key.alias("page_id"), F.lit(kind).alias("kind"), F.lit(0).alias("table_idx"), F.posexplode(rows).alias("row_idx", "cells")
    ).withColumn("row_idx", F.col("row_idx").cast("bigint"))
