"""Every operator as a query over the whole tables; names match ``suite.sql``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import is_money
from ..functions.dates import next_reset, parse_date
from ..functions.numbers import format_number, parse_number
from ..functions.text import js_trim, site_name
from ..operators import charts, export, filters, retention, search, sidecar, sorting, stats, usage
from ..operators.catalogue import (
    fingerprints,
    get_table,
    list_tables,
    merge_tables,
    rank_tables,
    search_tables,
    table_metrics,
)
from ..operators.clean import (
    clean_tables,
    drop_empty_columns,
    pad_rows,
    promote_header,
    set_header_row,
    validate_rectangular,
)
from ..operators.grid import number_rows
from ..operators.types import (
    ColumnProfile,
    column_evidence,
    decide_profile,
    detect_column_types,
    infer_types,
    merge_evidence,
    profile_wide,
    typed_cells,
    typed_rows,
)
from ..plans.detect import detect_tables, read_grid, read_tables, write_catalogue
from ..plans.staging import stage, staging_root
from ..plans.saved_views import AppliedViews, apply_saved_views
from ..plans.view import ViewSpec, apply_view, wide_fingerprint
from ..sources.html import extract_code_blocks, extract_html_runs, extract_html_tables
from ..sources.json_tables import normalize_table_json, table_json_errors
from ..sources.pages import page_intervals, route_pages, select_page_ranges
from ..sources.render import csv_text, escape_html, html_page, html_row, markdown_text
from ..sources.text_tables import (
    extract_block_tables,
    extract_text_tables,
    looks_like_csv,
    looks_like_markdown,
)
from . import data
from .data import ORDER_HEADER, SHEET_HEADER, table, text

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

#: column facts of the wide order book, as a reader would have confirmed them
ORDER_PROFILE = {
    "Order": ColumnProfile("Order", "numeric", ",", "."),
    "Total": ColumnProfile("Total", "money", ".", ","),
    "Date": ColumnProfile("Date", "date"),
    "Level": ColumnProfile("Level", "numeric", ",", "."),
    "Priority": ColumnProfile("Priority", "categorical"),
    "Buyer": ColumnProfile("Buyer", "numeric", ",", "."),
    "Share": ColumnProfile("Share", "rate", ".", ","),
}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _line(cells: str | Column = "cells") -> Column:
    return F.array_join(cells, "|").alias("line")


# ------------------------------------------------------------------ sources


@query
def html_order_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Pages -> tables -> clean -> types -> typed amounts -> total per order."""
    grid = stage(extract_html_runs(data.shipment_pages(spark, sf)), "shipments")
    tidy = stage(clean_tables(grid), "tidy")
    rows = typed_rows(tidy, stage(infer_types(tidy), "profile"))
    return (
        rows.select(
            F.get("nums", F.lit(0)).cast("bigint").alias("l_orderkey"),
            F.get("nums", F.lit(3)).alias("price"),
            F.get("nums", F.lit(4)).alias("discount"),
            F.get("dts", F.lit(5)).alias("shipped"),
        )
        .groupBy("l_orderkey")
        .agg(
            F.count("*").alias("n_lines"),
            F.round(F.sum("price"), 2).alias("total"),
            F.max("discount").cast("int").alias("top_discount"),
            F.max("shipped").alias("last_shipped"),
        )
    )


def _span_pages(spark: SparkSession, sf: str) -> DataFrame:
    people = F.sort_array(
        F.transform(
            "people",
            lambda p: F.struct(
                p["cells"][3].alias("segment"), p["c_custkey"].alias("key"), p["cells"][1].alias("name")
            ),
        )
    )
    sheets = data.customer_sheets(spark, sf).select("page_id", people.alias("people"))

    def row(p: Column, i: Column) -> Column:
        first = (i == 0) | (F.element_at("people", F.greatest(i, F.lit(1)))["segment"] != p["segment"])
        span = F.size(F.filter("people", lambda q: q["segment"] == p["segment"]))
        segment = F.concat(
            F.lit('<td rowspan="'), span.cast("string"), F.lit('">'), p["segment"], F.lit("</td>")
        )
        return F.concat(
            F.lit("<tr>"),
            F.when(first, segment).otherwise(""),
            F.lit("<td>"),
            p["key"].cast("string"),
            F.lit("<td>"),
            escape_html(p["name"]),
        )

    body = F.array_join(F.transform("people", row), "")
    total = F.concat(
        F.lit('<tr><td colspan="2">Total</td><td>'), F.size("people").cast("string"), F.lit("</td></tr>")
    )
    head = html_row(F.array(F.lit("Segment"), F.lit("Key"), F.lit("Name")), "th")
    return sheets.select(
        "page_id", html_page(F.lit("<table>"), head, body, total, F.lit("</table>")).alias("html")
    )


@query
def html_span_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = extract_html_tables(_span_pages(spark, sf))
    return grid.select("page_id", "row_idx", _line())


@query
def html_nested_rank(spark: SparkSession, sf: str) -> DataFrame:
    grid = stage(extract_html_tables(data.hard_pages(spark, sf)), "hard")
    return rank_tables(stage(table_metrics(grid), "metrics")).select(
        "page_id",
        "table_idx",
        "rank",
        "nested_tables",
        "is_container",
        "is_presentation",
        F.round("score", 6).alias("score"),
    )


@query
def top_tables(spark: SparkSession, sf: str) -> DataFrame:
    grid = stage(extract_html_tables(data.hard_pages(spark, sf)), "hard")
    best = rank_tables(stage(table_metrics(grid), "metrics"), top_k=1)
    return best.select("page_id", "table_idx", "n_rows", "n_cols")


@query
def table_quality(spark: SparkSession, sf: str) -> DataFrame:
    grid = stage(extract_html_tables(data.customer_pages(spark, sf)), "sheets")
    return table_metrics(grid).select(
        "page_id",
        "n_rows",
        "n_cols",
        F.round("density", 6).alias("density"),
        F.round("avg_row_fill", 6).alias("avg_row_fill"),
        "is_presentation",
        F.round("score", 6).alias("score"),
    )


def _sheet_grid(spark: SparkSession, sf: str) -> DataFrame:
    sheets = data.customer_sheets(spark, sf)
    header = F.array(F.concat(F.lit("Key "), F.col("nation")), *[F.lit(h) for h in SHEET_HEADER[1:]])
    return stage(
        data.as_grid(sheets, F.col("page_id"), "csv", F.concat(F.array(header), F.col("rows"))), "sheet-grid"
    )


@query
def table_ids(spark: SparkSession, sf: str) -> DataFrame:
    return list_tables(_sheet_grid(spark, sf)).select("page_id", "table_id", "n_rows")


@query
def table_preview(spark: SparkSession, sf: str) -> DataFrame:
    return list_tables(_sheet_grid(spark, sf)).select("page_id", "preview")


@query
def fingerprint_tables(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints(_sheet_grid(spark, sf)).select("page_id", "fingerprint")


@query
def table_search(spark: SparkSession, sf: str) -> DataFrame:
    grid = _sheet_grid(spark, sf)
    found = search_tables(list_tables(grid), grid, " Building ")
    return found.select("page_id", "table_id")


@query
def table_search_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A query that runs across a row end: a HOUSEHOLD row followed by a key ending in 1 row."""
    grid = _sheet_grid(spark, sf)
    found = search_tables(list_tables(grid), grid, "household \n 1")
    return found.select("page_id")


def _folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared staging area."""
    return f"{staging_root(spark)}/gridlake/{label}-{uuid.uuid4().hex}"


@query
def table_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Three queries over the stored trigram index: in a row, across a row end, too short for a trigram."""
    grid, path = _sheet_grid(spark, sf), _folder(spark, "index")
    search.write_search_index(grid, path)
    tables = stage(list_tables(grid), "tables")
    found = [
        search.search_index(spark, path, tables, q).select(F.lit(name).alias("query"), "page_id")
        for name, q in (("row", " Building "), ("rows", "household \n 1"), ("short", "9 "))
    ]
    return found[0].unionAll(found[1]).unionAll(found[2])


def _some_unseen() -> Column:
    """The customer of an order; odd orders name customers that no table has."""
    shift = F.when(F.col("o_orderkey") % 2 == 1, F.lit(10_000_000)).otherwise(F.lit(0))
    return (F.col("o_custkey") + shift).cast("string")


@query
def merge_table_lists(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    existing = c.select(
        F.concat(F.lit("t"), text("c_custkey")).alias("table_id"),
        F.lit("kept").alias("origin"),
        F.col("c_custkey").alias("position"),
    )
    incoming = table(spark, sf, "orders").select(
        F.concat(F.lit("t"), _some_unseen()).alias("table_id"),
        F.lit("new").alias("origin"),
        F.col("o_orderkey").alias("position"),
    )
    return merge_tables(existing, incoming)


def _block_pages(spark: SparkSession, sf: str) -> DataFrame:
    sheets = data.customer_sheets(spark, sf)
    csv = escape_html(csv_text(SHEET_HEADER, F.col("rows")))
    md = escape_html(markdown_text(SHEET_HEADER, F.col("rows")))
    return sheets.select(
        "page_id",
        html_page(
            F.lit("<p>a, b</p><pre><code>"), csv, F.lit("</code></pre><pre>"), md, F.lit("</pre>")
        ).alias("html"),
    )


@query
def code_block_tables(spark: SparkSession, sf: str) -> DataFrame:
    blocks = stage(extract_code_blocks(_block_pages(spark, sf)), "blocks")
    return extract_block_tables(blocks).select("page_id", "kind", "table_idx", "row_idx", _line())


@query
def csv_docs_detected(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(looks_like_csv("text")).select("doc_id")


@query
def md_docs_detected(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(looks_like_markdown("text")).select("doc_id")


def _doc_blocks(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(0).alias("block_idx"))
    found = extract_block_tables(docs, key="doc_id").where(F.col("kind") == kind)
    return found.select(
        F.col("page_id").alias("doc_id"), "row_idx", F.size("cells").alias("n_cells"), _line()
    )


@query
def csv_docs_parsed(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_blocks(spark, sf, "csv")


@query
def md_docs_parsed(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_blocks(spark, sf, "markdown")


@query
def text_tables_union(spark: SparkSession, sf: str) -> DataFrame:
    docs = extract_text_tables(table(spark, sf, "documents"), key="doc_id")
    talks = extract_text_tables(
        table(spark, sf, "conversations"), key="conv_id", index=F.col("turn")
    )
    out = ["page_id", "kind", "table_idx", "row_idx", _line()]
    return docs.select(F.lit("documents").alias("origin"), *out).unionByName(
        talks.select(F.lit("conversations").alias("origin"), *out)
    )


@query
def json_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The same sheets in five service shapes, one after the other."""
    sheets = data.customer_sheets(spark, sf)
    header = F.array(*[F.lit(h) for h in SHEET_HEADER])
    full = F.concat(F.array(header), F.col("rows"))
    page = F.col("page_id") % 7
    shapes = [
        F.to_json(
            F.array(F.struct(full.alias("rows"), page.alias("page"), F.lit(1).alias("table_index")))
        ),
        F.to_json(
            F.struct(
                F.array(
                    F.struct(
                        F.struct(
                            full.alias("rows"), page.alias("page"), F.lit(2).alias("table_index")
                        ).alias("table")
                    )
                ).alias("tables")
            )
        ),
        F.to_json(F.array(F.struct(header.alias("columns"), F.col("rows").alias("data"), F.lit(3).alias("index")))),
        F.to_json(F.array(F.struct(header.alias("columns"), F.col("rows").alias("rowsData")))),
        F.to_json(F.array(F.struct(F.array().cast("array<array<string>>").alias("rows")))),
    ]
    picked = F.element_at(F.array(*shapes), (F.pmod(F.col("page_id"), F.lit(5)) + 1).cast("int"))
    return normalize_table_json(sheets.select("page_id", picked.alias("json"))).select(
        "page_id", "table_idx", "service_page", "service_index", "row_idx", _line()
    )


def _range_specs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")

    def n(m: int) -> Column:
        return (k % m).cast("string")

    spec = (
        F.when(k % 23 == 0, F.lit(" "))
        .when(k % 19 == 0, F.concat(F.lit("2-x,"), n(5)))
        .when(k % 17 == 0, F.concat(F.lit("1, "), n(4), F.lit(",-3")))
        .when(k % 11 == 0, F.concat(F.lit("3-1000000000"), n(9), F.lit(",5")))
        .otherwise(F.concat((k % 4 + 2).cast("string"), F.lit(" - "), (k % 7 + 1).cast("string"), F.lit(",,1, "), (k % 6 + 1).cast("string")))
    )
    return table(spark, sf, "orders").select(k.alias("spec_id"), spec.alias("spec"))


@query
def json_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that are JSON numbers keep the digits they were written with, also beside texts that look like JSON."""
    k = text("o_orderkey")
    answer = F.concat(
        F.lit('[{"rows":[["n", "t"],['), k, F.lit('.50,"a, -5.0]: \\"7.10\\""],[-'), k, F.lit('e+03 , "x"],[0.'), k,
        F.lit('0, true]],"page":2.0,"table_index":'), k, F.lit("}]"),
    )
    answers = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), answer.alias("json"))
    return normalize_table_json(answers).select("page_id", "service_page", "service_index", "row_idx", _line())


@query
def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("spec_id"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("page"),
        "l_partkey",
        "l_quantity",
    )
    chosen, _ = select_page_ranges(pages, _range_specs(spark, sf), max_pages=20)
    return chosen.select("spec_id", "page", "l_partkey", "l_quantity")


@query
def page_ranges_unlimited(spark: SparkSession, sf: str) -> DataFrame:
    """Specifications of ten thousand million pages, without a limit."""
    pages = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("spec_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("page"), "l_partkey"
    )
    chosen, _ = select_page_ranges(pages, _range_specs(spark, sf))
    return chosen


@query
def page_range_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return page_intervals(_range_specs(spark, sf))[0]


@query
def page_range_errors(spark: SparkSession, sf: str) -> DataFrame:
    _, errors = page_intervals(_range_specs(spark, sf), max_pages=20)
    return errors


@query
def page_route(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit(".pdf"))).otherwise(F.col("url")).alias("url"),
    )
    return route_pages(pages).select("page_id", "route")


@query
def site_names(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    url = F.when(F.col("page_id") % 10 == 0, F.lit("no address")).otherwise(F.col("url"))
    return pages.select("page_id", site_name(url).alias("site"))


@query
def catalogue_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Detect, store by kind, read back, and count rows per table through the catalogue."""
    path = _folder(spark, "catalogue")
    write_catalogue(detect_tables(_block_pages(spark, sf)), path)
    sizes = read_grid(spark, path).groupBy("page_id", "kind", "table_idx").agg(F.count("*").alias("stored_rows"))
    return (
        read_tables(spark, path)
        .join(sizes, ["page_id", "kind", "table_idx"])
        .select("page_id", "kind", "table_idx", "n_rows", "stored_rows", "n_cols")
    )


# ------------------------------------------------------------------ cleanup


def _dirty_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets with an empty column, a blank-only column, empty rows and short rows."""
    sheets = data.customer_sheets(spark, sf)

    def row(p: Column) -> Column:
        k = p["c_custkey"]
        c = p["cells"]
        full = F.array(F.lit(""), c[0], F.lit(" "), c[2], c[3])
        return (
            F.when(k % 4 == 0, F.array(F.lit("\u00a0"), F.lit(""), F.lit("")))
            .when(k % 4 == 1, F.slice(full, 1, 4))
            .otherwise(full)
        )

    header = F.array(F.lit(""), F.lit("Key"), F.lit(""), F.lit("Balance"), F.lit(""))
    blank = F.array(F.array(F.lit(""), F.lit(" ")), F.array(F.lit("")), F.array(F.lit("")))
    rows = F.when(F.col("page_id") % 9 == 0, blank).otherwise(
        F.concat(F.array(header), F.transform("people", row))
    )
    return data.as_grid(sheets, F.col("page_id"), "html", rows)


@query
def clean_grid(spark: SparkSession, sf: str) -> DataFrame:
    tidy = clean_tables(stage(_dirty_grid(spark, sf), "dirty"))
    return tidy.select("page_id", "row_idx", _line())


@query
def padded_rows(spark: SparkSession, sf: str) -> DataFrame:
    return pad_rows(stage(_dirty_grid(spark, sf), "dirty")).select(
        "page_id", "row_idx", F.size("cells").alias("n_cells"), _line()
    )


@query
def dropped_columns(spark: SparkSession, sf: str) -> DataFrame:
    return drop_empty_columns(stage(_dirty_grid(spark, sf), "dirty")).select(
        "page_id", "row_idx", _line()
    )


@query
def promote_header_row(spark: SparkSession, sf: str) -> DataFrame:
    return promote_header(_sheet_grid(spark, sf), 15).select("page_id", "row_idx", _line())


@query
def set_header(spark: SparkSession, sf: str) -> DataFrame:
    return set_header_row(_sheet_grid(spark, sf), 15).select("page_id", "row_idx", _line())


@query
def rectangular_check(spark: SparkSession, sf: str) -> DataFrame:
    return validate_rectangular(stage(_dirty_grid(spark, sf), "dirty")).select(
        "page_id", "n_rows", "n_cols", "is_rectangular", "first_bad_row"
    )


# ------------------------------------------------------------------ types


def _order_grid(spark: SparkSession, sf: str) -> DataFrame:
    return stage(extract_html_tables(data.order_pages(spark, sf)), "orders")


@query
def infer_types_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return infer_types(_order_grid(spark, sf)).select("page_id", "col_idx", "header", "type", "n_values")


@query
def merged_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Types from the evidence of two halves of every table, stored apart and merged."""
    grid = _order_grid(spark, sf)
    halves = [stage(column_evidence(grid.where((F.col("row_idx") == 0) | (F.col("row_idx") % 2 == i))), "half") for i in (0, 1)]
    profile = decide_profile(merge_evidence(*halves))
    return profile.select("page_id", "col_idx", "header", "type", "n_values")


@query
def number_formats(spark: SparkSession, sf: str) -> DataFrame:
    grid = stage(extract_html_tables(data.customer_pages(spark, sf)), "sheets")
    return (
        infer_types(grid)
        .where(F.col("fmt").isNotNull())
        .select("page_id", "header", "type", "fmt.thousand", "fmt.decimal")
    )


def _orders_wide(spark: SparkSession, sf: str) -> DataFrame:
    return data.order_rows(spark, sf).drop("page_id")


@query
def infer_types_wide(spark: SparkSession, sf: str) -> DataFrame:
    return profile_wide(_orders_wide(spark, sf), ORDER_HEADER).select(
        "col_idx", "header", "type", "fmt.thousand", "fmt.decimal", "n_values"
    )


@query
def pinned_types(spark: SparkSession, sf: str) -> DataFrame:
    pins = {
        "Level": {"type": "categorical"},
        "Total": {"type": "money", "thousand": ".", "decimal": "."},
        "Buyer": {"type": "percentage", "decimal": ","},
    }
    return profile_wide(_orders_wide(spark, sf), ORDER_HEADER, overrides=pins).select(
        "col_idx", "header", "type", "fmt.thousand", "fmt.decimal"
    )


@query
def header_types(spark: SparkSession, sf: str) -> DataFrame:
    return detect_column_types(_order_grid(spark, sf)).select("page_id", "col_idx", "header", "type")


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts of orders in eight notations."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    us, eu = format_number(v, ",", ".", 2), format_number(v, ".", ",", 2)
    notations = [
        us,
        F.concat(F.lit("$ -"), eu),
        F.concat(F.lit("\u00a0-"), us, F.lit("%")),
        F.concat(eu, F.lit(" €")),
        F.concat(F.lit("R "), us),
        F.lit("N/A"),
        F.lit(""),
        F.concat(F.lit("+"), F.floor(v).cast("string"), F.lit(".")),
    ]
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.element_at(F.array(*notations), (k % 8 + 1).cast("int")).alias("raw")
    )


@query
def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _numbers(spark, sf).select(
        "o_orderkey",
        F.round(parse_number("raw", "."), 5).alias("as_dot"),
        F.round(parse_number("raw", ","), 5).alias("as_comma"),
        F.round(parse_number("raw", ".", on_bad="null"), 5).alias("or_null"),
    )


def _dates(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates in ten notations."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    months = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
    es = F.element_at(F.array(*[F.lit(m) for m in months.split()]), F.month(d))
    notations = [
        F.date_format(d, "dd/MM/yyyy"),
        F.date_format(d, "d-M-yyyy"),
        F.date_format(d, "yyyy-MM-dd"),
        F.date_format(d, "yyyy/M/d"),
        F.date_format(d, "MMM d, yyyy"),
        F.date_format(d, "d MMMM yyyy"),
        F.date_format(d, "dd-MMM-yyyy"),
        F.concat(F.dayofmonth(d).cast("string"), F.lit(" de "), es, F.lit(" de "), F.year(d).cast("string")),
        F.date_format(d, "d/M/yy"),
        F.concat(F.lit("32/01/"), F.year(d).cast("string")),
    ]
    return table(spark, sf, "orders").select(
        "o_orderkey", F.element_at(F.array(*notations), (k % 10 + 1).cast("int")).alias("raw")
    )


@query
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _dates(spark, sf).select("o_orderkey", parse_date("raw").alias("day"))


@query
def money_values(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.concat(text("o_custkey"), F.lit(" clp"))
    raw = F.when(F.col("o_orderkey") % 16 == 3, codes).otherwise(F.col("raw"))
    return _numbers(spark, sf).select("o_orderkey", is_money(raw).alias("is_money"))


@query
def format_numbers(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("l_extendedprice") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    return (
        table(spark, sf, "lineitem")
        .select(
            "l_orderkey",
            format_number(v).alias("plain"),
            format_number(v, ".", ",", 1).alias("eu"),
            format_number(v / 8, ",", ".", 2).alias("eighth"),
        )
        .groupBy("l_orderkey")
        .agg(
            F.min("plain").alias("plain"), F.max("eu").alias("eu"), F.min("eighth").alias("eighth")
        )
    )


# ------------------------------------------------------------------ filters


@query
def filter_numeric(spark: SparkSession, sf: str) -> DataFrame:
    rows = filters.filter_wide(
        _orders_wide(spark, sf), {"Total": {"type": "numeric", "max": "150000.5abc"}}, ORDER_PROFILE
    )
    return rows.select("Order", "Total")


@query
def filter_date(spark: SparkSession, sf: str) -> DataFrame:
    spec = {"raw": {"type": "date", "from": "1997-03-01", "to": "1998-06-30"}}
    return filters.filter_wide(_dates(spark, sf), spec).select("o_orderkey", "raw")


@query
def filter_categorical(spark: SparkSession, sf: str) -> DataFrame:
    spec = {"Priority": {"type": "categorical", "selected": ["1-URGENT", "2-HIGH", "5-LOW"], "text": "hI"}}
    return filters.filter_wide(_orders_wide(spark, sf), spec).select("Order", "Priority")


@query
def filter_combined(spark: SparkSession, sf: str) -> DataFrame:
    spec = {
        "Total": {"type": "numeric", "min": "100000", "max": "400000"},
        "Date": {"type": "date", "from": "1996-01-01"},
        "Priority": {"type": "categorical", "text": "e"},
        "Share": {"type": "numeric"},
    }
    return filters.filter_wide(_orders_wide(spark, sf), spec, ORDER_PROFILE).select("Order")


@query
def filter_corpus(spark: SparkSession, sf: str) -> DataFrame:
    grid = extract_html_tables(data.order_pages(spark, sf))
    spec = {1: {"type": "numeric", "min": "250000"}, 4: {"type": "categorical", "selected": ["3-MEDIUM", "1-URGENT"]}}
    return filters.filter_grid(grid, spec, {1: ","}).select("page_id", "row_idx", _line())


@query
def filter_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """The filters of ``filter_corpus`` and a date range, with ranges read from stored parsed values."""
    grid, path = _order_grid(spark, sf), _folder(spark, "sidecar")
    sidecar.write_sidecar(grid, infer_types(grid), path)
    spec = {
        1: {"type": "numeric", "min": "250000"},
        2: {"type": "date", "from": "1996-01-01"},
        4: {"type": "categorical", "selected": ["3-MEDIUM", "1-URGENT"]},
    }
    return sidecar.filter_with_sidecar(grid, path, spec).select("page_id", "row_idx", _line())


@query
def distinct_column_values(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "part").select(
        F.concat(F.lit(" "), "p_name", F.lit("\u00a0")).alias("p_name")
    )
    return filters.distinct_values(docs, "p_name")


# ------------------------------------------------------------------ stats


def _corpus_stats(spark: SparkSession, sf: str, names: tuple[str, ...]) -> DataFrame:
    grid = _order_grid(spark, sf)
    profile = stage(infer_types(grid), "profile")
    return stats.column_stats(typed_cells(grid, profile), names)


@query
def stats_numeric(spark: SparkSession, sf: str) -> DataFrame:
    long = _corpus_stats(spark, sf, stats.NUMERIC_STATS)
    return long.select("page_id", "header", "stat", F.round("num_value", 4).alias("num_value"))


@query
def stats_date(spark: SparkSession, sf: str) -> DataFrame:
    long = _corpus_stats(spark, sf, stats.DATE_STATS)
    return long.select("page_id", "header", "stat", "date_value", F.col("num_value").cast("int").alias("num_value"))


@query
def stats_categorical(spark: SparkSession, sf: str) -> DataFrame:
    long = _corpus_stats(spark, sf, ("unique", "mode"))
    return long.select(
        "page_id", "header", "stat", F.col("num_value").cast("int").alias("num_value"), "text_value", "extra"
    )


@query
def stats_wide(spark: SparkSession, sf: str) -> DataFrame:
    return stats.wide_stats(_orders_wide(spark, sf), ORDER_PROFILE).select(
        "header",
        "stat",
        F.round("num_value", 2).alias("num_value"),
        "date_value",
        "text_value",
        "extra",
    )


@query
def stats_panel(spark: SparkSession, sf: str) -> DataFrame:
    choice = {"Total": "sum", "Date": "range", "Priority": "mode"}
    return stats.wide_stats(_orders_wide(spark, sf), ORDER_PROFILE, choice).select(
        "col_idx", "header", "stat", F.round("num_value", 3).alias("num_value"), "text_value"
    )


@query
def stats_panel_corpus(spark: SparkSession, sf: str) -> DataFrame:
    grid = _order_grid(spark, sf)
    profile = stage(infer_types(grid), "profile")
    panel = stats.stats_panel(typed_cells(grid, profile), {1: "max", 4: "unique"})
    return panel.select("page_id", "header", "stat", F.round("num_value", 4).alias("num_value"))


@query
def stats_display(spark: SparkSession, sf: str) -> DataFrame:
    long = _corpus_stats(spark, sf, stats.ALL_STATS)
    shown = stats.display(
        long.withColumn("thousand", F.when(F.col("header") == "Total", F.lit(".")))
        .withColumn("decimal", F.when(F.col("header") == "Total", F.lit(",")))
    )
    return shown.where(F.col("header").isin("Total", "Date", "Priority")).where(
        F.col("stat").isin("count", "min", "max", "earliest", "range", "mode", "unique")
    ).select("page_id", "header", "stat", "shown")


# ------------------------------------------------------------------ order


@query
def sort_numeric(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders_wide(spark, sf).select("row_idx", "Order", "Total")
    return sorting.positions(rows, "Total", "desc", ORDER_PROFILE["Total"]).select("Order", "pos")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(
        (F.col("p_partkey") + 1).alias("row_idx"), name.alias("name"), "p_brand"
    )


@query
def sort_text(spark: SparkSession, sf: str) -> DataFrame:
    return sorting.positions(_parts(spark, sf), "name", "asc").select("row_idx", "pos")


@query
def filter_then_sort(spark: SparkSession, sf: str) -> DataFrame:
    spec = {"Priority": {"type": "categorical", "selected": ["2-HIGH"]}}
    kept = filters.filter_wide(_orders_wide(spark, sf), spec)
    return sorting.positions(kept, "Date", "asc", ORDER_PROFILE["Date"], date_order="chronological").select(
        "Order", "pos"
    )


@query
def row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """An explicit row order for a table without a unique key (equal rows are interchangeable)."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = table(spark, sf, "lineitem").select(*order)
    return number_rows(rows, [F.col(c) for c in order], "row_idx").select("l_orderkey", "l_linenumber", "row_idx")


# ------------------------------------------------------------------ charts, export


@query
def chart_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = filters.filter_wide(
        _orders_wide(spark, sf), {"Share": {"type": "numeric", "max": "20"}}, ORDER_PROFILE
    )
    return charts.chart_series(rows, "Date", ["Total", "Buyer"], ORDER_PROFILE)


@query
def scatter_points(spark: SparkSession, sf: str) -> DataFrame:
    return charts.scatter_points(_orders_wide(spark, sf), "Share", ["Total"], ORDER_PROFILE)


def _awkward_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Order rows whose cells need quoting in every export format."""
    k = F.col("o_orderkey")
    cells = F.array(
        text("o_orderkey"),
        F.concat(F.lit("a,"), "o_orderpriority"),
        F.when(k % 3 == 0, F.lit('say "x"')).when(k % 3 == 1, F.lit("p|q\r\nr")).otherwise(F.lit("t\tu")),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")),
    )
    return table(spark, sf, "orders").select(
        F.expr("o_orderkey div 50").alias("page_id"),
        F.lit("html").alias("kind"),
        F.lit(0).alias("table_idx"),
        (k % 50).alias("row_idx"),
        cells.alias("cells"),
    )


def _export(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    return export.export_lines(_awkward_grid(spark, sf), fmt).select("page_id", "line_no", "line")


@query
def export_csv(spark: SparkSession, sf: str) -> DataFrame:
    return _export(spark, sf, "csv")


@query
def export_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return _export(spark, sf, "tsv")


@query
def export_md(spark: SparkSession, sf: str) -> DataFrame:
    return _export(spark, sf, "md")


@query
def export_written(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a written export, read back; one of its tables has no page id."""
    grid = stage(_awkward_grid(spark, sf).withColumn("page_id", F.nullif("page_id", F.lit(0))), "awkward")
    sizes = grid.groupBy("page_id", "kind", "table_idx").agg(F.max(F.col("row_idx") + 1).alias("n_rows"))
    tables = sizes.select("*", F.lit(1).alias("position"), F.lit("https://a.example.com/").alias("url"))
    path = _folder(spark, "export")
    export.export_all(grid, tables, path, "2024-01-31", "csv", folders=False)
    return spark.read.parquet(f"{path}/tables").select("page_id", "line_no", "line")


@query
def export_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """One site per customer; each order is a table of its list, some without data."""
    k = F.col("o_orderkey")
    listed = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("page_id"),
        F.lit("html").alias("kind"),
        k.cast("int").alias("table_idx"),
        k.alias("rank"),
        (k % 6).alias("n_rows"),
        F.concat(F.lit("https://www.shop"), text("o_custkey"), F.lit(".example.com/a")).alias("url"),
        F.when(k % 2 == 0, F.concat(F.lit("Q[1]/"), "o_orderpriority", F.lit(": orders and returns"))).alias("source"),
    )
    placed = export.list_positions(listed)
    return export.export_manifest(placed, "2024-01-31", source="source").select(
        "page_id", "table_idx", "position", "sheet_name", "export_name"
    )


# ------------------------------------------------------------------ views, retention


def _spec() -> ViewSpec:
    return ViewSpec(
        columns=ORDER_HEADER,
        types={n: p.type for n, p in ORDER_PROFILE.items()},
        formats={"Total": {"thousand": ".", "decimal": ","}, "Share": {"thousand": ".", "decimal": ","}},
        filters={
            "Date": {"type": "date", "from": "1997-01-01", "to": "1999-12-31"},
            "Priority": {"type": "categorical", "selected": ["1-URGENT", "3-MEDIUM"]},
        },
        sort={"column": "Total", "direction": "desc"},
        stats={"Total": "max", "Date": "earliest"},
        series={"x": "Date", "ys": ["Total"]},
        fingerprint="",
    )


#: what readers saved, by page: two filters and a sort, a date range, a sort alone
SAVED_STATES = (
    '{"fingerprint": "@", "types": {"Total": "money", "Priority": "categorical"}, "formats": {"Total": {"thousand": ".", "decimal": ","}}, '
    '"filters": {"Total": {"type": "numeric", "min": "250000"}, "Buyer": {"type": "numeric", "min": " "}, '
    '"Priority": {"type": "categorical", "selected": ["3-MEDIUM", "1-URGENT"]}}, '
    '"sort": {"column": "Total", "direction": "desc"}, "stats": {"Total": "max"}}',
    '{"fingerprint": "@", "types": {"Date": "date"}, "filters": {"Date": {"type": "date", "from": "1996-01-01", "to": "1998-12-31"}}, '
    '"sort": {"column": "Date", "direction": "none"}, "stats": {"Date": "earliest"}}',
    '{"fingerprint": "@", "types": {"Priority": "categorical"}, "sort": {"column": "Priority", "direction": "asc"}, "stats": {"Priority": "unique"}}',
)


def _applied(spark: SparkSession, sf: str) -> AppliedViews:
    """A saved view for every order book, kept with the fingerprint of its table."""
    grid = _order_grid(spark, sf)
    marks = stage(fingerprints(grid), "marks")
    states = F.array(*(F.lit(x) for x in SAVED_STATES))
    state = F.replace(F.get(states, (F.col("page_id") % 3).cast("int")), F.lit("@"), F.col("fingerprint"))
    saved = marks.select(F.concat(F.lit("v"), text("page_id")).alias("view_id"), state.alias("state"))
    return apply_saved_views(grid, saved)


@query
def saved_view_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf).positioned().select("view_id", "page_id", "row_idx", "pos")


@query
def saved_view_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf).stats().select("view_id", "page_id", "header", "stat", "num_value", "date_value")


@query
def apply_view_rows(spark: SparkSession, sf: str) -> DataFrame:
    view = apply_view(_orders_wide(spark, sf), ViewSpec.from_json(_spec().to_json()))
    return view.positioned().select("Order", "Total", "pos")


@query
def apply_view_stats(spark: SparkSession, sf: str) -> DataFrame:
    view = apply_view(_orders_wide(spark, sf), _spec())
    return view.stats.select("header", "stat", F.round("num_value", 3).alias("num_value"), "date_value")


@query
def apply_view_series(spark: SparkSession, sf: str) -> DataFrame:
    return apply_view(_orders_wide(spark, sf), _spec()).series.drop("pos")


@query
def view_series_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return apply_view(_orders_wide(spark, sf), _spec()).series.select("series", "pos", "label", "y")


@query
def view_export_csv(spark: SparkSession, sf: str) -> DataFrame:
    return apply_view(_orders_wide(spark, sf), _spec()).lines("csv")


@query
def view_export_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return apply_view(_orders_wide(spark, sf), _spec()).lines("tsv")


@query
def view_export_md(spark: SparkSession, sf: str) -> DataFrame:
    return apply_view(_orders_wide(spark, sf), _spec()).lines("md")


@query
def filter_zero_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Balances of 0 and above, with a blank text filter that says nothing."""
    rows = table(spark, sf, "customer").select("c_custkey", text("c_acctbal").alias("balance"), "c_name")
    spec = {"balance": {"type": "numeric", "min": 0}, "c_name": {"type": "categorical", "text": "  "}}
    return filters.filter_wide(rows, spec).select("c_custkey")


@query
def json_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of which some hold an element that is no table, and some are no JSON at all."""
    k = F.col("c_custkey")
    good = F.lit('{"rows":[["h"],["a"]],"page":"3","index":2.0}')
    answer = (
        F.when(k % 3 == 0, F.concat(F.lit("["), good, F.lit(",7]")))
        .when(k % 3 == 1, F.concat(F.lit('{"tables":['), good, F.lit("]}")))
        .otherwise(F.lit("[{"))
    )
    answers = table(spark, sf, "customer").select(k.alias("page_id"), answer.alias("json"))
    rows = normalize_table_json(answers).where("row_idx = 1").select(
        "page_id", "table_idx", F.concat_ws(":", "service_page", "service_index").alias("said")
    )
    return rows.unionAll(table_json_errors(answers).select("page_id", "table_idx", "error"))


@query
def monthly_usage_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Months of instants are those of UTC, also where a session shows another day."""
    instants = table(spark, sf, "orders").select(
        "o_custkey",
        "o_orderstatus",
        F.timestamp_micros(F.unix_date(F.to_date("o_orderdate")) * F.lit(86_400_000_000) + F.col("o_orderkey") % 86_400).alias("at"),
    )
    return usage.monthly_usage(instants, user="o_custkey", action="o_orderstatus", ts="at")


@query
def container_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a wrapper that is no layout table, and pages of wrappers only."""
    k = F.col("c_custkey")
    inner = F.concat(F.lit("<table><tr><th>K</th><th>V</th></tr><tr><td>"), k.cast("string"), F.lit("</td><td>x</td></tr></table>"))
    wrapper = F.concat(F.lit("<table><tr><td>a</td><td>b</td></tr><tr><td>"), inner, F.lit("</td><td>c</td></tr></table>"))
    pages = table(spark, sf, "customer").select(
        k.alias("page_id"),
        F.lit("https://a.example.com/").alias("url"),
        F.when(k % 2 == 0, wrapper).otherwise(F.concat(wrapper, inner)).alias("html"),
    )
    grid = stage(extract_html_tables(pages), "containers")
    ranked = rank_tables(table_metrics(grid))
    return ranked.select("page_id", "table_idx", "is_container", "rank")


@query
def one_table(spark: SparkSession, sf: str) -> DataFrame:
    """The table of one page of the order book, as it is found again by its key."""
    return get_table(_order_grid(spark, sf), 1, 0).select("row_idx", _line())


@query
def html_wide_span(spark: SparkSession, sf: str) -> DataFrame:
    """Cells under a span of more than a thousand columns."""
    k = F.col("s_suppkey")
    width = k % 7 * 300 + 1
    html = F.concat(
        F.lit("<table><tr><td colspan="), width.cast("string"), F.lit(">a</td><td>b</td></tr><tr><td>c</td><td>"),
        k.cast("string"), F.lit("</td></tr></table>"),
    )
    pages = table(spark, sf, "supplier").select(k.alias("page_id"), F.lit("https://a.example.com/").alias("url"), html.alias("html"))
    return extract_html_tables(pages).select("page_id", "row_idx", F.size("cells").cast("bigint").alias("n_cells"))


@query
def html_huge_span(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of two hundred million columns, of which cleaning leaves those that hold text."""
    k = F.col("s_suppkey")
    html = F.concat(
        F.lit("<table><tr><td colspan="), (k % 7 + 200_000_000).cast("string"), F.lit(">a</td><td>b</td></tr><tr><td></td><td>"),
        k.cast("string"), F.lit("</td></tr></table>"),
    )
    pages = table(spark, sf, "supplier").select(k.alias("page_id"), F.lit("https://a.example.com/").alias("url"), html.alias("html"))
    runs = stage(extract_html_runs(pages), "runs")
    widths = runs.where("row_idx = 0").select("page_id", "width")
    return clean_tables(runs).join(widths, "page_id").select("page_id", "row_idx", "width", _line())


@query
def view_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return wide_fingerprint(_orders_wide(spark, sf), ORDER_HEADER)


def _saved(spark: SparkSession, sf: str, which: str) -> DataFrame:
    """Saved views: one per customer name; orders save again under existing and new names."""
    if which == "existing":
        return table(spark, sf, "customer").select(
            F.concat(F.lit("id"), text("c_custkey")).alias("id"),
            text("c_custkey").alias("name"),
            F.col("c_custkey").alias("position"),
            F.lit(0).cast("bigint").alias("saved_at"),
            F.lit("first").alias("state"),
        )
    return table(spark, sf, "orders").select(
        F.concat(F.lit("new"), text("o_orderkey")).alias("id"),
        _some_unseen().alias("name"),
        (F.col("o_orderkey") + 1).alias("position"),
        (F.col("o_orderkey") + 1).alias("saved_at"),
        F.concat(F.lit("state "), text("o_orderkey")).alias("state"),
    )


@query
def upsert_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return retention.upsert_by_key(_saved(spark, sf, "existing"), _saved(spark, sf, "incoming"))


@query
def keep_latest(spark: SparkSession, sf: str) -> DataFrame:
    return retention.keep_latest(
        table(spark, sf, "events").select("event_id", "user_id"), 20, ["user_id"], "event_id"
    )


@query
def keep_latest_overall(spark: SparkSession, sf: str) -> DataFrame:
    return retention.keep_latest(table(spark, sf, "events").select("event_id"), position="event_id")


@query
def expire(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-16 12:00:00").cast("timestamp_ntz")
    return retention.expire(table(spark, sf, "events"), now, saved_at="ts").select("event_id")


# ------------------------------------------------------------------ usage


@query
def monthly_usage(spark: SparkSession, sf: str) -> DataFrame:
    return usage.monthly_usage(
        table(spark, sf, "orders"),
        user="o_custkey",
        action="o_orderstatus",
        ts="o_orderdate",
        found=F.col("o_orderkey") % 5,
        premium=F.col("o_custkey") % 10 == 0,
    )


@query
def quota_status(spark: SparkSession, sf: str) -> DataFrame:
    used = usage.monthly_usage(table(spark, sf, "events"), action="event_type")
    return usage.quota_status(
        used, {"view": 15, "click": 25, "error": None, "purchase": 5}, premium=F.col("user") % 7 == 0
    )


@query
def next_reset_day(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", next_reset("o_orderdate").alias("resets_on"))


@query
def trimmed_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("\ufeff\u00a0 \t"), "role", F.lit("\u3000\n"), "text", F.lit("\u2003 "))
    trimmed = js_trim(raw)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.length(trimmed).alias("n_chars"), F.md5(trimmed).alias("digest")
    )
