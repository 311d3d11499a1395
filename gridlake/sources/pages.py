"""Page-level sources: routing by URL and page-range specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import route, squeeze_out_spaces


def route_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("route", route("url"))


def _leading_int(text: Column) -> Column:
    return F.regexp_extract(text, r"^([+-]?[0-9]+)", 1).try_cast("bigint")


def page_intervals(
    specs: DataFrame, key: str = "spec_id", spec: str = "spec", max_pages: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(intervals, errors)`` of texts such as ``"1-3,5"``.

    ``intervals`` is (key, first, last): the 0-based pages a specification names, as merged intervals that neither
    touch nor overlap; ``errors`` is (key, error).  Nothing is ever expanded to pages, so ``1-999999999999`` costs
    one row.  ``max_pages`` refuses specifications that name more pages.

    One exchange by key: parts are judged, sorted and merged as gaps and islands there.
    """
    text = F.coalesce(squeeze_out_spaces(spec), F.lit(""))
    named = specs.select(F.col(key), text.alias("_text"))
    parts = F.filter(F.split("_text", ","), lambda p: p != "")
    named = named.select(key, "_text", F.posexplode_outer(parts).alias("_pos", "_part"))
    ends = F.split("_part", "-")
    a = _leading_int(F.get(ends, F.lit(0)))
    dash = F.size(ends) > 1
    named = named.select(key, "_text", "_pos", "_part", a.alias("_a"), F.when(dash, _leading_int(F.get(ends, F.lit(1)))).otherwise(a).alias("_b"), dash.alias("_dash"))
    bad = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") < 1) | (F.col("_b") < 1)
    label = F.when(F.col("_dash"), F.lit("Invalid range: ")).otherwise(F.lit("Invalid page: "))
    # wide enough for any sum of page numbers
    number = "decimal(38,0)"
    named = named.select(
        key,
        "_text",
        "_pos",
        F.when(F.col("_part").isNotNull() & bad, F.concat(label, "_part")).alias("_bad"),
        F.least("_a", "_b").cast(number).alias("_lo"),
        F.greatest("_a", "_b").cast(number).alias("_hi"),
    )
    whole = Window.partitionBy(key, "_text")
    in_order = whole.orderBy("_lo", "_hi", "_pos")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    merged = named.withColumn("_until", F.max("_hi").over(before))
    start = F.coalesce(F.col("_lo") > F.col("_until") + 1, F.lit(True))
    fresh = F.greatest(F.lit(0).cast(number), F.col("_hi") - F.greatest(F.coalesce(F.col("_until") + 1, F.col("_lo")), F.col("_lo")) + 1)
    merged = merged.withColumn("_start", start.cast("int")).withColumn("_fresh", fresh)
    merged = (
        merged.withColumn("_island", F.sum("_start").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", F.sum("_fresh").over(whole))
        .withColumn("_first_bad", F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("_pos"))).over(whole))
    )
    over = F.concat(F.lit(f"More than {max_pages} pages specified ("), F.col("_n").cast("string"), F.lit(")"))
    error = F.when(F.col("_text") == "", F.lit("Empty input")).when(F.col("_first_bad").isNotNull(), F.col("_first_bad"))
    if max_pages is not None:
        error = error.when(F.col("_n") > max_pages, over)
    merged = merged.withColumn("error", error)
    errors = merged.where(F.col("error").isNotNull() & (F.coalesce("_pos", F.lit(0)) == 0)).select(key, "error")
    intervals = (
        merged.where(F.col("error").isNull() & F.col("_lo").isNotNull())
        .groupBy(key, "_text", "_island")
        .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        .select(key, (F.col("_lo") - 1).cast("bigint").alias("first"), (F.col("_hi") - 1).cast("bigint").alias("last"))
    )
    return intervals, errors


def select_page_ranges(
    pages: DataFrame,
    specs: DataFrame,
    page_no: str = "page",
    key: str = "spec_id",
    spec: str = "spec",
    max_pages: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``pages`` (key, page_no, ...) that their document's specification names.

    A page meets the intervals of its own document only; those are as many as its specification has parts at most.  A
    document with a large share of all pages is split by Spark's skew join.
    """
    chosen, errors = page_intervals(specs, key, spec, max_pages)
    chosen = chosen.withColumnsRenamed({key: "_key", "first": "_first", "last": "_last"})
    inside = (F.col(key) == F.col("_key")) & F.col(page_no).between(F.col("_first"), F.col("_last"))
    return pages.join(chosen, inside, "left_semi"), errors
