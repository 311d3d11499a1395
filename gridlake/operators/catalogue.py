"""Table quality, ranking, identity, preview and search: one row per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE, has_text, text_hash_base36
from .grid import KEY, attach, dense_grid, has_runs, join_null_safe, rank_within

# Layout cut-offs and the preview size.
MIN_DENSITY = 0.15
WIDE_HEADER, SPARSE_ROW = 20, 5
ROW_FILL_CAP = 10
PREVIEW_ROWS, PREVIEW_COLS, PREVIEW_CHARS, PREVIEW_KEEP = 3, 3, 15, 12
HEAD_ROWS = PREVIEW_ROWS + 1


def table_sizes(grid: DataFrame) -> DataFrame:
    """Counts per table: numeric buffers only, so this stays a hash aggregate."""
    held, width = ("texts", F.col("width")) if has_runs(grid) else ("cells", F.size("cells"))
    filled = F.size(F.filter(held, has_text))
    return (
        grid.groupBy(*KEY)
        .agg(
            F.count("*").alias("n_rows"),
            F.coalesce(F.max(F.when(F.col("row_idx") == 0, width)), F.lit(0)).alias("n_cols"),
            F.sum(filled).alias("filled_cells"),
            F.sum(width).alias("total_cells"),
        )
        .withColumn("density", F.col("filled_cells") / F.nullif(F.col("total_cells"), F.lit(0)))
        .withColumn("avg_row_fill", F.col("filled_cells") / F.col("n_rows"))
    )


def table_heads(grid: DataFrame) -> DataFrame:
    """First rows of each table (at most ``HEAD_ROWS``) and the element attributes."""
    top = dense_grid(grid.where(F.col("row_idx") < HEAD_ROWS))
    if "attrs" not in grid.columns:
        top = top.withColumn(
            "attrs",
            F.lit(None).cast(
                "struct<url:string,element_id:string,element_name:string,role:string,nested_tables:int>"
            ),
        )
    return (
        top.groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("row_idx", "cells", "attrs"))).alias("_head"))
        .select(
            *KEY,
            F.transform("_head", lambda h: h["cells"]).alias("head"),
            F.get("_head", F.lit(0))["attrs"].alias("attrs"),
        )
    )


def is_presentation(role: Column, name: Column, density: Column, n_cols: Column, fill: Column) -> Column:
    return (
        F.coalesce(role == "presentation", F.lit(False))
        | F.coalesce(name == "GroupContainer", F.lit(False))
        | F.coalesce(density < MIN_DENSITY, F.lit(False))
        | ((n_cols > WIDE_HEADER) & (fill < SPARSE_ROW))
    )


def table_metrics(grid: DataFrame) -> DataFrame:
    """Density, row fill, nesting, layout flags and score of every table."""
    joined = join_null_safe(table_sizes(grid), table_heads(grid), KEY)
    nested = F.coalesce(F.col("attrs.nested_tables"), F.lit(0))
    return (
        joined.withColumn("nested_tables", nested)
        .withColumn("is_container", nested > 0)
        .withColumn(
            "is_presentation",
            is_presentation(
                F.col("attrs.role"),
                F.col("attrs.element_name"),
                F.col("density"),
                F.col("n_cols"),
                F.col("avg_row_fill"),
            ),
        )
        .withColumn("score", F.col("density") * F.least(F.col("avg_row_fill"), F.lit(float(ROW_FILL_CAP))))
    )


def rank_tables(metrics: DataFrame, top_k: int | None = None) -> DataFrame:
    """Keep the best tables of each page and number them by score (ties: document order).

    Layout tables go first unless nothing else is left; containers go next, judged on
    the survivors only.
    """
    shown, inner = ~F.col("is_presentation"), ~F.col("is_container")
    facts = metrics.groupBy("page_id").agg(
        F.bool_or(shown).alias("_shown"),
        F.bool_or(shown & inner).alias("_shown_inner"),
        F.bool_or(inner).alias("_inner"),
        F.max("table_idx").alias("_last"),
    )
    judged = attach(metrics, facts, ["page_id"], "table_idx", "_last")
    keep = F.when(F.col("_shown"), shown & (inner | ~F.col("_shown_inner"))).otherwise(
        inner | ~F.col("_inner")
    )
    kept = judged.where(keep).drop("_shown", "_shown_inner", "_inner")
    ranked = rank_within(kept, ["page_id"], [F.col("score").desc(), F.col("table_idx")])
    return ranked.where(F.col("rank") <= top_k) if top_k is not None else ranked


def _joined(cells: Column, separator: str) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), separator)


def table_id(kind: Column, element: Column, index: Column, header: Column, n_rows: Column) -> Column:
    """``{kind}_{element id or content hash}_{index}``."""
    head = F.coalesce(header, F.array().cast("array<string>"))
    content = F.concat(
        _joined(head, "|"),
        F.lit("_"),
        (n_rows - 1).cast("string"),
        F.lit("x"),
        F.size(head).cast("string"),
    )
    named = F.coalesce(F.nullif(element, F.lit("")), text_hash_base36(content))
    return F.concat_ws("_", kind, named, index.cast("string"))


def preview(head: Column, n_rows: Column) -> Column:
    """Three rows by three columns; long cells are cut to twelve characters and dots."""

    def cell(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        return F.when(
            F.length(text) > PREVIEW_CHARS, F.concat(F.substring(text, 1, PREVIEW_KEEP), F.lit("..."))
        ).otherwise(text)

    rows = F.transform(
        F.slice(head, 1, PREVIEW_ROWS),
        lambda r: F.array_join(F.transform(F.slice(r, 1, PREVIEW_COLS), cell), " | "),
    )
    more = F.when(n_rows > PREVIEW_ROWS, F.lit("\n...")).otherwise(F.lit(""))
    return F.concat(F.array_join(rows, "\n"), more)


def fingerprint(head: Column, n_rows: Column) -> Column:
    """Header, shape and first body cells with all white space removed; '' when empty."""
    header = F.coalesce(F.get(head, F.lit(0)), F.array().cast("array<string>"))
    first = F.coalesce(F.get(head, F.lit(1)), F.array().cast("array<string>"))
    raw = F.concat(
        _joined(header, "|"),
        F.lit("_"),
        (n_rows - 1).cast("string"),
        F.lit("x"),
        F.size(header).cast("string"),
        F.lit("_"),
        _joined(F.slice(first, 1, 3), "|"),
    )
    return F.when(n_rows > 0, F.translate(raw, WHITE_SPACE, "")).otherwise(F.lit(""))


def table_marks(grid: DataFrame) -> DataFrame:
    """``KEY, fingerprint, last_row`` and the header rows (``row_idx`` 0) of each table."""
    header = F.when(F.col("row_idx") == 0, F.lit(1)).otherwise(0)
    counts = grid.groupBy(*KEY).agg(F.count("*").alias("n_rows"), F.max("row_idx").alias("last_row"), F.sum(header).cast("int").alias("_headers"))
    return join_null_safe(counts, table_heads(grid), KEY).select(
        *KEY,
        fingerprint(F.col("head"), F.col("n_rows")).alias("fingerprint"),
        "last_row",
        F.slice("head", F.lit(1), F.col("_headers")).alias("headers"),
    )


def fingerprints(grid: DataFrame) -> DataFrame:
    return table_marks(grid).select(*KEY, "fingerprint")


def list_tables(grid: DataFrame, top_k: int | None = None) -> DataFrame:
    """The catalogue: ranked html tables, and every text or service table, with id and preview."""
    metrics = table_metrics(grid)
    html = metrics.where(F.col("kind") == "html")
    other = metrics.where(F.col("kind") != "html").withColumn("rank", F.col("table_idx").cast("bigint") + 1)
    ranked = rank_tables(html, top_k).unionByName(other)
    element = F.coalesce(
        F.nullif(F.col("attrs.element_id"), F.lit("")), F.col("attrs.element_name"), F.lit("")
    )
    return ranked.select(
        *KEY,
        F.col("attrs.url").alias("url"),
        element.alias("element_id"),
        table_id(
            F.col("kind"), element, F.col("rank") - 1, F.get("head", F.lit(0)), F.col("n_rows")
        ).alias("table_id"),
        F.get("head", F.lit(0)).alias("header"),
        "n_rows",
        "n_cols",
        "density",
        "avg_row_fill",
        "nested_tables",
        "is_container",
        "is_presentation",
        "score",
        "rank",
        preview(F.col("head"), F.col("n_rows")).alias("preview"),
    )


def get_table(grid: DataFrame, page_id, table_idx: int, kind: str = "html") -> DataFrame:
    """Rows of one catalogued table; the filters reach the Parquet scan."""
    return grid.where(
        (F.col("page_id") == page_id) & (F.col("kind") == kind) & (F.col("table_idx") == table_idx)
    )


def merge_tables(
    existing: DataFrame, incoming: DataFrame, id_col: str = "table_id", position: str = "position"
) -> DataFrame:
    """Append the incoming tables whose id is new; the first occurrence of an id wins.

    Rows without a position come last; equal positions are told apart by a hash of the row, so
    the choice does not depend on partitions.  The aggregate combines on the map side, so a hot
    id never gathers.
    """
    cols = incoming.columns
    order = F.struct(F.col(position).isNull(), F.col(position), F.xxhash64(*cols))
    first = incoming.groupBy(id_col).agg(F.min_by(F.struct(*cols), order).alias("_t"))
    fresh = join_null_safe(first, existing.select(id_col).distinct(), [id_col], "left_anti").select("_t.*")
    return existing.unionByName(fresh.select(*existing.columns))


def search_tables(tables: DataFrame, grid: DataFrame, query: str) -> DataFrame:
    """Tables whose lower-cased text contains the query (blank query: all).

    A table's text is its cells joined by a space and its rows by ``" \\n "``.  A query
    with n line breaks can touch n+1 neighbouring rows, so only that many row texts are
    ever put together; without a line break the test stays inside one row and needs no
    grouping at all.  Tables without rows in ``grid`` are matched on preview and header.
    """
    q = query.strip(WHITE_SPACE).lower()
    if not q:
        return tables
    text = F.lower(_joined(F.col("cells"), " "))
    rows = grid.select(*KEY, "row_idx", text.alias("_text"))
    breaks = q.count("\n")
    if breaks == 0:
        hits = rows.where(F.col("_text").contains(q))
    else:
        spread = rows.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(breaks))))
        hits = (
            spread.withColumn("_start", F.col("row_idx") - F.col("_back"))
            .groupBy(*KEY, "_start")
            .agg(F.sort_array(F.collect_list(F.struct("row_idx", "_text"))).alias("_near"))
            .where(F.array_join(F.transform("_near", lambda r: r["_text"]), " \n ").contains(q))
        )
    keys = hits.select(*KEY).distinct()
    found = join_null_safe(tables, keys, KEY, "left_semi")
    hay = F.lower(F.concat(F.coalesce("preview", F.lit("")), F.lit("\n"), _joined(F.coalesce("header", F.array().cast("array<string>")), " ")))
    dataless = join_null_safe(tables.where(hay.contains(q)), grid.where(F.col("row_idx") == 0).select(*KEY), KEY, "left_anti")
    return found.unionByName(dataless)
