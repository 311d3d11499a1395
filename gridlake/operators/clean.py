"""Cleaning grids: padding, empty columns and rows, header changes, shape checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text
from ..plans.staging import stage
from .grid import KEY, attach, bucket, has_runs, join_null_safe, run_columns


def pad_rows(grid: DataFrame) -> DataFrame:
    """Fill short rows with '' up to the widest row of their table."""
    facts = grid.groupBy(*KEY).agg(
        F.max(F.size("cells")).alias("_width"), F.max("row_idx").alias("last_row")
    )
    short = F.col("_width") - F.size("cells")
    return (
        attach(grid, facts)
        .withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), short)))
        .drop("_width")
    )


#: columns whose filled state fits one word
WORD = 62


def _bits(columns: Column, first: Column | int = 0) -> Column:
    """The columns from ``first`` on, up to a word's length, as bits."""
    one = F.lit(1).cast("bigint")

    def add(bits: Column, c: Column) -> Column:
        place = c - first
        held = F.call_function("shiftleft", one, place.cast("int"))
        return F.when((place >= 0) & (place < WORD), bits.bitwiseOR(held)).otherwise(bits)

    return F.aggregate(columns, F.lit(0).cast("bigint"), add)


def _columns(bits: Column, first: Column | int = 0, width: Column | None = None) -> Column:
    """The columns of a word's bits, in order; no more than ``width`` are looked at."""
    last = F.lit(WORD) if width is None else F.greatest(F.least(F.lit(WORD), width), F.lit(1))
    places = F.sequence(F.lit(0).cast("bigint"), (last - 1).cast("bigint"))
    return F.transform(F.filter(places, lambda i: F.getbit(bits, i.cast("int")) == 1), lambda i: i + first)


def _all_visible(held: Column) -> Column:
    """True only if every text begins with a visible ASCII character: one pattern over the row, no loop over cells."""
    return F.coalesce(F.array_join(held, "\n", "").rlike(r"\A[!-~][^\n]*+(?:\n[!-~][^\n]*+)*+\z"), F.lit(False))


def _bucket_facts(seen: DataFrame) -> DataFrame:
    """``KEY, _bucket``: rows before the bucket, all and those with text, and width and kept columns of the table."""
    per_bucket = stage(
        seen.groupBy(*KEY, "_bucket").agg(
            F.bit_or("_bits").alias("_bits"),
            F.max("_w").alias("_w"),
            F.count("*").alias("_rows"),
            F.count_if("_alive").alias("_live"),
        ),
        "clean",
    )
    further = F.array_distinct(F.transform(F.filter("_filled", lambda c: c >= WORD), lambda c: c - c % WORD))
    words = (
        seen.where(F.col("_w") > WORD)
        .select(*KEY, "_filled", F.explode(further).alias("_first"))
        .groupBy(*KEY, "_first")
        .agg(F.bit_or(_bits(F.col("_filled"), F.col("_first"))).alias("_bits"))
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("_first", "_bits"))).alias("_words"))
    )
    kept = per_bucket.groupBy(*KEY).agg(F.bit_or("_bits").alias("_bits"), F.max("_w").alias("_width"))
    more = F.flatten(F.transform("_words", lambda x: _columns(x["_bits"], x["_first"])))
    keep = F.concat(_columns(F.col("_bits")), F.coalesce(more, F.array().cast("array<bigint>")))
    kept = join_null_safe(kept, words, KEY, "left").select(*KEY, "_width", keep.alias("_keep"))
    before = (
        Window.partitionBy(*KEY).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_bucket.select(
        *KEY,
        "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_live").over(before), F.lit(0)).alias("_live_before"),
    )
    return join_null_safe(offsets, kept, KEY)


def clean_tables(grid: DataFrame, bucket_rows: int | None = None) -> DataFrame:
    """Pad, drop columns that are empty everywhere, drop empty body rows, renumber rows.

    A row is non-empty in the kept columns exactly when it has any text at all, so the filled columns and the
    surviving rows are found together.  Filled columns are bits of a long, or-ed on the way.  Rows meet in their
    (table, bucket) once; a bucket holds 65 536 grid rows at most.  A table of one bucket and one word of columns
    is settled by a window over it.  Only the others need facts from a pass of their own, staged: the kept
    columns of the table, whose rows past the first word are taken apart into words, and the row offsets of its
    buckets.  A table without any text is only padded.  A grid in runs comes out with ``cells``: its kept columns
    all hold text.
    """
    runs = has_runs(grid)
    own = [c for c in grid.columns if c not in ("width", "at")]
    own = ["cells" if c == "texts" else c for c in own]
    held = "texts" if runs else "cells"
    if runs:
        filled = F.zip_with(held, run_columns(), lambda t, c: F.when(has_text(t), c))
    else:
        filled = F.transform(held, lambda t, i: F.when(has_text(t), i.cast("bigint")))
    filled = F.filter(filled, lambda c: c.isNotNull())
    width = F.col("width") if runs else F.size(held).cast("bigint")
    dense = F.col("at").isNull() if runs else F.lit(True)
    marked = grid.withColumns(
        {"_bucket": bucket(size=bucket_rows), "_w": width, "_full": _all_visible(F.col(held)) & dense}
    )
    low = F.col("_full") & (F.size(held) <= WORD)
    ones = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.size(held)) - 1
    text = F.when(F.col("_full"), F.lit(True)).otherwise(F.exists(held, has_text))
    marked = marked.withColumns(
        {"_bits": F.when(low, ones).otherwise(_bits(filled)), "_alive": (F.col("row_idx") == 0) | text}
    )
    one_bucket = F.coalesce(bucket(size=bucket_rows) == 0, F.lit(False))
    large = stage(grid.where(~one_bucket | (width > WORD)).select(*KEY).distinct(), "clean-large")
    seen = join_null_safe(marked, large, KEY, "left_semi").withColumn("_filled", filled)
    facts = stage(_bucket_facts(seen), "clean-facts")
    rows = join_null_safe(marked, facts, [*KEY, "_bucket"], "left")

    ordered = Window.partitionBy(*KEY, "_bucket").orderBy("row_idx")
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {
            "_bits": F.bit_or("_bits").over(every),
            "_w": F.max("_w").over(every),
            "_row": F.row_number().over(ordered),
            "_live": F.count_if("_alive").over(so_far),
        }
    )
    wide = F.coalesce("_width", "_w")
    blank = F.coalesce(F.size("_keep") == 0, F.col("_bits") == 0)
    keep = F.coalesce("_keep", _columns(F.col("_bits"), width=wide))
    if runs:
        at = F.when(F.col("at").isNull(), F.lit(None)).otherwise(F.map_from_arrays("at", "texts"))
        rows = rows.withColumn("_at", at)
        value = lambda i: F.when(F.col("at").isNull(), F.get("texts", i.cast("int"))).otherwise(F.try_element_at("_at", i))
    else:
        value = lambda i: F.get(held, i.cast("int"))
    padded = F.array_repeat(F.lit(""), wide.cast("int"))
    if not runs:
        padded = F.transform(padded, lambda blank, i: F.coalesce(F.get(held, i), blank))
    # a row that fills its table's width keeps every column
    cells = (
        F.when(F.col("_full") & (F.size(held) == wide), F.col(held))
        .when(blank, padded)
        .otherwise(F.transform(keep, lambda i: F.coalesce(value(i), F.lit(""))))
    )
    place = F.when(blank, F.coalesce("_rows_before", F.lit(0)) + F.col("_row")).otherwise(
        F.coalesce("_live_before", F.lit(0)) + F.col("_live")
    )
    return (
        rows.where(blank | F.col("_alive"))
        .withColumn("cells", cells)
        .withColumn("row_idx", place - 1)
        .select(*own)
    )


def drop_empty_columns(grid: DataFrame) -> DataFrame:
    """Only the column half of :func:`clean_tables`; rows keep their numbers."""
    cells = F.posexplode("cells").alias("col_idx", "value")
    wide = grid.groupBy(*KEY).agg(
        F.max(F.size("cells")).alias("_width"), F.max("row_idx").alias("last_row")
    )
    kept = (
        grid.select(*KEY, cells)
        .where(has_text("value"))
        .select(*KEY, "col_idx")
        .distinct()
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list("col_idx")).alias("_keep"))
    )
    facts = join_null_safe(wide, kept, KEY, "left")
    columns = F.coalesce(
        "_keep", F.sequence(F.lit(0), F.greatest(F.col("_width") - 1, F.lit(0)))
    )
    return (
        attach(grid, facts)
        .withColumn(
            "cells", F.transform(columns, lambda i: F.coalesce(F.get("cells", i), F.lit("")))
        )
        .drop("_keep", "_width")
    )


def promote_header(grid: DataFrame, index: int) -> DataFrame:
    """Row ``index`` (clamped to the table) becomes the header, the rest keep their order."""
    facts = grid.groupBy(*KEY).agg(F.max("row_idx").alias("last_row"))
    facts = facts.withColumn("_at", F.greatest(F.lit(0), F.least(F.lit(index), F.col("last_row"))))
    row = F.col("row_idx")
    moved = (
        F.when(row == F.col("_at"), F.lit(0))
        .when(row < F.col("_at"), row + 1)
        .otherwise(row)
        .cast("bigint")
    )
    return attach(grid, facts).withColumn("row_idx", moved).drop("_at")


def set_header_row(grid: DataFrame, index: int, delete_above: bool = True) -> DataFrame:
    """Like :func:`promote_header`, but rows above go and an index outside the table is ignored."""
    facts = grid.groupBy(*KEY).agg(F.max("row_idx").alias("last_row"))
    inside = (F.lit(index) >= 0) & (F.lit(index) <= F.col("last_row"))
    facts = facts.withColumn("_at", F.when(inside, F.lit(index)).otherwise(F.lit(0)))
    rows = attach(grid, facts)
    row, at = F.col("row_idx"), F.col("_at")
    if delete_above:
        rows = rows.where(row >= at).withColumn("row_idx", (row - at).cast("bigint"))
    else:
        moved = F.when(row == at, F.lit(0)).when(row < at, row + 1).otherwise(row)
        rows = rows.withColumn("row_idx", moved.cast("bigint"))
    return rows.drop("_at")


def validate_rectangular(grid: DataFrame) -> DataFrame:
    """``is_rectangular`` and the first row whose width differs from the header's."""
    widths = grid.groupBy(*KEY, F.size("cells").alias("_width")).agg(
        F.count("*").alias("_rows"),
        F.min("row_idx").alias("_first"),
        F.max(F.col("row_idx") == 0).alias("_head"),
    )  # a row per width of a table
    head = widths.where("_head").groupBy(*KEY).agg(F.max("_width").alias("n_cols"))
    odd = F.when(F.col("_width") != F.col("n_cols"), F.col("_first"))
    return (
        join_null_safe(widths, head, KEY, "left")
        .groupBy(*KEY)
        .agg(
            F.max("n_cols").alias("n_cols"),
            F.sum("_rows").alias("n_rows"),
            F.min(odd).alias("first_bad_row"),
        )
        .withColumn("is_rectangular", F.col("first_bad_row").isNull() & (F.coalesce("n_cols", F.lit(0)) > 0))
    )
