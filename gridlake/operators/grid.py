"""The grid model and the two skew-safe building blocks every operator shares.

``grid``  : page_id, kind, table_idx, row_idx, cells ARRAY<STRING>   (row 0 = header)
``runs``  : the same with width, at ARRAY<BIGINT>, texts ARRAY<STRING> for cells: the columns ``at`` (null: the first
            ones) hold ``texts``, the rest of ``width`` columns are blank
``cells`` : page_id, kind, table_idx, row_idx, col_idx, value

One table may hold a large share of all rows, so no operator shuffles rows by
table alone.  Rows are addressed by (table, bucket) with ``bucket = row_idx div
BUCKET_ROWS``: per-table facts are copied once per bucket of their table (one copy
for ordinary tables) and ordered work happens inside a bucket plus a running
offset over the buckets.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

KEY = ["page_id", "kind", "table_idx"]
BUCKET_ROWS = 1 << 16


def bucket(index: str = "row_idx", size: int | None = None) -> Column:
    return F.expr(f"CAST({index} AS BIGINT) div {size or BUCKET_ROWS}")


def attach(
    rows: DataFrame,
    facts: DataFrame,
    keys: list[str] | None = None,
    index: str = "row_idx",
    last: str = "last_row",
    size: int | None = None,
) -> DataFrame:
    """Join one-row-per-key ``facts`` to ``rows`` without gathering a key in one task.

    ``facts[last]`` is the largest ``index`` of the key; it says how many buckets
    the key has and is consumed here.
    """
    keys = keys or KEY
    spread = facts.withColumn(
        "_bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), bucket(last, size)))
    ).drop(last)
    return join_null_safe(rows.withColumn("_bucket", bucket(index, size)), spread, [*keys, "_bucket"]).drop("_bucket")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys come from ``left``."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    test = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    joined = left.join(other, test, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"_right_{k}" for k in keys))


RUNS = ["width", "at", "texts"]


def has_runs(grid: DataFrame) -> bool:
    return "texts" in grid.columns


def run_columns() -> Column:
    """The column of each text of a row in runs."""
    first_ones = F.transform("texts", lambda _, i: i.cast("bigint"))
    return F.coalesce("at", first_ones)


def dense_grid(grid: DataFrame) -> DataFrame:
    """A grid in runs with ``cells``, one text per column; other grids as they are."""
    if not has_runs(grid):
        return grid

    def blanks(n: Column) -> Column:
        return F.array_repeat(F.lit(""), F.greatest(n, F.lit(0)).cast("int"))

    short = F.concat("texts", blanks(F.col("width") - F.size("texts")))
    until = F.slice(F.concat("at", F.array("width")), F.lit(2), F.size("at"))
    spread = F.zip_with(F.arrays_zip("at", "texts"), until, lambda x, e: F.concat(F.array(x["texts"]), blanks(e - x["at"] - 1)))
    first = F.coalesce(F.get("at", F.lit(0)), F.col("width"))
    cells = F.when(F.col("at").isNull(), short).otherwise(F.concat(blanks(first), F.flatten(spread)))
    own = ["cells" if c == "texts" else c for c in grid.columns if c not in ("width", "at")]
    return grid.withColumn("cells", cells).select(*own)


def to_cells(grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per cell; of a grid in runs, one per cell that holds text."""
    if has_runs(grid):
        held = grid.select(*(keys or KEY), "row_idx", F.inline(F.arrays_zip(run_columns().alias("col_idx"), F.col("texts").alias("value"))))
        return held.withColumn("col_idx", F.col("col_idx").cast("int"))
    return grid.select(*(keys or KEY), "row_idx", F.posexplode("cells").alias("col_idx", "value"))


def number_rows(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Dense 1-based position under a total order, with no single-task stage.

    Sort (range-partitioned, so even one hot leading value is split by the later
    order columns), write once, then add each partition's offset.  The offsets
    table has one row per sort partition; Spark's own size check decides how it is joined.
    """
    marked = stage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_mid", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    within = F.pmod(F.col("_mid"), F.lit(1 << 33))
    return (
        marked.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, F.col("_before") + within + 1)
        .drop("_part", "_mid", "_before")
    )


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``row_number`` per key that stays balanced when one key is huge.

    Rows are sorted globally by key and order, so that a huge key is split over tasks, and
    numbered from the first position of their key.
    """
    ranked = number_rows(df, [*[F.col(k) for k in keys], *order], "_pos")
    starts = ranked.groupBy(*keys).agg(F.min("_pos").alias("_start"))
    ranked = join_null_safe(ranked, starts, keys)
    return ranked.withColumn(name, F.col("_pos") - F.col("_start") + 1).drop("_pos", "_start")
