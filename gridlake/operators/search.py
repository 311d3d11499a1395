"""A stored index of the texts of all tables: trigrams with postings, written beside the catalogue.

Tables are numbered; ``BLOCK`` neighbours make a block.  For every trigram and block the index holds the sorted
numbers of the tables that have it in a row, so no posting is longer than a block.  A query looks up its own trigrams
only, intersects their postings block by block, the rarest first, and verifies the few tables left on their
stored row texts.  Files are sorted by trigram and by table number, so both steps reach the Parquet scan as
pushed filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE
from ..plans.staging import stage
from .grid import KEY, dense_grid, join_null_safe, number_rows

#: tables in a block; files of postings
BLOCK = 1 << 15
SHARES = 64
#: candidate tables that reach the scan of row texts as a list; more are joined
LISTED = 10_000


def row_text(cells: Column) -> Column:
    """Lower-cased cells of a row, joined by spaces."""
    return F.lower(F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " "))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text, in time that grows with its length."""
    chars = F.split(text, "")
    grams = F.transform(
        F.slice(chars, 1, F.greatest(F.size(chars) - 2, F.lit(0))),
        lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2)),
    )
    return F.when(F.length(text) > 2, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def _share(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SHARES)).cast("int")


def write_search_index(grid: DataFrame, path: str) -> None:
    """Store ``tables`` (their numbers), ``rows`` (lower-cased texts) and ``postings`` under ``path``."""
    spark = grid.sparkSession
    rows = dense_grid(grid).select(*KEY, "row_idx", row_text(F.col("cells")).alias("text"))
    numbered = number_rows(rows.select(*KEY).distinct(), [F.col(k) for k in KEY], "no")
    numbered.withColumn("block", F.expr(f"no div {BLOCK}")).write.parquet(f"{path}/tables")
    tables = spark.read.parquet(f"{path}/tables")
    texts = join_null_safe(rows, tables, KEY).select("block", "no", "row_idx", "text")
    texts = texts.repartitionByRange("no", "row_idx").sortWithinPartitions("no", "row_idx")
    texts.write.partitionBy("block").parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows").select("block", "no", F.explode(trigrams(F.col("text"))).alias("gram"))
    postings = held.distinct().groupBy("gram", "block").agg(F.sort_array(F.collect_list("no")).alias("tables"))
    postings = postings.withColumn("share", _share(F.col("gram")))
    postings.repartition("share").sortWithinPartitions("share", "gram", "block").write.partitionBy("share").parquet(f"{path}/postings")


def query_trigrams(query: str) -> list[str]:
    """Trigrams that a row of every matching table has.

    A line break in a query may be the end of a row, so the text around it must be in a row
    only up to the space that stands before the next.
    """
    pieces = query.split("\n")
    inner = [
        p[1 if i and p.startswith(" ") else 0 : len(p) - (1 if i + 1 < len(pieces) and p.endswith(" ") else 0)] for i, p in enumerate(pieces)
    ]
    return sorted({p[i : i + 3] for p in inner for i in range(len(p) - 2)})


def candidate_tables(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """``block, no`` of the tables that have all trigrams."""
    share = [_share(F.lit(g)) for g in grams]
    postings = spark.read.parquet(f"{path}/postings")
    shares = [r for r in spark.range(1).select(*(s.alias(f"s{i}") for i, s in enumerate(share))).first()]
    found = postings.where(F.col("share").isin(sorted(set(shares))) & F.col("gram").isin(grams))
    lists = found.groupBy("block").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.size("tables").alias("size"), "tables"))).alias("lists")
    )
    rarest = F.col("lists")[0]["tables"]
    rest = F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0)))
    common = F.aggregate(rest, rarest, lambda acc, x: F.array_intersect(acc, x["tables"]))
    return lists.where(F.col("n") == len(grams)).select("block", F.explode(common).alias("no"))


def candidate_rows(spark: SparkSession, path: str, candidates: DataFrame) -> DataFrame:
    """Stored row texts of the candidates: a short list of numbers is pushed into the scan, a long one joined."""
    rows = spark.read.parquet(f"{path}/rows")
    some = candidates.select("block", "no").limit(LISTED + 1).collect()
    if len(some) <= LISTED:
        numbers = sorted(r.no for r in some)
        blocks = sorted({r.block for r in some})
        return rows.where(F.col("block").isin(blocks) & F.col("no").isin(numbers))
    return rows.join(candidates, ["block", "no"], "left_semi")


def matching_tables(rows: DataFrame, query: str) -> DataFrame:
    """``no`` of the tables whose rows, joined by ``" \\n "``, contain the query."""
    breaks = query.count("\n")
    if not breaks:
        return rows.where(F.col("text").contains(query)).select("no").distinct()
    spread = rows.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(breaks))))
    near = spread.groupBy("no", (F.col("row_idx") - F.col("back")).alias("start")).agg(
        F.sort_array(F.collect_list(F.struct("row_idx", "text"))).alias("near")
    )
    joined = F.array_join(F.transform("near", lambda r: r["text"]), " \n ")
    return near.where(joined.contains(query)).select("no").distinct()


def search_index(spark: SparkSession, path: str, tables: DataFrame, query: str) -> DataFrame:
    """The rows of ``tables`` (a catalogue) whose lower-cased text contains the query; the same as ``search_tables``.

    A blank query finds all.  A query without a trigram (under three characters in every line) reads all
    stored row texts.  Tables without rows are matched on preview and header.
    """
    q = query.strip(WHITE_SPACE).lower()
    if not q:
        return tables
    grams = query_trigrams(q)
    rows = spark.read.parquet(f"{path}/rows")
    if grams:
        rows = candidate_rows(spark, path, stage(candidate_tables(spark, path, grams), "candidates"))
    numbered = spark.read.parquet(f"{path}/tables")
    keys = numbered.join(matching_tables(rows, q), "no", "left_semi").select(*KEY)
    found = join_null_safe(tables, keys, KEY, "left_semi")
    header = F.array_join(F.transform(F.coalesce("header", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))), " ")
    shown = F.lower(F.concat(F.coalesce("preview", F.lit("")), F.lit("\n"), header))
    return found.unionByName(join_null_safe(tables.where(shown.contains(q)), numbered.select(*KEY), KEY, "left_anti"))
