"""Column types and number formats, for corpora of grids and for one wide table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import PERCENT_SAMPLE, is_numeric_kind, looks_like_money, value_class
from ..functions.dates import looks_like_date, parse_date
from ..functions.numbers import FORMAT_EVIDENCE, core_evidence, decide_format, format_evidence, number_core, parse_number
from ..functions.text import CUR, WS, js_trim
from .grid import KEY, attach, dense_grid, join_null_safe, to_cells

TYPES = ("categorical", "numeric", "money", "rate", "date")
# Fixed value: the share of a kind that settles a column's type.
SHARE = 0.7

# Header words that settle a type.
MONEY_WORDS = (
    "price", "cost", "amount", "salary", "wage", "revenue", "budget", "expense", "payment", "fee",
    "bill", "total", "subtotal", "tax", "discount", "refund", "balance", "debt", "income", "profit",
    "loss", "monto", "importe", "pago", "cargo", "cargos", "valor", "precio", "abono", "saldo",
    "deposito", "retiro",
)
PERCENT_WORDS = (
    "percent", "percentage", "rate", "ratio", "proportion", "share", "growth", "change", "increase",
    "decrease", "margin", "roi", "apy", "apr", "tax rate", "interest", "%",
)
DATE_WORDS = (
    "date", "time", "created", "updated", "modified", "birth", "start", "end", "deadline", "due",
    "expiry", "timestamp", "when", "day", "month", "year", "fecha", "creado", "actualizado",
)
NUMERIC_WORDS = (
    "count", "sum", "avg", "average", "number", "value", "score", "quantity", "size", "weight",
    "height", "width", "length", "volume", "area", "distance", "speed", "temperature",
)


def canonical_type(name: str) -> str:
    return "rate" if name == "percentage" else name


def _class_of(trimmed: Column, row: Column) -> Column:
    return F.when((row > 0) & (trimmed != ""), value_class(trimmed))


def _core_of(v: Column, cls: Column, row: Column, sample_rows: int | None = None) -> Column:
    """The number core of a value that tells a format; one without a comma or a dot tells none."""
    sample = cls.isNotNull() & (v.contains(",") | v.contains(".")) & v.rlike("[0-9]")
    if sample_rows is not None:
        sample = sample & (row <= sample_rows)
    return F.when(sample, number_core(v))


def _measures(v: Column, cls: Column, core: Column) -> dict[str, Column]:
    """Aggregates that decide type and format, from the trimmed value, its class and its number core."""
    odd = F.when(cls != "n", F.xxhash64(v))  # numbers keep the aggregate in a hash table
    out = {
        "n_values": F.count(cls),
        "n_num": F.count_if(cls == "n"),
        "n_rate": F.count_if(cls == "r"),
        "n_money": F.count_if(cls == "m"),
        "n_date": F.count_if(cls == "d"),
        "odd_lo": F.min(odd),
        "odd_hi": F.max(odd),
    }
    for name, hit in core_evidence(core).items():
        out[name] = F.count_if(hit)
    return out


def _decide_type() -> Column:
    n, num, rate, money, date = (
        F.col(c) for c in ("n_values", "n_num", "n_rate", "n_money", "n_date")
    )
    one_odd = (num > 0) & (F.col("odd_lo") == F.col("odd_hi"))
    return (
        F.when(n == 0, F.lit("categorical"))
        .when(rate == n, F.lit("rate"))
        .when((num + money == n) & (money > 0), F.lit("money"))
        .when(num == n, F.lit("numeric"))
        .when(one_odd, F.lit("numeric"))
        .when(date == n, F.lit("date"))
        .otherwise(F.lit("categorical"))
    )


def _decide_format(type_: Column) -> Column:
    return F.when(is_numeric_kind(type_), decide_format(*[F.col(n) for n in FORMAT_EVIDENCE]))


def _pin(profile: DataFrame, overrides: DataFrame, on: list[str]) -> DataFrame:
    """Let caller-pinned types and separators win; equal separators are made distinct."""
    pins = overrides.select(
        *on,
        F.col("type").alias("_type"),
        F.col("thousand").alias("_thousand"),
        F.col("decimal").alias("_decimal"),
    )
    joined = join_null_safe(profile, pins, on, "left")
    type_ = F.coalesce(
        F.when(F.col("_type") == "percentage", F.lit("rate")).otherwise(F.col("_type")), F.col("type")
    )
    dec = F.coalesce("_decimal", F.col("fmt.decimal"), F.lit("."))
    th = F.coalesce("_thousand", F.col("fmt.thousand"), F.lit(","))
    th = F.when(th == dec, F.when(dec == ".", F.lit(",")).otherwise(F.lit("."))).otherwise(th)
    fmt = F.when(is_numeric_kind(type_), F.struct(th.alias("thousand"), dec.alias("decimal")))
    return (
        joined.withColumn("fmt", fmt).withColumn("type", type_).drop("_type", "_thousand", "_decimal")
    )


def _headers(grid: DataFrame) -> DataFrame:
    """``KEY, col_idx, header`` from the header rows alone."""
    names = to_cells(grid.where(F.col("row_idx") == 0))
    return names.select(*KEY, "col_idx", F.coalesce("value", F.lit("")).alias("header"))


def column_evidence(grid: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """What types and formats are decided from: counts and extremes by column, which add up over parts of a table.

    ``KEY, col_idx``, the header where the part holds the header row, the counts, and ``last_row``.
    """
    row = F.col("row_idx")
    measures = _measures(F.col("_v"), F.col("_cls"), F.col("_core"))
    stats = (
        to_cells(grid.where(row > 0))
        .withColumn("_v", js_trim(F.col("value")))
        .withColumn("_cls", _class_of(F.col("_v"), row))
        .withColumn("_core", _core_of(F.col("_v"), F.col("_cls"), row, sample_rows))
        .groupBy(*KEY, "col_idx")
        .agg(F.max(row).alias("last_row"), *[m.alias(name) for name, m in measures.items()])
    )
    counts = [c for c in stats.columns if c not in (*KEY, "col_idx")]
    bare = _headers(grid).select(
        *KEY, "col_idx", "header", *(F.lit(None).cast(stats.schema[c].dataType).alias(c) for c in counts)
    )
    body = stats.select(*KEY, "col_idx", F.lit(None).cast("string").alias("header"), *counts)
    return merge_evidence(bare, body)


def merge_evidence(*parts: DataFrame) -> DataFrame:
    """The evidence of all parts together: counts add, extremes stay; the order of parts does not matter."""
    every = reduce(DataFrame.unionByName, parts)
    merged = []
    for c in every.columns:
        if c not in (*KEY, "col_idx"):
            add = F.min if c in ("odd_lo", "header") else F.max if c in ("odd_hi", "last_row") else F.sum
            merged.append(add(c).alias(c))
    return every.groupBy(*KEY, "col_idx").agg(*merged)


def decide_profile(evidence: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``profile`` of every column with a header and at least one body row; ``overrides`` as in :func:`infer_types`."""
    profile = (
        evidence.where(F.col("header").isNotNull() & F.col("last_row").isNotNull())
        .withColumn("type", _decide_type())
        .withColumn("fmt", _decide_format(F.col("type")))
        .select(*KEY, "col_idx", "header", "type", "fmt", "n_values", "last_row")
    )
    return _pin(profile, overrides, [*KEY, "col_idx"]) if overrides is not None else profile


def infer_types(
    grid: DataFrame, overrides: DataFrame | None = None, sample_rows: int | None = None
) -> DataFrame:
    """``profile``: one row per column of every table with at least one body row.

    Number formats are read from all rows, or from the first ``sample_rows`` if asked for.

    ``overrides`` pins columns: KEY, col_idx, type, thousand, decimal (null = keep).
    """
    return decide_profile(column_evidence(grid, sample_rows), overrides)


def _facts(c: Column) -> Column:
    """What parsing needs to know of a column, settled once per table and not in every cell."""
    return F.struct(
        c["col_idx"].alias("col_idx"),
        is_numeric_kind(c["type"]).alias("numeric"),
        (c["type"] == "date").alias("date"),
        F.coalesce(c["decimal"], F.lit(".")).alias("mark"),
    )


def attach_profile(grid: DataFrame, profile: DataFrame, parsing: bool = False) -> DataFrame:
    """Body rows with ``cols``: per column header, type and decimal separator; or, for ``parsing``, :func:`_facts`.

    The column facts travel as one array per table (as wide as a row), so rows are
    joined once and never exploded for it.
    """
    cols = F.sort_array(F.collect_list(F.struct("col_idx", "header", "type", F.col("fmt.decimal").alias("decimal"))))
    facts = profile.groupBy(*KEY).agg(cols.alias("cols"), F.max("last_row").alias("last_row"))
    if parsing:
        facts = facts.withColumn("cols", F.transform("cols", _facts))
    body = dense_grid(grid).where(F.col("row_idx") > 0).select(*KEY, "row_idx", "cells")
    return attach(body, facts)


def typed_rows(
    grid: DataFrame, profile: DataFrame, on_bad: str = "zero", dayfirst: bool = True
) -> DataFrame:
    """Body rows with ``nums`` and ``dts``, the typed value of each column (else null)."""
    rows = attach_profile(grid, profile, parsing=True)

    def number(c: Column, value: Column) -> Column:
        return F.when(c["numeric"], parse_number(value, c["mark"], on_bad))

    def day(c: Column, value: Column) -> Column:
        return F.when(c["date"], parse_date(value, dayfirst))

    rows = rows.withColumn("_values", F.transform("cols", lambda c: F.get("cells", c["col_idx"])))
    return rows.select(
        *KEY,
        "row_idx",
        "cells",
        F.zip_with("cols", "_values", number).alias("nums"),
        F.zip_with("cols", "_values", day).alias("dts"),
    )


def typed_cells(
    grid: DataFrame, profile: DataFrame, on_bad: str = "zero", dayfirst: bool = True
) -> DataFrame:
    """Body cells with header, type, decimal separator and the typed value (num or dt)."""
    # the header's columns come first in every row, so cells and columns line up by position
    pairs = F.arrays_zip(F.col("cols").alias("c"), F.col("cells").alias("value"))
    cells = (
        attach_profile(grid, profile)
        .select(*KEY, "row_idx", F.inline(pairs))
        .where(F.col("c").isNotNull())
        .select(*KEY, "row_idx", "c.col_idx", "c.header", "c.type", "c.decimal", "value")
    )
    decimal = F.coalesce("decimal", F.lit("."))
    return cells.withColumn(
        "num", F.when(is_numeric_kind(F.col("type")), parse_number("value", decimal, on_bad))
    ).withColumn("dt", F.when(F.col("type") == "date", parse_date("value", dayfirst)))


def detect_column_types(grid: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Header-aware guess: a share above 0.7 of the values, or a header word.

    All rows count, or the first ``sample_rows`` if asked for.
    """
    value, row, v = F.col("value"), F.col("row_idx"), F.col("_v")
    if sample_rows is not None:
        grid = grid.where(row <= sample_rows)
    bare = F.regexp_replace(v, f"[{CUR}{WS}]", "")
    kind = F.when(
        v != "",
        F.when(looks_like_money(v), F.lit("money"))
        .when(v.rlike(PERCENT_SAMPLE), F.lit("percentage"))
        .when(looks_like_date(v), F.lit("date"))
        .when(bare.rlike(r"^[+-]?[0-9][0-9.,]*\z"), F.lit("numeric"))
        .otherwise(F.lit("other")),
    )
    cells = (
        to_cells(grid.where(row > 0))
        .withColumn("_v", js_trim(value))
        .withColumn("_kind", kind)
    )
    kind = F.col("_kind")
    used = kind.isin("money", "percentage", "numeric")
    counted = {"_total": F.count("*")}
    counted |= {f"_{k}": F.count_if(kind == k) for k in ("money", "percentage", "date", "numeric")}
    counted |= {n: F.count_if(used & hit) for n, hit in format_evidence(v).items()}
    counts = cells.groupBy(*KEY, "col_idx").agg(*(c.alias(n) for n, c in counted.items()))
    agg = join_null_safe(_headers(grid), counts, [*KEY, "col_idx"], "left").fillna(0, list(counted))
    agg = agg.withColumn("_total", F.greatest("_total", F.lit(1)))
    name = F.lower("header")

    def wins(kind_name: str, words: tuple[str, ...]) -> Column:
        return (F.col(f"_{kind_name}") / F.col("_total") > SHARE) | name.rlike("|".join(words))

    type_ = (
        F.when(wins("money", MONEY_WORDS), F.lit("money"))
        .when(wins("percentage", PERCENT_WORDS), F.lit("percentage"))
        .when(wins("date", DATE_WORDS), F.lit("date"))
        .when(wins("numeric", NUMERIC_WORDS), F.lit("numeric"))
        .otherwise(F.lit("categorical"))
    )
    return (
        agg.withColumn("type", type_)
        .withColumn("fmt", _decide_format(F.col("type")))
        .select(*KEY, "col_idx", "header", "type", "fmt")
    )


# ---------------------------------------------------------------- wide tier


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    type: str
    thousand: str | None = None
    decimal: str | None = None

    @property
    def is_numeric(self) -> bool:
        return canonical_type(self.type) in ("numeric", "money", "rate")


def profile_wide(
    df: DataFrame, columns: list[str], row: str = "row_idx", overrides: dict[str, dict] | None = None
) -> DataFrame:
    """Types and formats of a wide table: one aggregate, one pass, one row per column."""
    at = F.col(row)
    texts = df.select(
        at, *[js_trim(F.col(c).cast("string")).alias(f"_v{i}") for i, c in enumerate(columns)]
    )
    classed = texts.select(
        "*", *[_class_of(F.col(f"_v{i}"), at).alias(f"_c{i}") for i in range(len(columns))]
    )
    classed = classed.select(
        "*", *[_core_of(F.col(f"_v{i}"), F.col(f"_c{i}"), at).alias(f"_n{i}") for i in range(len(columns))]
    )
    entries = []
    for i, name in enumerate(columns):
        measures = _measures(F.col(f"_v{i}"), F.col(f"_c{i}"), F.col(f"_n{i}"))
        entries.append(
            F.struct(
                F.lit(i).alias("col_idx"),
                F.lit(name).alias("header"),
                *[m.alias(k) for k, m in measures.items()],
            )
        )
    rows = classed.agg(F.array(*entries).alias("_all")).select(F.inline("_all"))
    profile = (
        rows.withColumn("type", _decide_type())
        .withColumn("fmt", _decide_format(F.col("type")))
        .select("col_idx", "header", "type", "fmt", "n_values")
    )
    if not overrides:
        return profile
    pins = df.sparkSession.createDataFrame(
        [(h, o.get("type"), o.get("thousand"), o.get("decimal")) for h, o in overrides.items()],
        "header string, type string, thousand string, decimal string",
    )
    return _pin(profile, pins, ["header"]).select("col_idx", "header", "type", "fmt", "n_values")


def learn_profile(
    df: DataFrame, columns: list[str], row: str = "row_idx", overrides: dict[str, dict] | None = None
) -> dict[str, ColumnProfile]:
    """Run :func:`profile_wide` and keep its rows (one per column) as literals for later plans."""
    found = profile_wide(df, columns, row, overrides).collect()
    return {
        r["header"]: ColumnProfile(
            r["header"],
            r["type"],
            r["fmt"]["thousand"] if r["fmt"] else None,
            r["fmt"]["decimal"] if r["fmt"] else None,
        )
        for r in found
    }
