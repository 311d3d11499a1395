"""Column statistics, per column of every table or of one wide table.

Everything is built from combinable aggregates.  ``mode`` and ``unique`` count values
first, so one hot column or one hot value is reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import is_numeric_kind
from ..functions.numbers import format_number
from .grid import KEY, join_null_safe

NUMERIC_STATS = ("count", "sum", "avg", "min", "max", "std")
DATE_STATS = ("count", "earliest", "latest", "range")
TEXT_STATS = ("count",)
VALUE_STATS = ("unique", "mode")
ALL_STATS = tuple(dict.fromkeys(NUMERIC_STATS + DATE_STATS + VALUE_STATS))


def _present(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def value_modes(cells: DataFrame, by: list[str], row: str = "row_idx") -> DataFrame:
    """Distinct values, mode and number of other tied modes per group.

    Ties: integer-like texts first in numeric order, then the value seen first.
    """
    counts = (
        cells.where(_present(F.col("value")))
        .groupBy(*by, "value")
        .agg(F.count("*").alias("_n"), F.min(row).alias("_first"))
    )
    as_int = F.when(
        F.col("value").rlike(r"^(?:0|[1-9][0-9]{0,9})\z"), F.col("value").try_cast("bigint")
    )
    index = F.when(as_int < 4294967295, as_int)
    order = F.struct(
        F.when(index.isNull(), F.lit(1)).otherwise(F.lit(0)),
        F.coalesce(index, F.lit(0)),
        F.col("_first"),
        F.col("value"),
    )
    tied = counts.groupBy(*by, "_n").agg(
        F.count("*").alias("_k"), F.min_by("value", order).alias("_best")
    )
    return tied.groupBy(*by).agg(
        F.sum("_k").alias("unique"),
        F.max_by("_best", "_n").alias("mode"),
        (F.max_by("_k", "_n") - 1).cast("int").alias("mode_extra"),
    )


def _basics() -> dict[str, Column]:
    there = _present(F.col("value"))
    num = F.when(there, F.col("num"))
    dt = F.when(there, F.col("dt"))
    return {
        "n_values": F.count_if(there),
        "n_num": F.count(num),
        "sum": F.sum(num),
        "avg": F.avg(num),
        "min": F.min(num),
        "max": F.max(num),
        "std": F.stddev_pop(num),
        "n_dates": F.count(dt),
        "earliest": F.min(dt),
        "latest": F.max(dt),
    }


def _entry(stat: str, num=None, date=None, text=None, extra=None) -> Column:
    def typed(value, kind):
        return (F.lit(None) if value is None else value).cast(kind)

    return F.struct(
        F.lit(stat).alias("stat"),
        typed(num, "double").alias("num_value"),
        typed(date, "date").alias("date_value"),
        typed(text, "string").alias("text_value"),
        typed(extra, "int").alias("extra"),
    )


def _entries(stat: str, numeric: Column, date: Column) -> Column:
    """The value of one stat for a column of any type; an unknown pairing gives 0."""
    zero = _entry(stat, num=F.lit(0))
    n_num = F.col("n_num")
    if stat == "count":
        return _entry(
            stat,
            num=F.when(numeric, n_num).when(date, F.col("n_dates")).otherwise(F.col("n_values")),
        )
    if stat in ("sum", "avg", "min", "max"):
        value = _entry(stat, num=F.coalesce(F.col(stat), F.lit(0.0)))
        return F.when(numeric, value).otherwise(zero)
    if stat == "std":
        value = _entry(stat, num=F.when(n_num < 2, F.lit(0.0)).otherwise(F.col("std")))
        return F.when(numeric, value).otherwise(zero)
    if stat in ("earliest", "latest"):
        return F.when(date, _entry(stat, date=F.col(stat))).otherwise(zero)
    if stat == "range":
        days = F.datediff("latest", "earliest")
        value = F.when(F.col("n_dates") >= 2, days).when(F.col("n_dates") == 1, F.lit(0))
        return F.when(date, _entry(stat, num=value)).otherwise(zero)
    if stat == "unique":
        return _entry(stat, num=F.coalesce("unique", F.lit(0)))
    if stat == "mode":
        return _entry(
            stat, text=F.coalesce("mode", F.lit("N/A")), extra=F.coalesce("mode_extra", F.lit(0))
        )
    return zero


def stats_for(type_: Column) -> Column:
    """Stat names offered for a type."""
    number = F.array(*[F.lit(s) for s in NUMERIC_STATS + VALUE_STATS])
    date = F.array(*[F.lit(s) for s in DATE_STATS + VALUE_STATS])
    text = F.array(*[F.lit(s) for s in TEXT_STATS + VALUE_STATS])
    return F.when(is_numeric_kind(type_), number).when(type_ == "date", date).otherwise(text)


def default_stat(type_: Column) -> Column:
    return F.when(type_.isin("rate", "percentage"), F.lit("avg")).otherwise(F.lit("count"))


def pinned_stat(type_name: str) -> str:
    """The stat a column shows once a reader has set its type."""
    return {"money": "sum", "numeric": "sum", "rate": "avg", "percentage": "avg"}.get(type_name, "count")


def column_stats(
    typed: DataFrame,
    stats: tuple[str, ...] | None = None,
    by: list[str] | None = None,
    chosen: Column | None = None,
) -> DataFrame:
    """Long stats table over typed cells (value, type, num, dt).

    Without ``chosen`` every stat that suits the column's type (limited to ``stats``)
    gets a row; with it, one row per column holding the chosen stat.
    """
    by = by or [*KEY, "col_idx"]
    names = stats or ALL_STATS
    facts = [c for c in ("header", "type") if c not in by]  # they belong to the column
    base = typed.groupBy(*by, *facts).agg(*[m.alias(n) for n, m in _basics().items()])
    if any(s in VALUE_STATS for s in names):
        # values are counted only for columns that show such a stat
        counted = typed if chosen is None else typed.where(chosen.isin(*VALUE_STATS))
        base = join_null_safe(base, value_modes(counted, by), by, "left")
    numeric, date = is_numeric_kind(F.col("type")), F.col("type") == "date"
    entries = F.array(*[_entries(s, numeric, date) for s in names])
    long = base.select(*by, "header", "type", "n_values", F.explode(entries).alias("_s"))
    wanted = (
        F.col("_s.stat") == chosen
        if chosen is not None
        else F.array_contains(stats_for(F.col("type")), F.col("_s.stat"))
    )
    return long.where(wanted).select(*by, "header", "type", "n_values", "_s.*")


def stats_panel(typed: DataFrame, choice: dict[int, str] | None = None) -> DataFrame:
    """One stat per column: the caller's choice, else avg for rates and count otherwise."""
    chosen = default_stat(F.col("type"))
    for index, stat in (choice or {}).items():
        chosen = F.when(F.col("col_idx") == index, F.lit(stat)).otherwise(chosen)
    return column_stats(typed, chosen=chosen)


def display(
    stats: DataFrame, thousand: str = "thousand", decimal: str = "decimal", dates: str = "M/d/yyyy"
) -> DataFrame:
    """Adds ``shown``, the text a reader sees; needs the column's separators beside the stats."""
    num, stat, type_ = F.col("num_value"), F.col("stat"), F.col("type")
    th, dec = F.coalesce(F.col(thousand), F.lit(",")), F.coalesce(F.col(decimal), F.lit("."))
    numeric = is_numeric_kind(type_)

    def number(decimals: int) -> Column:
        text = format_number(num, th, dec, decimals)
        return (
            F.when(type_ == "money", F.concat(F.lit("$ "), text))
            .when(
                type_.isin("rate", "percentage"),
                F.concat(format_number(num, "", ".", 2), F.lit("%")),
            )
            .otherwise(text)
        )

    extra = F.col("extra")
    shown = (
        F.when(F.col("n_values") == 0, F.lit("0"))
        .when(
            stat == "mode",
            F.concat(
                "text_value",
                F.when(extra > 0, F.concat(F.lit(" (+"), extra.cast("string"), F.lit(")"))).otherwise(""),
            ),
        )
        .when(stat.isin("count", "unique"), num.cast("bigint").cast("string"))
        .when(numeric & stat.isin("sum", "min", "max"), number(0))
        .when(numeric & stat.isin("avg", "std"), number(2))
        .when(
            stat.isin("earliest", "latest") & (type_ == "date"),
            F.coalesce(F.date_format("date_value", dates), F.lit("N/A")),
        )
        .when(
            (stat == "range") & (type_ == "date"),
            F.when(F.coalesce(num, F.lit(0.0)) == 0, F.lit("N/A")).otherwise(
                F.concat(num.cast("bigint").cast("string"), F.lit(" days"))
            ),
        )
        .otherwise(F.lit("0"))
    )
    return stats.withColumn("shown", shown)


def wide_typed(df: DataFrame, profile: dict, row: str = "row_idx", on_bad: str = "zero", dayfirst: bool = True) -> DataFrame:
    """A wide table as typed cells (col_idx, header, type, value, num, dt), formats as literals."""
    from ..functions.dates import parse_date
    from ..functions.numbers import parse_number

    entries = []
    for i, (name, p) in enumerate(profile.items()):
        text = F.col(name).cast("string")
        num = parse_number(text, p.decimal or ".", on_bad) if p.is_numeric else F.lit(None).cast("double")
        dt = parse_date(text, dayfirst) if p.type == "date" else F.lit(None).cast("date")
        entries.append(
            F.struct(
                F.lit(i).alias("col_idx"),
                F.lit(name).alias("header"),
                F.lit(p.type).alias("type"),
                text.alias("value"),
                num.alias("num"),
                dt.alias("dt"),
            )
        )
    return df.select(row, F.inline(F.array(*entries)))


def wide_stats(
    df: DataFrame, profile: dict, choice: dict[str, str] | None = None, row: str = "row_idx"
) -> DataFrame:
    """Stats of a wide table in one pass with N x M aggregates and no explode.

    With ``choice`` only the chosen stat of each column is computed.  ``mode`` and
    ``unique`` need value counts and take the long route for their columns only.
    """
    panel = choice is not None
    asked = {
        name: [choice.get(name, "avg" if p.type in ("rate", "percentage") else "count")]
        if panel
        else list(
            (NUMERIC_STATS if p.is_numeric else DATE_STATS if p.type == "date" else TEXT_STATS)
            + VALUE_STATS
        )
        for name, p in profile.items()
    }
    from ..functions.dates import parse_date
    from ..functions.numbers import parse_number

    values = []
    for i, (name, p) in enumerate(profile.items()):
        text = F.col(name).cast("string")
        there = _present(text)
        num = parse_number(text, p.decimal or ".") if p.is_numeric else F.lit(None).cast("double")
        dt = parse_date(text) if p.type == "date" else F.lit(None).cast("date")
        values.append(
            F.when(there, F.struct(F.lit(True).alias("there"), num.alias("num"), dt.alias("dt"))).alias(f"_x{i}")
        )
    parsed = df.select(*values)
    rows = []
    for i, (name, p) in enumerate(profile.items()):
        x = F.col(f"_x{i}")
        rows.append(
            F.struct(
                F.lit(i).alias("col_idx"),
                F.lit(name).alias("header"),
                F.lit(p.type).alias("type"),
                F.count(x).alias("n_values"),
                F.count(x["num"]).alias("n_num"),
                F.sum(x["num"]).alias("sum"),
                F.avg(x["num"]).alias("avg"),
                F.min(x["num"]).alias("min"),
                F.max(x["num"]).alias("max"),
                F.stddev_pop(x["num"]).alias("std"),
                F.count(x["dt"]).alias("n_dates"),
                F.min(x["dt"]).alias("earliest"),
                F.max(x["dt"]).alias("latest"),
            )
        )
    base = parsed.agg(F.array(*rows).alias("_all")).select(F.inline("_all"))
    by_value = [n for n, s in asked.items() if any(k in VALUE_STATS for k in s)]
    if by_value:
        sub = df.select(
            row,
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(n).alias("header"), F.col(n).cast("string").alias("value"))
                        for n in by_value
                    ]
                )
            ),
        )
        base = base.join(value_modes(sub, ["header"], row), "header", "left")
    else:
        base = base.withColumns(
            {
                "unique": F.lit(None).cast("bigint"),
                "mode": F.lit(None).cast("string"),
                "mode_extra": F.lit(None).cast("int"),
            }
        )
    numeric, date = is_numeric_kind(F.col("type")), F.col("type") == "date"
    wanted = F.lit(None)
    for name, s in asked.items():
        wanted = F.when(F.col("header") == name, F.array(*[F.lit(k) for k in s])).otherwise(wanted)
    used = tuple(dict.fromkeys(k for s in asked.values() for k in s))
    entries = F.array(*[_entries(s, numeric, date) for s in used])
    return (
        base.select("col_idx", "header", "type", "n_values", wanted.alias("_w"), F.explode(entries).alias("_s"))
        .where(F.array_contains("_w", F.col("_s.stat")))
        .select("col_idx", "header", "type", "n_values", "_s.*")
    )
