"""Replayable views: a small specification turned into one lazy plan.

``WideTable`` is a table with named columns and an explicit ``row_idx``; ``ViewSpec``
holds what a reader chose (types, formats, filters, sort, stats, series).  Applying a
spec composes filters, order, stats and series; nothing runs until a result is used.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE
from ..operators.charts import chart_series, scatter_points
from ..operators.export import line_of, rule_of, wide_lines
from ..operators.filters import filter_wide, is_active, trimmed
from ..operators.grid import KEY, number_rows
from ..operators.sorting import sort_order
from ..operators.stats import wide_stats
from ..operators.types import ColumnProfile, canonical_type, learn_profile


@dataclass
class ViewSpec:
    """Column order, types, formats, filters, sort, stat choices and series of one view."""

    columns: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    formats: dict[str, dict] = field(default_factory=dict)
    filters: dict[str, dict] = field(default_factory=dict)
    sort: dict | None = None
    stats: dict[str, str] = field(default_factory=dict)
    series: dict | None = None
    fingerprint: str | None = None

    def to_json(self) -> str:
        live = {k: trimmed(v) for k, v in self.filters.items() if is_active(v)}
        return json.dumps({**asdict(self), "filters": live}, ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> ViewSpec:
        return cls(**json.loads(text))


class View:
    """One applied spec.  Every result is its own lazy plan, built when it is asked for."""

    def __init__(self, df: DataFrame, spec: ViewSpec, profile: dict, row: str, date_order: str):
        self.source, self.spec, self.profile, self.row = df, spec, profile, row
        self.columns = list(profile)
        self.rows = filter_wide(df, spec.filters, profile)
        sort = spec.sort or {}
        name = sort.get("column")
        self.order: list[Column] = sort_order(
            name, sort.get("direction", "none"), profile.get(name), row, date_order
        )

    def sorted(self) -> DataFrame:
        return self.rows.orderBy(*self.order)

    def positioned(self) -> DataFrame:
        return number_rows(self.rows, self.order)

    @property
    def stats(self) -> DataFrame:
        """The chosen stat of each column over the filtered rows."""
        return wide_stats(self.rows, self.profile, choice=self.spec.stats, row=self.row)

    @property
    def series(self) -> DataFrame | None:
        """The chosen series; ``pos`` is a point's place in the view's order."""
        chosen = self.spec.series
        if not chosen:
            return None
        build = scatter_points if chosen.get("kind") == "scatter" else chart_series
        return build(self.positioned(), chosen["x"], chosen["ys"], self.profile, self.row, keep=("pos",))

    def lines(self, fmt: str) -> DataFrame:
        """``line_no, line`` of the view as text: header, Markdown's rule, rows in the view's order."""
        names = F.array(*(F.lit(c) for c in self.columns))
        head = [(0, line_of(names, fmt))] + ([(1, rule_of(names))] if fmt == "md" else [])
        one = self.source.sparkSession.range(1)
        heads = one.select(
            F.inline(F.array(*(F.struct(F.lit(n).cast("bigint").alias("line_no"), text.alias("line")) for n, text in head)))
        )
        return heads.unionByName(wide_lines(self.positioned(), self.columns, fmt, "pos"))

    @property
    def fingerprint(self) -> DataFrame:
        """The source's fingerprint and, when the spec has one, whether it ``matches``."""
        mark = wide_fingerprint(self.source, self.columns, self.row)
        if self.spec.fingerprint is None:
            return mark
        return mark.withColumn("matches", F.col("fingerprint") == self.spec.fingerprint)


def with_row_index(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Give a large table the explicit 1-based row order that the wide operators need."""
    return number_rows(df, [F.col(c) if isinstance(c, str) else c for c in order], "row_idx")


def open_table(grid: DataFrame, page_id, table_idx: int, kind: str = "html") -> DataFrame:
    """One grid table as a wide table; only its header row reaches the driver."""
    rows = grid.where(
        (F.col("page_id") == page_id) & (F.col("kind") == kind) & (F.col("table_idx") == table_idx)
    )
    header = rows.where(F.col("row_idx") == 0).select("cells").first()
    if header is None:
        raise ValueError("no such table")
    names: list[str] = []
    for i, cell in enumerate(header["cells"]):
        name = (cell or "").strip(WHITE_SPACE) or f"Column {i + 1}"
        names.append(name if name not in names and name != "row_idx" else f"{name} ({i + 1})")
    return rows.where(F.col("row_idx") > 0).select(
        "row_idx", *[F.get("cells", F.lit(i)).alias(f"{n}") for i, n in enumerate(names)]
    )


def wide_fingerprint(df: DataFrame, columns: list[str], row: str = "row_idx") -> DataFrame:
    """One-row fingerprint of a wide table: header, shape, first three cells."""
    first = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns[:3]])
    agg = df.agg(
        F.count("*").alias("n"), F.array_join(F.min_by(first, F.col(row)), "|").alias("head")
    )
    raw = F.concat(
        F.lit("|".join(columns) + "_"),
        F.col("n").cast("string"),
        F.lit(f"x{len(columns)}_"),
        F.coalesce("head", F.lit("")),
    )
    return agg.select(F.translate(raw, WHITE_SPACE, "").alias("fingerprint"))


def resolve_profile(df: DataFrame, spec: ViewSpec, columns: list[str], row: str) -> dict[str, ColumnProfile]:
    """Types from the spec where it has them all; otherwise one profiling pass fills the gaps."""
    if all(c in spec.types for c in columns):
        out = {}
        for c in columns:
            fmt = spec.formats.get(c) or {}
            p = ColumnProfile(c, canonical_type(spec.types[c]))
            dec = fmt.get("decimal") or "."
            th = fmt.get("thousand") or ","
            if th == dec:
                th = "," if dec == "." else "."
            out[c] = ColumnProfile(c, p.type, th, dec) if p.is_numeric else p
        return out
    pins = {
        c: {"type": spec.types.get(c), **(spec.formats.get(c) or {})}
        for c in columns
        if c in spec.types or c in spec.formats
    }
    return learn_profile(df, columns, row, pins or None)


def apply_view(
    df: DataFrame,
    spec: ViewSpec,
    profile: dict[str, ColumnProfile] | None = None,
    row: str = "row_idx",
    date_order: str = "text",
) -> View:
    """types -> filters -> sort -> stats and series, as one plan per result.

    A fingerprint that differs from the spec's is reported in ``view.fingerprint``
    (column ``matches``) and never stops the view.
    """
    columns = spec.columns or [c for c in df.columns if c != row]
    profile = profile or resolve_profile(df, spec, columns, row)
    return View(df, spec, {c: profile[c] for c in columns}, row, date_order)


__all__ = [
    "KEY", "View", "ViewSpec", "apply_view", "open_table", "resolve_profile", "wide_fingerprint",
    "with_row_index",
]
