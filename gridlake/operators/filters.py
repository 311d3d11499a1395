"""Typed filters as predicates; the same ones serve grids and wide tables."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.numbers import parse_number
from ..functions.text import WHITE_SPACE, has_text, js_trim

_FLOAT = re.compile(r"\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))")


def _bound(text) -> float | None:
    """Leading number of a typed-in bound; no number means no bound."""
    if text is None or text == "":
        return None
    m = _FLOAT.match(str(text))
    return float(m.group(1)) if m else None


def numeric_range(number: Column, low=None, high=None) -> Column:
    """Inclusive; either end may be missing."""
    lo, hi = _bound(low), _bound(high)
    if lo is not None and hi is not None:
        return number.between(lo, hi)
    if lo is not None:
        return number >= lo
    return number <= hi if hi is not None else F.lit(True)


def _day(text) -> Column | None:
    """A typed-in day (``yyyy-mm-dd``) as a literal; anything else is no bound."""
    if isinstance(text, dt.date):
        return F.lit(text)
    try:
        return F.lit(dt.date.fromisoformat(str(text).strip()[:10])) if text else None
    except ValueError:
        return None


def date_range(day: Column, start=None, end=None) -> Column:
    """Inclusive; values that are no date pass."""
    lo, hi = _day(start), _day(end)
    if lo is not None and hi is not None:
        test = day.between(lo, hi)
    elif lo is not None:
        test = day >= lo
    elif hi is not None:
        test = day <= hi
    else:
        return F.lit(True)
    return F.coalesce(test, F.lit(True))


def membership(value: Column, selected: list[str]) -> Column:
    return F.coalesce(js_trim(value), F.lit("")).isin(list(selected))


def contains_text(value: Column, text: str) -> Column:
    return F.lower(F.coalesce(js_trim(value), F.lit(""))).contains(text.lower())


def predicate(value: Column, spec: dict, decimal: Column | str = ".", dayfirst: bool = True) -> Column:
    """One saved column filter: ``{'type': numeric|date|categorical, ...}``."""
    kind = spec.get("type")
    if kind == "numeric":
        return numeric_range(parse_number(value, decimal), spec.get("min"), spec.get("max"))
    if kind == "date":
        return date_range(parse_date(value, dayfirst), spec.get("from"), spec.get("to"))
    test = F.lit(True)
    if kind == "categorical":
        if spec.get("selected"):
            test = test & membership(value, spec["selected"])
        if _given(spec.get("text")):
            test = test & contains_text(value, trimmed(spec)["text"])
    return test


def _given(value) -> bool:
    """Whether a filter's entry says anything; the number 0 does, blank text does not."""
    if isinstance(value, str):
        return value.strip(WHITE_SPACE) != ""
    return value is not None and value != [] and value != ()


def is_active(spec: dict) -> bool:
    """Empty filters are dropped before they reach a plan."""
    keys = {"numeric": ("min", "max"), "date": ("from", "to"), "categorical": ("selected", "text")}
    return any(_given(spec.get(k)) for k in keys.get(spec.get("type"), ()))


def trimmed(spec: dict) -> dict:
    """The filter as it is saved: text without white space around it."""
    return {k: v.strip(WHITE_SPACE) if k == "text" and isinstance(v, str) else v for k, v in spec.items()}


def filter_wide(
    df: DataFrame, filters: dict[str, dict], profile: dict | None = None, dayfirst: bool = True
) -> DataFrame:
    """All column filters together (AND); formats come from the profile as literals."""
    test = F.lit(True)
    for name, spec in filters.items():
        if is_active(spec):
            p = (profile or {}).get(name)
            decimal = p.decimal if p and p.decimal else "."
            test = test & predicate(F.col(name).cast("string"), spec, decimal, dayfirst)
    return df.where(test)


def filter_grid(
    grid: DataFrame, filters: dict[int, dict], decimals: dict[int, str] | None = None
) -> DataFrame:
    """The same on grid rows by column index; header rows stay."""
    test = F.lit(True)
    for index, spec in filters.items():
        if is_active(spec):
            value = F.get("cells", F.lit(index))
            test = test & predicate(value, spec, (decimals or {}).get(index, "."))
    return grid.where((F.col("row_idx") == 0) | test)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Trimmed, non-empty distinct values in code-unit order, without a cap."""
    value = F.col(column).cast("string")
    return (
        df.where(has_text(value)).select(js_trim(value).alias("value")).distinct().orderBy("value")
    )
