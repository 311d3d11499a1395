"""What kind of text a single value is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import looks_like_date
from .text import CUR, CURRENCY, WS, col, js_trim, let

# Currency codes accepted before or after an amount.
CODES = (
    "usd", "eur", "gbp", "jpy", "cad", "aud", "chf", "cny", "inr", "clp", "mxn", "ars", "cop", "brl",
    "dkk", "sek", "nok", "zar",
)

# The shapes of numbers, rates and amounts.
# Plain digits and marks are tried before the long list of white space.
_FIGURES = rf"(?=[0-9.,{WS}])[0-9.,]*+[0-9.,{WS}]*+"
NUMERIC = rf"^[+-]?{_FIGURES}\z"
RATE = rf"^[+-]?{_FIGURES}%\z"
MONEY = rf"^[{CUR}]?[{WS}]*[+-]?{_FIGURES}[{CUR}]?\z"
PERCENT_SAMPLE = rf"^[0-9]+\.?[0-9]*[{WS}]*%\z"

_AMOUNT = rf"[+-]?[0-9.{WS}]+(?:[,.][0-9]{{2}})?"
_CODE = "(?:" + "|".join(CODES) + ")"
MONEY_VALUE = [
    rf"^[{CUR}]?[{WS}]*[+-]?[0-9.{WS},]+[0-9](?:[,.][0-9]{{2}})?[{WS}]*[{CUR}]?\z",
    rf"(?i)^{_AMOUNT}[{WS}]*{_CODE}\z",
    rf"(?i)^{_CODE}[{WS}]+{_AMOUNT}\z",
]


def value_class(trimmed: Column) -> Column:
    """One of n(umeric) r(ate) m(oney) d(ate) o(ther) for a trimmed, non-empty value.

    The classes are disjoint, so column typing reduces to counting them:
    a money pattern without a currency mark is exactly the numeric pattern.  First and
    last characters are compared before a pattern is tried.
    """
    marks = list(CURRENCY)
    marked = F.substring(trimmed, 1, 1).isin(marks) | F.substring(trimmed, -1, 1).isin(marks)
    return (
        F.when(trimmed.rlike(NUMERIC), F.lit("n"))
        .when(trimmed.endswith("%") & trimmed.rlike(RATE), F.lit("r"))
        .when(marked & trimmed.rlike(MONEY), F.lit("m"))
        .when(looks_like_date(trimmed), F.lit("d"))
        .otherwise(F.lit("o"))
    )


def looks_like_money(trimmed: Column) -> Column:
    hit = trimmed.rlike(MONEY_VALUE[0])
    for pattern in MONEY_VALUE[1:]:
        hit = hit | trimmed.rlike(pattern)
    return hit


def is_money(value: Column | str) -> Column:
    return F.coalesce(let(js_trim(col(value)), looks_like_money), F.lit(False))


def is_numeric_kind(type_: Column) -> Column:
    return type_.isin("numeric", "money", "rate", "percentage")
