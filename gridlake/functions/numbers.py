"""Reading and writing numbers as people type them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CUR, CURRENCY, WHITE_SPACE, WS, col, js_trim


def parse_number(value: Column | str, decimal: Column | str = ".", on_bad: str = "zero") -> Column:
    """Typed value of a numeric text.

    Only the decimal separator matters: the last one splits the number and every
    other non-digit is dropped.  Blank or digit-free text gives 0 (``on_bad='zero'``)
    or null (``on_bad='null'``).  ``decimal`` is a literal or a Column.
    """
    if on_bad not in ("zero", "null"):
        raise ValueError("on_bad must be 'zero' or 'null'")
    text = F.coalesce(col(value), F.lit(""))

    def digits(sep: str) -> Column:
        # drop everything but digits and the last separator: one regex per value
        return F.regexp_replace(text, f"[^0-9{sep}]|[{sep}](?=[^{sep}]*[{sep}])", "")

    comma = F.translate(digits(","), ",", ".")
    if isinstance(decimal, str):
        plain = comma if decimal == "," else digits(".")
    else:
        plain = F.when(decimal == ",", comma).otherwise(digits("."))
    size = plain.try_cast("double")
    minus = text.contains("-") & text.rlike(f"^[{WS}{CUR}%]*-")
    signed = F.when(minus, size * -1.0 + 0.0).otherwise(size)
    # nothing to drop from digits alone
    number = F.when(text.rlike(r"^[0-9]+\z"), text.try_cast("double")).otherwise(signed)
    return number if on_bad == "null" else F.coalesce(number, F.lit(0.0))


def format_number(
    value: Column | str, thousand: Column | str = ",", decimal: Column | str = ".", decimals: int = 0
) -> Column:
    """Fixed decimals (ties away from zero), digits grouped by three; null and NaN give ``0``."""
    v = col(value).cast("double")
    size = F.abs(v)
    # The formatter rounds exact ties to even; an exact tie is an odd multiple of
    # 2^-(decimals+1), so push those a quarter unit outwards first.
    scaled = size * float(2 ** (decimals + 1))
    tie = (scaled == F.floor(scaled)) & (F.pmod(scaled, F.lit(2.0)) == 1.0)
    digits = F.format_number(F.when(tie, size + 0.25 * 10.0**-decimals).otherwise(size), decimals)
    signed = F.when(v < 0, F.concat(F.lit("-"), digits)).otherwise(digits)
    th = F.lit(thousand) if isinstance(thousand, str) else thousand
    de = F.lit(decimal) if isinstance(decimal, str) else decimal
    out = F.call_function("translate", signed, F.lit(".,"), F.concat(de, th))
    return F.when(v.isNull() | F.isnan(v), F.lit("0")).otherwise(out)


def number_core(value: Column | str) -> Column:
    """The text without white space, currency marks and percent sign, for format evidence."""
    return F.translate(col(value), WHITE_SPACE + CURRENCY + "%", "")


# Evidence name and the pattern counted over number cores.
FORMAT_EVIDENCE = {
    "comma_dec": r",\d{2}\z",
    "dot_dec": r"\.\d{2}\z",
    "dot_group": r"\d\.\d{3}(?:[.,]|\z)",
    "comma_group": r"\d,\d{3}(?:[.,]|\z)",
}


def decide_format(comma_dec: Column, dot_dec: Column, dot_group: Column, comma_group: Column) -> Column:
    """STRUCT<thousand, decimal> from the four evidence counts."""
    by_dec = F.when(comma_dec > dot_dec, F.lit(",")).otherwise(F.lit("."))
    opposite = F.when(by_dec == ".", F.lit(",")).otherwise(F.lit("."))
    grouped = (
        F.when((dot_group > 0) & (dot_group >= comma_group), F.lit("."))
        .when(comma_group > 0, F.lit(","))
        .otherwise(opposite)
    )
    with_dec = F.struct(
        F.when(grouped == by_dec, opposite).otherwise(grouped).alias("thousand"),
        by_dec.alias("decimal"),
    )
    only_dots = (dot_group > 0) & (comma_group == 0)
    without = F.struct(
        F.when(only_dots, F.lit(".")).otherwise(F.lit(",")).alias("thousand"),
        F.when(only_dots, F.lit(",")).otherwise(F.lit(".")).alias("decimal"),
    )
    return F.when(comma_dec + dot_dec > 0, with_dec).otherwise(without)


def core_evidence(core: Column) -> dict[str, Column]:
    """Boolean Columns, one per evidence kind, for a :func:`number_core`; only a core that holds the mark meets the pattern."""
    return {name: core.contains("," if name.startswith("comma") else ".") & core.rlike(pattern) for name, pattern in FORMAT_EVIDENCE.items()}


def format_evidence(value: Column) -> dict[str, Column]:
    """Boolean Columns, one per evidence kind, for one trimmed sample value."""
    return core_evidence(number_core(value))


__all__ = [
    "parse_number",
    "format_number",
    "number_core",
    "decide_format",
    "core_evidence",
    "format_evidence",
    "FORMAT_EVIDENCE",
    "js_trim",
]
