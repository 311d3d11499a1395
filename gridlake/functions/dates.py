"""Calendar dates from text: one closed list of shapes, day first by default.

Accepted shapes: ``d/m/y`` and ``d-m-y`` (2- or 4-digit year), ``y-m-d`` and
``y/m/d`` (optionally followed by a clock time), ``Mon d, yyyy``, ``d Mon yyyy``,
``d-Mon-yyyy``, ``Mon yyyy``, ``d de mes de yyyy``; an English weekday may lead
the word shapes.  Anything else is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, col, js_trim, let

# Month and weekday names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
SPANISH_MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6,
    "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10,
    "noviembre": 11, "diciembre": 12,
}

_MON = "(?:" + "|".join(MONTHS) + ")"
_WEEKDAY = "(?:" + "|".join(WEEKDAYS) + f")[a-z]*,?[{WS}]+"
_S = f"[{WS}]+"

# The shapes that make a value "a date" for column typing, by first character.
DIGIT_FIRST = (
    r"(?i)^(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
    r"|\d{4}[/-]\d{1,2}[/-]\d{1,2}"
    rf"|\d{{1,2}}{_S}{_MON}[a-z]*{_S}\d{{4}}"
    r"|\d{1,2}-[a-z]{3}-\d{4}"
    rf"|\d{{1,2}}{_S}de{_S}[a-záéíóú]+{_S}de{_S}\d{{4}})\z"
)
LETTER_FIRST = (
    rf"(?i)^(?:(?:{_WEEKDAY})?{_MON}[a-z]*{_S}\d{{1,2}},?{_S}\d{{4}}"
    rf"|{_WEEKDAY}\d{{1,2}}{_S}{_MON}[a-z]*{_S}\d{{4}}"
    rf"|{_MON}[a-z]*\.?,?{_S}\d{{4}}\z)"
)


def looks_like_date(trimmed: Column) -> Column:
    """Column typing test on an already trimmed value."""
    digit = F.substring(trimmed, 1, 1).between("0", "9")
    return F.when(digit, trimmed.rlike(DIGIT_FIRST)).otherwise(
        trimmed.rlike(LETTER_FIRST)
    )


def _rewrite(text: Column, shapes: list[tuple[str, str]]) -> Column:
    for shape, order in shapes:
        text = F.regexp_replace(text, shape, order)
    return text


def _canonical(v: Column, dayfirst: bool) -> Column:
    """An accepted shape rewritten to ``year-month-day``; the month may still be a word.

    The branches are told apart by the first characters, so a value meets two to four
    patterns and not all of them.
    """
    dm = "$2-$1" if dayfirst else "$1-$2"
    numbers = r"^(\d{1,2})[/-](\d{1,2})[/-]"
    day_month = (
        rf"(?i)^(\d{{1,2}})(?:-({_MON})-|{_S}({_MON})[a-z]*{_S})(\d{{4}})\z", "$4-$2$3-$1",
    )
    spanish = (rf"(?i)^(\d{{1,2}}){_S}de{_S}([a-záéíóú]+){_S}de{_S}(\d{{4}})\z", "$3-$2-$1")
    return (
        F.when(
            v.rlike(r"^\d{1,2}[/-]\d"),
            _rewrite(
                v,
                [
                    (numbers + r"(\d{4})\z", f"$3-{dm}"),
                    (numbers + r"([0-4]\d)\z", f"20$3-{dm}"),
                    (numbers + r"([5-9]\d)\z", f"19$3-{dm}"),
                ],
            ),
        )
        .when(
            v.rlike(r"^\d{4}[/-]"),
            _rewrite(
                v,
                [(r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})(?:[T ]\d{1,2}:\d{2}.*)?\z", "$1-$2-$3")],
            ),
        )
        .when(v.rlike(r"^\d"), _rewrite(v, [day_month, spanish]))
        .otherwise(
            _rewrite(
                v,
                [
                    (rf"(?i)^{_WEEKDAY}(?={_MON}|\d)", ""),
                    day_month,
                    (rf"(?is)^({_MON})[a-z]*{_S}(\d{{1,2}}),?{_S}(\d{{4}}).*", "$3-$1-$2"),
                    (rf"(?i)^({_MON})[a-z]*\.?,?{_S}(\d{{4}})\z", "$2-$1-1"),
                ],
            )
        )
    )


def parse_date(value: Column | str, dayfirst: bool = True) -> Column:
    names = {**{m: i + 1 for i, m in enumerate(MONTHS)}, **SPANISH_MONTHS}
    numbers = F.create_map(*[F.lit(x) for n, i in names.items() for x in (n, str(i))])
    dash = F.lit("-")

    def assemble(c: Column) -> Column:
        month = F.lower(F.regexp_extract(c, r"^\d{4}-([^-]+)-\d{1,2}\z", 1))
        return F.concat(
            F.substring(c, 1, 4),
            dash,
            F.coalesce(F.try_element_at(numbers, month), month),
            dash,
            F.substring_index(c, "-", -1),
        ).try_cast("date")

    # the commonest shape needs no month name and no second look
    numbers_only = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})\z"
    ordered = "$3-$2-$1" if dayfirst else "$3-$1-$2"

    def parse(v: Column) -> Column:
        common = F.regexp_replace(v, numbers_only, ordered).try_cast("date")
        return F.when(v.rlike(numbers_only), common).otherwise(let(_canonical(v, dayfirst), assemble))

    return let(js_trim(col(value)), parse)


def next_reset(moment: Column | str) -> Column:
    """First day of the month after ``moment``."""
    return F.add_months(F.trunc(col(moment).cast("date"), "month"), 1)
