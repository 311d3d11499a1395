import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridlake.functions.classes import is_money, value_class
from gridlake.functions.dates import next_reset, parse_date
from gridlake.functions.numbers import format_number, parse_number
from gridlake.functions.text import has_text, js_trim, route, site_name, text_hash_base36


def run(spark, values, expr, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_trim_knows_unicode_spaces(spark):
    raw = ["﻿  a b 　\n", "\t\x0b\x0c", "x\x1c", None]
    assert run(spark, raw, js_trim) == ["a b", "", "x\x1c", None]
    assert run(spark, ["  ", "a", "", None], has_text) == [False, True, False, False]


@pytest.mark.parametrize(
    "text, dot, comma",
    [
        ("1,234.56", 1234.56, 1.23456),
        ("1.234,56", 1.23456, 1234.56),
        ("$ -994,28", -99428.0, -994.28),
        ("-$5", -5.0, -5.0),
        ("+7", 7.0, 7.0),
        ("12.", 12.0, 12.0),
        (".5", 0.5, 5.0),
        ("5%", 5.0, 5.0),
        ("1 234 567", 1234567.0, 1234567.0),
        ("1.2.3", 12.3, 123.0),
        ("N/A", 0.0, 0.0),
        ("a-5", 5.0, 5.0),
        ("R 12,5", 125.0, 12.5),
        ("", 0.0, 0.0),
        (None, 0.0, 0.0),
    ],
)
def test_parse_number(spark, text, dot, comma):
    assert run(spark, [text], lambda v: parse_number(v, ".")) == [dot]
    assert run(spark, [text], lambda v: parse_number(v, ",")) == [comma]
    assert run(spark, [text], lambda v: parse_number(v, F.lit(","))) == [comma]


def test_parse_number_null_mode(spark):
    got = run(spark, ["x", "", "0", "-"], lambda v: parse_number(v, on_bad="null"))
    assert got == [None, None, 0.0, None]
    with pytest.raises(ValueError):
        parse_number("v", on_bad="skip")


def test_format_number(spark):
    values = [2.5, -2.5, 0.5, 1234567.891, -123.0, -1234.0, 0.125, 1.005, None, float("nan")]
    assert run(spark, values, format_number, "double") == [
        "3", "-3", "1", "1,234,568", "-123", "-1,234", "0", "1", "0", "0",
    ]
    assert run(spark, values[3:8], lambda v: format_number(v, ".", ",", 2), "double") == [
        "1.234.567,89", "-123,00", "-1.234,00", "0,13", "1,00",
    ]
    assert run(spark, [1234.5], lambda v: format_number(v, "", ".", 2), "double") == ["1234.50"]


DATES = {
    "15/09/2025": dt.date(2025, 9, 15),
    "8-9-2025": dt.date(2025, 9, 8),
    "1/2/99": dt.date(1999, 2, 1),
    "1/2/07": dt.date(2007, 2, 1),
    "09/22/2023": None,
    "1/2/123": None,
    "2025-9-5": dt.date(2025, 9, 5),
    "2025/09/05": dt.date(2025, 9, 5),
    "2025-09-05T10:00:00Z": dt.date(2025, 9, 5),
    "2025-02-30": None,
    "2025-1": None,
    "Sep 5, 2025": dt.date(2025, 9, 5),
    "September 5 2025": dt.date(2025, 9, 5),
    "5 Sep 2025": dt.date(2025, 9, 5),
    "05-Sep-2025": dt.date(2025, 9, 5),
    "5 de Septiembre de 2025": dt.date(2025, 9, 5),
    "5 de foo de 2025": None,
    "March 2024": dt.date(2024, 3, 1),
    "Friday, September 5, 2025": dt.date(2025, 9, 5),
    "Fri, 05 Sep 2025": dt.date(2025, 9, 5),
    "N/A": None,
    "": None,
}


def test_parse_date(spark):
    assert run(spark, list(DATES), parse_date) == list(DATES.values())
    assert run(spark, ["09/22/2023", None], lambda v: parse_date(v, dayfirst=False)) == [
        dt.date(2023, 9, 22), None,
    ]


def test_value_classes(spark):
    cases = {
        "12": "n", "+1.234,5": "n", "1 000": "n", ".": "n", "5%": "r", "-1,5 %": "r", "5 % x": "o",
        "$5": "m", "$ -5": "m", "-$5": "o", "5€": "m", "R 10": "m", "10R": "m", "USD 5": "o",
        "15/09/2025": "d", "12-09-25": "d", "Sep 12, 2025 at noon": "d", "12-Sep-2025": "d",
        "12 de septiembre de 2025": "d", "March 2024": "d", "May": "o", "Product 1": "o",
    }
    assert run(spark, list(cases), value_class) == list(cases.values())


def test_is_money(spark):
    cases = {
        "12": True, "5": False, "$1,234.50": True, "1.234,50 €": True, "12 clp": True,
        "EUR 12,50": True, "12 xyz": False, "abc": False, "": False, "+1001.": False,
    }
    assert run(spark, list(cases), is_money) == list(cases.values())
    assert run(spark, [None], is_money) == [False]


def test_urls(spark):
    urls = {
        "http://www.foo.co.uk/x": "foo", "https://BAR.com:80/": "bar", "http://u:p@a.b.c/d": "a",
        "https://localhost": "localhost", "mailto:x": "webpage", "junk": "webpage", None: "webpage",
    }
    assert run(spark, list(urls), site_name) == list(urls.values())
    assert run(spark, ["http://a/x.pdf?y", "http://a/pdf"], route) == ["pdf", "web"]


def hash36(text):
    """The id hash over UTF-16 units, written independently."""
    h = 0
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h * 31 + units[i] * 256 + units[i + 1]) & 0xFFFFFFFF
    h = abs(h - (1 << 32) if h >= 1 << 31 else h)
    digits = ""
    while h or not digits:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return digits


def test_hash(spark):
    texts = ["", "A|B_2x2", "naïve 😀 header|x_10x2", "z" * 300]
    assert run(spark, texts, text_hash_base36) == [hash36(t) for t in texts]


def test_next_reset(spark):
    got = run(spark, ["2024-01-31", "2024-12-01"], lambda v: next_reset(v.cast("date")))
    assert got == [dt.date(2024, 2, 1), dt.date(2025, 1, 1)]
