"""Text scalars shared by every operator.

White space here always means the Unicode set a browser trims (NBSP, BOM and
the typographic spaces included), because Spark's own ``trim`` and Java's
``\\s`` stop at ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a browser's trim() removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Currency marks, the letter R (rand, real) included.
CURRENCY = "$€£¥₽₹R"

#: the same white space as the inside of a regular-expression class
WS = (
    r"\t\n\x0B\f\r\x20\u00A0\u1680\u2000-\u200A"
    r"\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
CUR = r"$€£¥₽₹R"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside conditional branches."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def js_trim(value: Column | str) -> Column:
    return F.btrim(col(value), F.lit(WHITE_SPACE))


def has_text(value: Column | str) -> Column:
    """True when the cell holds anything but white space; null counts as empty."""
    return F.coalesce(col(value).rlike(f"[^{WS}]"), F.lit(False))


def squeeze_out_spaces(value: Column | str) -> Column:
    return F.regexp_replace(col(value), f"[{WS}]+", "")


def site_name(url: Column | str) -> Column:
    """First label of the host without ``www.``; ``webpage`` when there is none."""
    host = F.lower(
        F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)
    )
    label = F.substring_index(F.regexp_replace(host, r"^www\.", ""), ".", 1)
    return F.when(F.coalesce(label, F.lit("")) == "", F.lit("webpage")).otherwise(label)


def route(url: Column | str) -> Column:
    return F.when(col(url).contains(".pdf"), F.lit("pdf")).otherwise(F.lit("web"))


def text_hash_base36(value: Column) -> Column:
    """abs(int32 rolling hash, h*31 + UTF-16 unit) written in base 36."""
    wrap = 1 << 32

    def step(acc: Column, ch: Column) -> Column:
        cp = F.ascii(ch).cast("bigint")
        high = F.lit(0xD800) + F.shiftright(cp - 0x10000, 10)
        low = F.lit(0xDC00) + F.pmod(cp, F.lit(1024))
        one = F.pmod(acc * 31 + cp, F.lit(wrap))
        pair = F.pmod(F.pmod(acc * 31 + high, F.lit(wrap)) * 31 + low, F.lit(wrap))
        return F.when(cp < 0x10000, one).otherwise(pair)

    h = F.aggregate(F.split(value, ""), F.lit(0).cast("bigint"), step)
    signed = F.when(h >= (1 << 31), h - wrap).otherwise(h)
    return F.lower(F.conv(F.abs(signed).cast("string"), 10, 36))
