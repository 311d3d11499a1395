"""Personal data in texts: anchors by Aho-Corasick, boundaries by local parsers.

One automaton finds at-signs, ``://``, plus signs and, in any case of letters, identifier cues in a text.  A parser
then expands each anchor to the left and right and validates what it finds: domain labels,
account digits, check digits of account numbers.  Kinds that have no literal anchor
(addresses of machines, cards, IBANs) are scans of the whole text by their patterns.  The scan is the only stage; a task holds
one batch of texts.

Base kinds follow the leftmost matches of their patterns without overlap, and a match that
fails its test is dropped without another try.  Further kinds are ``login`` (user part of an
address with a scheme), ``account`` (digits after a cue) and ``iban`` (valid check digits).

Defined results: null counts as an empty text; offsets are code points; spans of different
kinds may overlap; a null id stays null; other columns, whatever their names, are never read; repeated
rows are separate rows; an empty table gives no rows.  Texts, runs of digits and identifiers of any
length are read whole, in linear time.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrow import forget, give_back, slices, texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone", "login", "account", "iban")
BASE = 4
BATCH = 4 << 20
# Cues before an identifier.
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "konto", "compte", "cuenta")

LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/@:?#]++(?::[^\s/@]*+)?@")
# what may stand between a cue and its identifier; a filler in capitals could be part of the identifier, so it ends there
FILLER = r"(?:[ ]?(?:(?i:number|no\.?|nr\.?|id)(?![A-Za-z0-9])|number|no\.?|nr\.?|id))?(?:[ ](?i:is)(?![A-Za-z0-9]))?[ ]?[:=#]?[ ]?"
# digits in groups, eight or more in all, or an identifier without spaces
GROUPED = r"(?=[0-9](?:[ .-]?[0-9]){7})[0-9]{2,6}(?:[ -][0-9]{2,11}|\.[0-9]{3,11})+(?!-?[A-Za-z0-9])"
GROUPED_ACCOUNT = re.compile(GROUPED)
FILLERS = re.compile(f"{FILLER}[A-Z0-9]")  # and the first character of the identifier
#: " number is : " is the longest filler
FILLER_LENGTH = len(" number is : ")
RUN = re.compile(r"[A-Z0-9-]+")
QUAD = re.compile(r"[0-9]{4}")
#: least characters of an identifier without spaces
COMPACT = 6
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def lower_in_place(text: str) -> str:
    """The text in lower case, every character at its own offset."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(d := c.lower()) > 1 else d for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``, none of it before ``floor``."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    domain = DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain else None


class _Compact:
    """Identifiers of capitals, digits and hyphens with four digits in a row; each run of them is looked at once."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, 0, 0

    def at(self, start: int) -> int:
        """The end of the identifier that starts at ``start``, or 0."""
        if not self.start <= start < self.end:
            run = RUN.match(self.text, start)
            if run is None:
                return 0
            self.start, self.end = run.span()
            after = self.text[self.end : self.end + 1]
            stop = self.text.rfind("-", self.start, self.end) if after and "a" <= after <= "z" else self.end
            while stop > self.start and self.text[stop - 1] == "-":
                stop -= 1
            self.stop = stop
            self.quad = self._last_quad(run[0])
        fits = self.text[start] != "-" and self.stop - start >= COMPACT and self.quad >= start
        return self.stop if fits else 0

    def _last_quad(self, run: str) -> int:
        """Where the last four digits in a row start."""
        found = QUAD.search(run[::-1])
        return self.start + len(run) - found.end() if found else -1


class Finder:
    """Spans of one text after the other, as (start, rank, end)."""

    def __init__(self, cues: Sequence[str] = CUES):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for word in ("@", "://", "+"):
            self.anchors.add_word(word, (word, len(word)))
        for cue in cues:
            self.anchors.add_word(cue.lower(), ("cue", len(cue)))
        self.anchors.make_automaton()

    @staticmethod
    def _account(text: str, at: int, compact: _Compact) -> tuple[int, int] | None:
        """The identifier behind a cue that ends at ``at``: after the longest filler that leaves one."""
        for start in range(min(at + FILLER_LENGTH, len(text) - 1), at - 1, -1):
            if FILLERS.fullmatch(text, at, start + 1):
                grouped = GROUPED_ACCOUNT.match(text, start)
                end = grouped.end() if grouped else compact.at(start)
                if end:
                    return start, end
        return None

    def find(self, text: str) -> list[tuple[int, int, int]]:
        out = []
        after_email = after_phone = after_account = 0
        compact = _Compact(text)
        for last, (what, _) in self.anchors.iter(lower_in_place(text)):
            if what == "@":
                hit = _email(text, last, after_email)
                if hit:
                    out.append((hit[0], 0, hit[1]))
                    after_email = hit[1]
            elif what == "+":
                hit = PHONE.match(text, last) if last >= after_phone else None
                if hit:
                    after_phone = hit.end()
                    if 9 <= len(_digits(hit[0])) <= 15:
                        out.append((last, 3, hit.end()))
            elif what == "://":
                hit = LOGIN.match(text, last + 1)
                if hit:
                    out.append((last + 1, 4, hit.end() - 1))
            else:
                hit = self._account(text, last + 1, compact)
                if hit and hit[0] >= after_account:
                    out.append((hit[0], 5, hit[1]))
                    after_account = hit[1]
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = _digits(m[0])
            if len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in IBAN.finditer(text):
            if iban_valid(m[0]):
                out.append((m.start(), 6, m.end()))
        return sorted(set(out))


def joined(spans: list[tuple[int, int, int]], ranks: int = len(KINDS)) -> str:
    return ",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e in spans if r < ranks)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a mark of its kind in place of each span; of overlapping ones the first, longest counts."""
    out, at = [], 0
    for start, rank, end in sorted(spans, key=lambda s: (s[0], -s[2], s[1])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[rank].upper()}>"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def _finder(schema: pa.Schema, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        finder = Finder()
        for batch in slices(batches, 0, BATCH):
            values = texts(batch.column(0))
            spans = [finder.find(t) for t in values]
            counts = [[sum(s[1] == rank for s in found) for found in spans] for rank in range(len(KINDS))]
            columns = [
                *batch.columns[1 : kept + 1],
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array([joined(s, BASE) for s in spans], pa.string()),
                pa.array([joined(s) for s in spans], pa.string()),
                pa.array([redact(t, s) if s else t for t, s in zip(values, spans)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
        give_back()

    return run


def find_personal_data(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``n_<kind>`` for each kind, ``base`` and ``spans`` (kind:start:end, joined by
    commas, by start and then kind) and ``redacted``, the text with marks in place of spans.
    """
    source = docs.select(F.col(text_col).alias("t"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    fields = [T.StructField(f.name, f.dataType) for f in source.schema.fields[1:]]
    fields += [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField(c, T.StringType()) for c in ("base", "spans", "redacted")]
    out = T.StructType(fields)
    found = source.mapInArrow(_finder(to_arrow_schema(out), len(keep)), out)
    return found.toDF(*keep, *(f"n_{k}" for k in KINDS), "base", "spans", "redacted")
