"""Tables and code blocks out of raw HTML, one Arrow pass over the pages.

Catalyst cannot look inside HTML, so this is the one Python stage.  It is
shuffle-free, sees only ``page_id, url, html``, runs after a native text prefilter
and emits one output row per grid row, so a page is never held as one value again.
"""

from __future__ import annotations

import html as _html
import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import WHITE_SPACE
from ..operators.grid import dense_grid

# executors need not have this package installed: the scanner travels with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_INSIDE = r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+"""
_BARE_ROW = r"tr>(?:<t[dh]>[^<]*+</t[dh]>)++</tr>"


def _tags(bare_rows: str) -> re.Pattern:
    """``bare_rows``, or one tag with the text after it; scripts, styles, comments and declarations vanish."""
    return re.compile(
        rf"<(?:({bare_rows})"
        rf"|(/?)((?!(?i:script|style)[\s/>])[a-zA-Z][^\s/>]*+)({_INSIDE})>([^<]*+)"
        rf"|((?i:script|style))(?=[\s/>]){_INSIDE}>.*?(?:</(?i:\6)(?=[\s/>])[^>]*>|\Z)"
        r"|!--.*?(?:-->|\Z)"
        r"|[!?/][^>]*>)",
        re.DOTALL,
    )


#: neighbouring rows of cells without attributes or markup are one piece; or every tag is
_TAG, _EVERY_TAG = _tags(rf"{_BARE_ROW}(?:<{_BARE_ROW})*+"), _tags("(?!)")
_NEXT_CELL = re.compile(r"</t[dh]><t[dh]>")
_GROUPS = 6
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_LEADING_INT = re.compile(rf"[{WHITE_SPACE}]*([+-]?\d+)")

CELL, ROW, SECTION, TABLE, CAPTION, BLOCK = 1, 2, 3, 4, 5, 6
_KIND = {
    "td": CELL, "th": CELL, "tr": ROW, "tbody": SECTION, "thead": SECTION, "tfoot": SECTION,
    "colgroup": SECTION, "table": TABLE, "caption": CAPTION, "pre": BLOCK, "code": BLOCK,
}
_KIND.update({name.upper(): kind for name, kind in list(_KIND.items())})
#: cells per Arrow batch handed back to the JVM
BATCH_CELLS = 200_000

ATTRS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("element_id", T.StringType()),
        T.StructField("element_name", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("nested_tables", T.IntegerType()),
    ]
)


def _attributes(inside: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(inside):
        if value[:1] in ('"', "'"):
            value = value[1:-1]
        found.setdefault(name.lower(), _html.unescape(value))
    return found


def _span(attrs: dict[str, str], name: str) -> int:
    m = _LEADING_INT.match(attrs.get(name) or "1")
    return max(1, int(m.group(1))) if m else 1


class _Texts(list):
    """A row of bare cells: their texts."""

    __slots__ = ()


class _Table:
    """One table element; its rows also hold the rows and cells of tables inside it."""

    __slots__ = ("attrs", "rows", "row", "cell", "caption", "nested", "spans")

    def __init__(self, attrs: dict[str, str]) -> None:
        self.attrs = attrs
        self.rows: list[list[list]] = []
        self.row: list[list] | None = None
        self.cell: list | None = None
        self.caption = False
        self.nested = 0
        self.spans = False


class _Block:
    __slots__ = ("attrs", "tag", "depth", "start", "end")

    def __init__(self, attrs: dict[str, str], tag: str, depth: int, start: int) -> None:
        self.attrs, self.tag, self.depth, self.start = attrs, tag, depth, start
        self.end: int | None = None


class _Page:
    """Open elements of one page.  Text lives once in ``buf``; a cell is a slice of it.

    A cell is ``[start, end, colspan, rowspan, text or None]``; a row of bare cells is :class:`_Texts`.
    """

    __slots__ = ("buf", "tables", "blocks", "open", "open_blocks")

    def __init__(self) -> None:
        self.buf: list[str] = []
        self.tables: list[_Table] = []
        self.blocks: list[_Block] = []
        self.open: list[_Table] = []
        self.open_blocks: list[_Block] = []

    def close_cell(self, top: _Table) -> None:
        """End the open cell or caption; blocks opened inside the cell end with it."""
        if top.cell is not None:
            depth = len(self.open)
            while self.open_blocks and self.open_blocks[-1].depth >= depth:
                self.open_blocks.pop().end = len(self.buf)
            top.cell[1] = len(self.buf)
            top.cell = None
        top.caption = False

    def open_row(self, top: _Table) -> None:
        top.row = row = []
        for table in self.open:
            table.rows.append(row)

    def open_cell(self, top: _Table, inside: str) -> None:
        self.close_cell(top)
        if top.row is None:
            self.open_row(top)
        cell = [len(self.buf), None, 1, 1, None]
        if inside and "span" in inside.lower():
            attrs = _attributes(inside)
            cell[2] = _span(attrs, "colspan")
            cell[3] = _span(attrs, "rowspan")
            for table in self.open:
                table.spans = True
        if len(self.open) == 1:
            top.row.append(cell)
        else:
            for table in self.open:
                if table.row is not None:
                    table.row.append(cell)
        top.cell = cell

    def bare_rows(self, top: _Table, rows: str) -> None:
        """Rows of the only open table, outside of blocks; they end what is open and leave nothing open."""
        self.close_cell(top)
        top.row = None
        entities = "&" in rows
        for row in rows[3:-5].split("</tr><tr>"):
            inside = row[4:-5]
            cells = _NEXT_CELL.split(inside) if "th>" in row else inside.split("</td><td>")
            if entities:
                cells = [_html.unescape(text) if "&" in text else text for text in cells]
            top.rows.append(_Texts([text.strip(WHITE_SPACE) for text in cells]))

    def close_table(self) -> None:
        self.close_cell(self.open[-1])
        self.open.pop()

    def start(self, kind: int, name: str, inside: str) -> None:
        if kind == BLOCK:
            block = _Block(_attributes(inside), name.lower(), len(self.open), len(self.buf))
            self.blocks.append(block)
            self.open_blocks.append(block)
        elif kind == TABLE:
            if self.open and self.open[-1].cell is None and not self.open[-1].caption:
                self.close_table()  # a table cannot sit between cells: it ends the open one
            for outer in self.open:
                outer.nested += 1
            table = _Table(_attributes(inside))
            self.tables.append(table)
            self.open.append(table)
        elif self.open:
            top = self.open[-1]
            if kind == CELL:
                self.open_cell(top, inside)
                return
            self.close_cell(top)
            if kind == CAPTION:
                top.caption = True
                return
            top.row = None
            if kind == ROW:
                self.open_row(top)

    def end(self, kind: int, name: str) -> None:
        if kind == BLOCK:
            name = name.lower()
            for i in range(len(self.open_blocks) - 1, -1, -1):
                if self.open_blocks[i].tag == name:
                    self.open_blocks.pop(i).end = len(self.buf)
                    break
        elif self.open:
            top = self.open[-1]
            self.close_cell(top)
            if kind == TABLE:
                self.open.pop()
            elif kind in (ROW, SECTION):
                top.row = None

    def cell_text(self, cell: list) -> str:
        text = cell[4]
        if text is None:
            start, end = cell[0], cell[1]
            if end - start == 1:
                text = self.buf[start].strip(WHITE_SPACE)
            else:
                text = "".join(self.buf[start:end]).strip(WHITE_SPACE)
            cell[4] = text
        return text


def read_page(source: str) -> _Page:
    if "\r" in source:
        source = source.replace("\r\n", "\n").replace("\r", "\n")
    page = _Page()
    _read(page, _TAG, source)
    while page.open:
        page.close_table()
    return page


def _read(page: _Page, tags: re.Pattern, source: str) -> None:
    keep, tables, blocks = page.buf.append, page.open, page.open_blocks
    pieces = iter(tags.split(source))
    next(pieces)  # text before the first tag is in no table
    for rows, slash, name, inside, text, _, between in zip(*[pieces] * (_GROUPS + 1)):
        if rows:
            if blocks or len(tables) > 1:
                _read(page, _EVERY_TAG, f"<{rows}")
            elif tables:
                page.bare_rows(tables[0], rows)
        kind = _KIND.get(name)
        if kind is None and name:
            kind = _KIND.get(name.lower())
        if kind:
            if slash:
                page.end(kind, name)
            else:
                page.start(kind, name, inside)
        if text and (tables or blocks):
            keep(_html.unescape(text) if "&" in text else text)
        if between and (tables or blocks):
            keep(_html.unescape(between) if "&" in between else between)


class _Line:
    """A row under construction: text by column, blanks left out, columns in order."""

    __slots__ = ("at", "texts")

    def __init__(self) -> None:
        self.at: list[int] = []
        self.texts: list[str] = []

    def put(self, first: int, last: int, text: str) -> None:
        """``text`` in ``first``, blanks up to ``last``."""
        i, j = bisect_left(self.at, first), bisect_right(self.at, last)
        self.at[i:j], self.texts[i:j] = ([first], [text]) if text else ([], [])

    def free(self, at: int) -> int:
        """The first blank column at or after ``at``."""
        i = bisect_left(self.at, at)
        while i < len(self.at) and self.at[i] == at:
            at, i = at + 1, i + 1
        return at


def grid_width(table: _Table) -> int:
    """The largest colspan total of a row; one that does not fit a long cannot be stored."""
    width = max((len(r) if type(r) is _Texts else sum(c[2] for c in r) for r in table.rows if r), default=0)
    if width >= 1 << 63:
        raise ValueError("a row has more columns than can be counted")
    return width


def grid_rows(page: _Page, table: _Table) -> Iterator[tuple[int, list[int] | None, list[str]]]:
    """Rows as runs: width, columns that hold text (none: the first ones), and their texts.

    Spans cost nothing by their length: only the spans still running are remembered, each as one
    interval.  The width is the largest colspan total.  A cell starts at the first blank
    column at or after the cursor.  A rowspan repeats its text in its first column;
    the other columns of a colspan are blank.  Rowspans past the last row add rows.
    """
    filled = [r for r in table.rows if r]
    if not filled:
        return
    text_of = page.cell_text
    width = grid_width(table)
    if not table.spans:
        for row in filled:
            yield width, None, row if type(row) is _Texts else [text_of(cell) for cell in row]
        return
    filled = [[[0, 0, 1, 1, text] for text in r] if type(r) is _Texts else r for r in filled]
    height = max(i + c[3] for i, r in enumerate(filled) for c in r)
    running: list[tuple[int, int, int, str]] = []  # last row, first column, last column, text; the later covers the earlier
    for r in range(max(height, len(filled))):
        line = _Line()
        running = [span for span in running if span[0] >= r]
        for _, first, last, text in running:
            line.put(first, last, text)
        at = 0
        for cell in filled[r] if r < len(filled) else ():
            at = line.free(at)
            if at < width:
                last, text = min(at + cell[2], width) - 1, text_of(cell)
                line.put(at, last, text)
                if cell[3] > 1:
                    running.append((r + cell[3] - 1, at, last, text))
            at += cell[2]
        yield width, line.at, line.texts


def _attrs(url: str | None, found: dict[str, str], nested: int) -> dict:
    return {
        "url": url,
        "element_id": found.get("id") or None,
        "element_name": found.get("name") or None,
        "role": found.get("role"),
        "nested_tables": nested,
    }


def _records(page_id, url: str | None, source: str, want: str) -> Iterator[tuple]:
    page = read_page(source)
    if want in ("table", "both"):
        for table in page.tables:
            grid_width(table)  # a page that cannot be stored fails before its first row
        for idx, table in enumerate(page.tables):
            held = None
            for r, line in enumerate(grid_rows(page, table)):
                attrs = _attrs(url, table.attrs, table.nested) if r == 0 else None
                record = (page_id, "html", idx, r, *line, attrs)
                if r == 0:
                    held = record  # a grid of one row is not a table
                    continue
                if held:
                    yield held
                    held = None
                yield record
    if want in ("block", "both"):
        for idx, block in enumerate(page.blocks):
            text = "".join(page.buf[block.start : block.end])
            if block.tag == "pre" and text.startswith("\n"):
                text = text[1:]
            yield (page_id, "block", idx, 0, 1, None, [text], _attrs(url, block.attrs, 0))


def _readable(page_id, url: str | None, source: str, want: str) -> Iterator[tuple]:
    """Rows of a page; one that cannot be read leaves its neighbours alone, and says why in a scan for everything."""
    try:
        yield from _records(page_id, url, source, want)
    except (ValueError, ArithmeticError, LookupError, RecursionError, MemoryError) as why:
        reason = f"{type(why).__name__}: {why}"
        if want == "both":
            yield (page_id, "error", 0, 0, 1, None, [reason], _attrs(url, {}, 0))


def _scanner(schema: pa.Schema, want: str, batch_cells: int = BATCH_CELLS):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        cells = 0

        def flush() -> pa.RecordBatch:
            columns = zip(*rows)
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, schema)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            ids, urls, sources = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                source = sources[i].as_py()
                if source is None:
                    continue
                for record in _readable(ids[i].as_py(), urls[i].as_py(), source, want):
                    rows.append(record)
                    cells += len(record[6]) + 4
                    if cells >= batch_cells:
                        yield flush()
                        rows, cells = [], 0
        if rows:
            yield flush()

    return scan


def _scan(pages: DataFrame, want: str, needles: list[str], batch_cells: int) -> DataFrame:
    if "url" not in pages.columns:
        pages = pages.withColumn("url", F.lit(None).cast("string"))
    lowered = F.lower("html")
    hit = lowered.contains(needles[0])
    for needle in needles[1:]:
        hit = hit | lowered.contains(needle)
    source = pages.select("page_id", "url", "html").where(hit)
    out = T.StructType(
        [
            T.StructField("page_id", source.schema["page_id"].dataType),
            T.StructField("kind", T.StringType()),
            T.StructField("table_idx", T.IntegerType()),
            T.StructField("row_idx", T.LongType()),
            T.StructField("width", T.LongType()),
            T.StructField("at", T.ArrayType(T.LongType())),
            T.StructField("texts", T.ArrayType(T.StringType())),
            T.StructField("attrs", ATTRS),
        ]
    )
    return source.mapInArrow(_scanner(to_arrow_schema(out), want, batch_cells), out)


def extract_html_runs(pages: DataFrame, batch_cells: int = BATCH_CELLS) -> DataFrame:
    """Grid rows of every table with more than one row, as runs; ``attrs`` is set on row 0.

    A row has ``width`` columns, of which ``at`` (null: the first ones) hold ``texts`` and the rest are blank, so a row
    costs what it holds however far its spans reach.  ``table_idx`` is the position of the element in document order.
    """
    return _scan(pages, "table", ["<table"], batch_cells)


def extract_html_tables(pages: DataFrame, batch_cells: int = BATCH_CELLS) -> DataFrame:
    """The same with ``cells``, one text per column, which are laid out where a plan asks for them."""
    return dense_grid(extract_html_runs(pages, batch_cells))


def page_errors(found: DataFrame) -> DataFrame:
    """``page_id, reason`` of the pages that a scan (:func:`extract_all`) could not read."""
    return found.where(F.col("kind") == "error").select("page_id", F.get("texts", F.lit(0)).alias("reason"))


def extract_code_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, block_idx, text, attrs`` of every pre and code element."""
    return code_blocks(_scan(pages, "block", ["<pre", "<code"], BATCH_CELLS))


def code_blocks(found: DataFrame) -> DataFrame:
    """The code blocks among the rows of a scan."""
    return found.where(F.col("kind") == "block").select(
        "page_id", F.col("table_idx").alias("block_idx"), F.get("texts", F.lit(0)).alias("text"), "attrs"
    )


def extract_all(pages: DataFrame) -> DataFrame:
    """Tables (kind ``html``), raw blocks (``block``) and unreadable pages (``error``) in one scan of the pages."""
    return _scan(pages, "both", ["<table", "<pre", "<code"], BATCH_CELLS)
