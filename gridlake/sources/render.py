"""Rows to HTML, CSV, Markdown and JSON text, for building pages inside a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_row(cells: Column, tag: str = "td") -> Column:
    """A row of cells, null ones left out; cells without anything to escape are joined as they are."""
    body = F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(c), F.lit(f"</{tag}>")))
    texts = F.array_join(cells, "")
    plain = (texts != "") & ~(texts.contains("&") | texts.contains("<") | texts.contains(">"))
    bare = F.concat(F.lit(f"<{tag}>"), F.array_join(cells, f"</{tag}><{tag}>"), F.lit(f"</{tag}>"))
    return F.concat(F.lit("<tr>"), F.when(plain, bare).otherwise(F.array_join(body, "")), F.lit("</tr>"))


def html_row_of(*cells: Column) -> Column:
    """The same of single columns, without an array of them; a null cell is left out there too."""
    body = [F.coalesce(F.concat(F.lit("<td>"), escape_html(c), F.lit("</td>")), F.lit("")) for c in cells]
    return F.concat(F.lit("<tr>"), *body, F.lit("</tr>"))


def html_table(header: list[str | Column], rows: Column, attributes: str = "") -> Column:
    return html_table_of(header, F.array_join(F.transform(rows, lambda r: html_row(r)), ""), attributes)


def html_table_of(header: list[str | Column], body: Column, attributes: str = "") -> Column:
    """A table whose ``body`` is the text of its rows."""
    head = F.array(*[F.lit(h) if isinstance(h, str) else h for h in header])
    return F.concat(F.lit(f"<table{attributes}>"), html_row(head, "th"), body, F.lit("</table>"))


def html_page(*body: Column) -> Column:
    return F.concat(F.lit("<!DOCTYPE html><html><body>"), *body, F.lit("</body></html>"))


def csv_text(header: list[str], rows: Column) -> Column:
    def cell(c: Column) -> Column:
        return F.when(c.contains(","), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)

    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, cell), ","))
    return F.concat_ws("\n", F.lit(",".join(header)), lines)


def markdown_text(header: list[str], rows: Column) -> Column:
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    return F.concat_ws(
        "\n",
        F.lit("| " + " | ".join(header) + " |"),
        F.lit("|" + "---|" * len(header)),
        lines,
    )
