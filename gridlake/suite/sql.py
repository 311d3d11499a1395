"""Plain SQL for every registered query, over the same tables."""

from __future__ import annotations

from ..functions.text import WHITE_SPACE

WS = "'" + WHITE_SPACE + "'"

MONEY = "format('{:,.2f}', %s)"
EU = "translate(format('{:,.2f}', %s), '.,', ',.')"

CUST = f"""
cust AS (
  SELECT c_nationkey * 1000000 + c_custkey // 500 AS page_id, n_name, n_regionkey % 2 = 1 AS eu,
         c_custkey, c_acctbal,
         row_number() OVER (PARTITION BY c_nationkey, c_custkey // 500 ORDER BY c_custkey) AS r,
         count(*) OVER (PARTITION BY c_nationkey, c_custkey // 500) AS n,
         c_custkey::VARCHAR AS k, c_name AS nm, c_mktsegment AS seg,
         CASE WHEN c_acctbal < -900 THEN ''
              WHEN n_regionkey % 2 = 1 THEN '$ ' || {EU % "c_acctbal"}
              ELSE '$ ' || {MONEY % "c_acctbal"} END AS bal
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
sheet AS (
  SELECT DISTINCT page_id, n_name, n, 0 AS row_idx,
         'Key ' || n_name AS c0, 'Name' AS c1, 'Balance' AS c2, 'Segment' AS c3 FROM cust
  UNION ALL SELECT page_id, n_name, n, r, k, nm, bal, seg FROM cust)
"""

OW = f"""
ow AS (
  SELECT o_orderkey // 50 AS page_id, o_orderkey + 1 AS row_idx, o_orderkey AS ok, o_totalprice AS price,
         row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) AS r,
         CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE o_totalprice END AS total0,
         CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_custkey END AS buyer0,
         o_orderkey % 40 + 0.5 AS share0, o_orderdate::DATE AS day,
         o_orderkey::VARCHAR AS "Order",
         CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE '$ ' || {EU % "o_totalprice"} END AS "Total",
         strftime(o_orderdate, '%d/%m/%Y') AS "Date",
         substr(o_orderpriority, 1, 1) AS "Level", o_orderpriority AS "Priority",
         CASE WHEN o_orderkey % 17 = 0 THEN 'N/A' ELSE o_custkey::VARCHAR END AS "Buyer",
         (o_orderkey % 40)::VARCHAR || ',50%' AS "Share"
  FROM orders)
"""

# every order cell as (page, row, column, text)
OCELLS = (
    OW
    + """,
ocells AS (
  SELECT page_id, r, row_idx, ok, 0 AS col_idx, 'Order' AS header, "Order" AS v FROM ow
  UNION ALL SELECT page_id, r, row_idx, ok, 1, 'Total', "Total" FROM ow
  UNION ALL SELECT page_id, r, row_idx, ok, 2, 'Date', "Date" FROM ow
  UNION ALL SELECT page_id, r, row_idx, ok, 3, 'Level', "Level" FROM ow
  UNION ALL SELECT page_id, r, row_idx, ok, 4, 'Priority', "Priority" FROM ow
  UNION ALL SELECT page_id, r, row_idx, ok, 5, 'Buyer', "Buyer" FROM ow
  UNION ALL SELECT page_id, r, row_idx, ok, 6, 'Share', "Share" FROM ow)
"""
)

MODES = """
vals AS (SELECT {by}, v, count(*) AS c, min(row_idx) AS f,
    CASE WHEN regexp_full_match(v, '0|[1-9][0-9]{{0,9}}') AND TRY_CAST(v AS BIGINT) < 4294967295
         THEN TRY_CAST(v AS BIGINT) END AS num
  FROM ocells WHERE v <> '' GROUP BY {by}, v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY c DESC, num NULLS LAST, f) AS rk,
    count(*) OVER (PARTITION BY {by}, c) - 1 AS others, count(*) OVER (PARTITION BY {by}) AS u
  FROM vals),
modes AS (SELECT {by}, v AS mode, others, u FROM ranked WHERE rk = 1)
"""

DOC_LINES = f"string_split(trim(text, {WS}), chr(10))"
COMMAS = "(length({0}) - length(replace({0}, ',', '')))"
IS_CSV = f"""(len(lines) >= 2 AND {COMMAS.format("lines[1]")} > 0 AND
  len(list_filter(lines, lambda l: abs({COMMAS.format("l")} - {COMMAS.format("lines[1]")}) <= 1))
    >= len(lines) * 0.7::DOUBLE)"""
IS_MD = """(len(lines) >= 2
  AND len(list_filter(lines, lambda l: len(string_split(l, '|')) >= 3)) > 0
  AND (len(lines) >= 3 OR len(list_filter(lines, lambda l: contains(l, '---') AND contains(l, '|'))) > 0))"""
CSV_ROWS = f"""list_transform(lines, lambda l: list_transform(string_split(array_to_string(
    list_transform(string_split(l, '"'), lambda s, i: CASE WHEN i % 2 = 0 THEN replace(s, ',', chr(1)) ELSE s END),
    ''), ','), lambda x: trim(replace(x, chr(1), ','), {WS})))"""
MD_ROWS = f"""list_filter(list_transform(list_filter(lines, lambda l: NOT contains(l, '---')),
    lambda l: list_filter(list_transform(string_split(l, '|'), lambda x: trim(x, {WS})), lambda x: x <> '')),
    lambda r: len(r) > 0)"""
DOCS = f"docs AS (SELECT doc_id, {DOC_LINES} AS lines FROM documents)"


def _unnested(source: str, key: str, rows: str, where: str) -> str:
    return f"""
SELECT {key}, i - 1 AS row_idx, len(rows[i]) AS n_cells, array_to_string(rows[i], '|') AS line
FROM (SELECT {key}, rows, unnest(range(1, len(rows) + 1)) AS i
      FROM (SELECT {key}, {rows} AS rows FROM {source} WHERE {where}) WHERE len(rows) > 1)
"""


def _text_tables(origin: str, key: str, idx: str) -> str:
    return f"""
SELECT '{origin}' AS origin, {key} AS page_id, kind, ({idx})::INT AS table_idx, i - 1 AS row_idx,
       array_to_string(rows[i], '|') AS line
FROM (SELECT *, unnest(range(1, len(rows) + 1)) AS i FROM (
  SELECT *, CASE WHEN kind = 'csv-selection' THEN {CSV_ROWS} ELSE {MD_ROWS} END AS rows FROM (
    SELECT *, CASE WHEN {IS_CSV} THEN 'csv-selection' WHEN {IS_MD} THEN 'markdown-selection' END AS kind
    FROM (SELECT *, {DOC_LINES} AS lines FROM {origin})) WHERE kind IS NOT NULL) WHERE len(rows) > 1)
"""


DIRTY = (
    CUST
    + """,
pages9 AS (SELECT DISTINCT page_id, n FROM cust),
has_seg AS (SELECT page_id, bool_or(c_custkey % 4 IN (2, 3)) AS hs FROM cust GROUP BY 1),
blank AS (SELECT page_id, x.i AS row_idx, CASE WHEN x.i = 0 THEN '| ' ELSE '|' END AS line
          FROM pages9, (SELECT unnest([0, 1, 2]) AS i) x WHERE page_id % 9 = 0)
"""
)

ORDER_TYPES = """
WITH {cells},
flags AS (
  SELECT page_id, col_idx, header,
    count(*) FILTER (v <> '') AS n,
    count(*) FILTER (v <> '' AND regexp_full_match(v, '[+-]?[0-9.,\\s]+%')) AS rate,
    count(*) FILTER (v <> '' AND regexp_full_match(v, '[$€£¥₽₹R]?\\s*[+-]?[0-9.,\\s]+[$€£¥₽₹R]?')) AS money,
    count(*) FILTER (regexp_matches(v, '[$€£¥₽₹R]')) AS marks,
    count(*) FILTER (v <> '' AND regexp_full_match(v, '[+-]?[0-9.,\\s]+')) AS num,
    count(DISTINCT v) FILTER (v <> '' AND NOT regexp_full_match(v, '[+-]?[0-9.,\\s]+')) AS odd,
    count(*) FILTER (regexp_full_match(v, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}')) AS dates
  FROM ocells GROUP BY ALL)
SELECT page_id, col_idx, header, n AS n_values,
  CASE WHEN n = 0 THEN 'categorical' WHEN rate = n THEN 'rate' WHEN money = n AND marks > 0 THEN 'money'
       WHEN num = n OR (num > 0 AND odd = 1) THEN 'numeric' WHEN dates = n THEN 'date'
       ELSE 'categorical' END AS type
FROM flags
"""

RANGE_SPECS = """
specs AS (SELECT o_orderkey AS k,
  CASE WHEN o_orderkey % 23 = 0 THEN 'Empty input'
       WHEN o_orderkey % 19 = 0 THEN 'Invalid range: 2-x'
       WHEN o_orderkey % 17 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'Invalid page: 0' ELSE 'Invalid range: -3' END
       WHEN o_orderkey % 11 = 0 THEN 'More than 20 pages specified (' || (10000000000 + o_orderkey % 9 - 2) || ')'
  END AS error,
  o_orderkey % 4 + 2 AS a, o_orderkey % 7 + 1 AS b, o_orderkey % 6 + 1 AS c FROM orders)
"""


def _tie(expr: str, d: int) -> str:
    """fixed decimals, exact ties away from zero"""
    scale = 2 ** (d + 1)
    nudge = 0.25 * 10.0**-d
    mag = f"abs({expr})"
    tie = f"({mag} * {scale} = floor({mag} * {scale}) AND ({mag} * {scale}) % 2 = 1)"
    body = f"format('{{:,.{d}f}}', CASE WHEN {tie} THEN {mag} + {nudge} ELSE {mag} END)"
    return f"(CASE WHEN {expr} < 0 THEN '-' ELSE '' END || {body})"


def _swap(text: str) -> str:
    return f"translate({text}, '.,', ',.')"


NUM_CASES = """
nums AS (SELECT o_orderkey, o_orderkey % 8 AS c, o_totalprice AS v FROM orders)
"""


def _long(rows: list[tuple[str, str, str]], source: str, by: str = "", where: str = "") -> str:
    """UNION of (header, stat, expression) aggregates"""
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {head}'{h}' AS header, '{s}' AS stat, {e} AS num_value FROM {source} {where}{tail}"
        for h, s, e in rows
    )


def _numeric(header: str, expr: str, present: str = "TRUE") -> list[tuple[str, str, str]]:
    f = f"FILTER ({present})"
    return [
        (header, "count", f"(count(*) {f})::DOUBLE"),
        (header, "sum", f"(sum({expr}) {f})::DOUBLE"),
        (header, "avg", f"avg({expr}) {f}"),
        (header, "min", f"(min({expr}) {f})::DOUBLE"),
        (header, "max", f"(max({expr}) {f})::DOUBLE"),
        (header, "std", f"stddev_pop({expr}) {f}"),
    ]


VIEW_WHERE = """day BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
  AND "Priority" IN ('1-URGENT', '3-MEDIUM')"""
VIEW_COLUMNS = ("Order", "Total", "Date", "Level", "Priority", "Buyer", "Share")


def _view_lines(literal: str) -> str:
    def cell(c: str) -> str:
        return f'CASE WHEN contains("{c}", {literal}) THEN \'"\' || "{c}" || \'"\' ELSE "{c}" END'

    cells = f" || {literal} || ".join(cell(c) for c in VIEW_COLUMNS)
    return f"""
WITH {OW}, v AS (SELECT *, row_number() OVER (ORDER BY total0 DESC, row_idx) AS pos FROM ow WHERE {VIEW_WHERE})
SELECT 0 AS line_no, concat_ws({literal}, {", ".join(f"'{c}'" for c in VIEW_COLUMNS)}) AS line
UNION ALL SELECT pos, {cells} FROM v"""

HASH = """list_reduce(list_transform(string_split({0}, ''), lambda ch: unicode(ch)::BIGINT),
    lambda a, b: (a * 31 + b) % 4294967296, 0::BIGINT)"""

SHEET_IDS = f"""
heads AS (SELECT DISTINCT page_id, n, 'Key ' || n_name || '|Name|Balance|Segment_' || n || 'x4' AS s FROM cust),
ids AS (SELECT page_id, n, 'csv_' || lower(to_base(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END), 36)) || '_0' AS table_id
        FROM (SELECT page_id, n, {HASH.format("s")} AS h FROM heads))
"""

ORACLES: dict[str, str] = {
    "html_order_totals": """
SELECT l_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS total,
       max(round(l_discount * 100))::INT AS top_discount, max(l_shipdate)::DATE AS last_shipped
FROM lineitem GROUP BY l_orderkey""",
    "html_span_grid": f"""
WITH {CUST}
SELECT DISTINCT page_id, 0 AS row_idx, 'Segment|Key|Name' AS line FROM cust
UNION ALL SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY seg, c_custkey), seg || '|' || k || '|' || nm FROM cust
UNION ALL SELECT DISTINCT page_id, n + 1, 'Total||' || n FROM cust""",
    "html_nested_rank": f"""
WITH {CUST},
p AS (SELECT page_id, count(*) AS n, count(*) FILTER (bal = '') AS b FROM cust GROUP BY 1),
t AS (SELECT page_id, x.i AS table_idx, x.i + 1 AS rank, TRUE AS lay, 0.01 AS score
      FROM p, (SELECT unnest([0, 1]) AS i) x WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 1, 1, FALSE, (4 * (n + 1) - b) / (4 * (n + 1)) * ((4 * (n + 1) - b) / (n + 1)) FROM p WHERE page_id % 3 <> 0
  UNION ALL SELECT page_id, x.i, x.i - 1, FALSE, 2.0 FROM p, (SELECT unnest([3, 4]) AS i) x WHERE page_id % 3 <> 0)
SELECT page_id, table_idx, rank, 0 AS nested_tables, FALSE AS is_container, lay AS is_presentation,
       round(score::DOUBLE, 6) AS score FROM t""",
    "top_tables": f"""
WITH {CUST}
SELECT DISTINCT page_id, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS table_idx,
  CASE WHEN page_id % 3 = 0 THEN 2 ELSE n + 1 END AS n_rows,
  CASE WHEN page_id % 3 = 0 THEN 25 ELSE 4 END AS n_cols FROM cust""",
    "table_quality": f"""
WITH {CUST},
p AS (SELECT page_id, count(*) + 1 AS n, 4 * (count(*) + 1) - count(*) FILTER (bal = '') AS f FROM cust GROUP BY 1)
SELECT page_id, n AS n_rows, 4 AS n_cols, round(f / (4 * n), 6) AS density, round(f / n, 6) AS avg_row_fill,
  f / (4 * n) < 0.15 AS is_presentation, round(f / (4 * n) * least(f / n, 10), 6) AS score FROM p""",
    "table_ids": f"WITH {CUST}, {SHEET_IDS} SELECT page_id, table_id, n + 1 AS n_rows FROM ids",
    "table_preview": f"""
WITH {CUST},
cut AS (SELECT page_id, n, row_idx,
   list_transform([c0, c1, c2], lambda x: CASE WHEN length(x) > 15 THEN substr(x, 1, 12) || '...' ELSE x END) AS c
  FROM sheet WHERE row_idx < 3)
SELECT page_id, string_agg(array_to_string(c, ' | '), chr(10) ORDER BY row_idx)
  || CASE WHEN max(n) + 1 > 3 THEN chr(10) || '...' ELSE '' END AS preview FROM cut GROUP BY page_id""",
    "fingerprint_tables": f"""
WITH {CUST}
SELECT page_id, replace('Key ' || n_name || '|Name|Balance|Segment_' || n || 'x4_' || k || '|' || nm || '|' || bal, ' ', '') AS fingerprint
FROM cust WHERE r = 1""",
    "table_search": f"""
WITH {CUST}, {SHEET_IDS}
SELECT page_id, table_id FROM ids WHERE page_id IN
  (SELECT page_id FROM sheet WHERE contains(lower(concat_ws(' ', c0, c1, c2, c3)), 'building'))""",
    "table_search_rows": f"""
WITH {CUST},
blob AS (SELECT page_id, lower(string_agg(c0 || ' ' || c1 || ' ' || c2 || ' ' || c3, ' ' || chr(10) || ' ' ORDER BY row_idx)) AS t
  FROM sheet GROUP BY 1)
SELECT page_id FROM blob WHERE contains(t, 'household ' || chr(10) || ' 1')""",
    "table_search_indexed": f"""
WITH {CUST},
blob AS (SELECT page_id, lower(string_agg(c0 || ' ' || c1 || ' ' || c2 || ' ' || c3, ' ' || chr(10) || ' ' ORDER BY row_idx)) AS t
  FROM sheet GROUP BY 1)
SELECT q AS query, page_id FROM blob, (VALUES ('row', 'building'), ('rows', 'household ' || chr(10) || ' 1'), ('short', '9')) x(q, s)
WHERE contains(t, s)""",
    "merge_table_lists": """
WITH e AS (SELECT 't' || c_custkey AS table_id, 'kept' AS origin, c_custkey AS position FROM customer),
i AS (SELECT 't' || (o_custkey + CASE WHEN o_orderkey % 2 = 1 THEN 10000000 ELSE 0 END) AS table_id, o_orderkey FROM orders)
SELECT * FROM e UNION ALL
SELECT table_id, 'new', min(o_orderkey) FROM i
WHERE table_id NOT IN (SELECT table_id FROM e) GROUP BY table_id""",
    "code_block_tables": f"""
WITH {CUST},
rows_ AS (SELECT page_id, row_idx, CASE WHEN row_idx = 0 THEN 'Key' ELSE c0 END AS c0, c1, c2, c3 FROM sheet)
SELECT page_id, 'csv' AS kind, x.i AS table_idx, row_idx, c0 || '|' || c1 || '|' || c2 || '|' || c3 AS line
FROM rows_, (SELECT unnest([0, 1]) AS i) x
UNION ALL SELECT page_id, 'markdown', 2, row_idx, concat_ws('|', c0, c1, nullif(c2, ''), c3) FROM rows_""",
    "csv_docs_detected": f"WITH {DOCS} SELECT doc_id FROM docs WHERE {IS_CSV}",
    "md_docs_detected": f"WITH {DOCS} SELECT doc_id FROM docs WHERE {IS_MD}",
    "csv_docs_parsed": f"WITH {DOCS} {_unnested('docs', 'doc_id', CSV_ROWS, IS_CSV)}",
    "md_docs_parsed": f"WITH {DOCS} {_unnested('docs', 'doc_id', MD_ROWS, IS_MD)}",
    "text_tables_union": _text_tables("documents", "doc_id", "0")
    + " UNION ALL "
    + _text_tables("conversations", "conv_id", "turn"),
    "json_tables": f"""
WITH {CUST}
SELECT page_id, 0 AS table_idx, CASE WHEN page_id % 5 <= 1 THEN page_id % 7 END AS service_page,
  CASE WHEN page_id % 5 <= 2 THEN page_id % 5 + 1 END AS service_index, row_idx,
  CASE WHEN row_idx = 0 THEN 'Key' ELSE c0 END || '|' || c1 || '|' || c2 || '|' || c3 AS line
FROM sheet WHERE page_id % 5 <> 4""",
    "json_numbers": """
SELECT o_orderkey AS page_id, 2 AS service_page, o_orderkey AS service_index, x.i AS row_idx, CASE x.i WHEN 0 THEN 'n|t'
  WHEN 1 THEN o_orderkey || '.50|a, -5.0]: "7.10"' WHEN 2 THEN '-' || o_orderkey || 'e+03|x' ELSE '0.' || o_orderkey || '0|true' END AS line
FROM orders, (SELECT unnest([0, 1, 2, 3]) AS i) x""",
    "page_ranges": f"""
WITH {RANGE_SPECS}
SELECT k AS spec_id, l_linenumber - 1 AS page, l_partkey, l_quantity FROM lineitem JOIN specs ON l_orderkey = k
WHERE error IS NULL AND (l_linenumber BETWEEN least(a, b) AND greatest(a, b) OR l_linenumber IN (1, c))""",
    "page_ranges_unlimited": f"""
WITH {RANGE_SPECS}
SELECT k AS spec_id, l_linenumber - 1 AS page, l_partkey FROM lineitem JOIN specs ON l_orderkey = k
WHERE (error IS NULL AND (l_linenumber BETWEEN least(a, b) AND greatest(a, b) OR l_linenumber IN (1, c)))
  OR (error LIKE 'More%' AND l_linenumber >= 3)""",
    "page_range_intervals": f"""
WITH {RANGE_SPECS},
named AS (SELECT DISTINCT * FROM (SELECT k, unnest([least(a, b), 1, c]) AS lo, unnest([greatest(a, b), 1, c]) AS hi FROM specs WHERE error IS NULL)),
starts AS (SELECT *, coalesce(lo > 1 + max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE)::INT AS s FROM named),
islands AS (SELECT *, sum(s) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM starts)
SELECT k AS spec_id, min(lo) - 1 AS first, max(hi) - 1 AS last FROM islands GROUP BY k, i
UNION ALL SELECT k, 2, 10000000000 + k % 9 - 1 FROM specs WHERE error LIKE 'More%'""",
    "page_range_errors": f"WITH {RANGE_SPECS} SELECT k AS spec_id, error FROM specs WHERE error IS NOT NULL",
    "page_route": """
SELECT page_id, CASE WHEN page_id % 4 = 0 OR contains(url, '.pdf') THEN 'pdf' ELSE 'web' END AS route FROM pages""",
    "site_names": """
SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'webpage' ELSE
  split_part(regexp_replace(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1), '^www[.]', ''), '.', 1)
  END AS site FROM pages""",
    "catalogue_roundtrip": f"""
WITH {CUST}
SELECT DISTINCT page_id, x.kind AS kind, x.i AS table_idx, n + 1 AS n_rows, n + 1 AS stored_rows, 4 AS n_cols
FROM cust, (VALUES ('csv', 0), ('csv', 1), ('markdown', 2)) x(kind, i)""",
    "clean_grid": f"""
WITH {DIRTY}
SELECT * FROM blank
UNION ALL SELECT page_id, 0, 'Key|Balance' || CASE WHEN hs THEN '|' ELSE '' END FROM has_seg WHERE page_id % 9 <> 0
UNION ALL SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY r),
  k || '|' || bal || CASE WHEN hs THEN '|' || CASE WHEN c_custkey % 4 = 1 THEN '' ELSE seg END ELSE '' END
FROM cust JOIN has_seg USING (page_id) WHERE page_id % 9 <> 0 AND c_custkey % 4 <> 0""",
    "padded_rows": f"""
WITH {DIRTY}
SELECT page_id, row_idx, 2 AS n_cells, line FROM blank
UNION ALL SELECT page_id, 0, 5, '|Key||Balance|' FROM pages9 WHERE page_id % 9 <> 0
UNION ALL SELECT page_id, r, 5, CASE c_custkey % 4 WHEN 0 THEN chr(160) || '||||' WHEN 1 THEN '|' || k || '| |' || bal || '|'
  ELSE '|' || k || '| |' || bal || '|' || seg END FROM cust WHERE page_id % 9 <> 0""",
    "dropped_columns": f"""
WITH {DIRTY}
SELECT * FROM blank
UNION ALL SELECT page_id, 0, 'Key|Balance' || CASE WHEN hs THEN '|' ELSE '' END FROM has_seg WHERE page_id % 9 <> 0
UNION ALL SELECT page_id, r, CASE WHEN c_custkey % 4 = 0 THEN '|' ELSE k || '|' || bal END
  || CASE WHEN hs THEN '|' || CASE WHEN c_custkey % 4 IN (0, 1) THEN '' ELSE seg END ELSE '' END
FROM cust JOIN has_seg USING (page_id) WHERE page_id % 9 <> 0""",
    "promote_header_row": f"""
WITH {CUST}
SELECT page_id, CASE WHEN row_idx = least(15, n) THEN 0 WHEN row_idx < least(15, n) THEN row_idx + 1 ELSE row_idx END AS row_idx,
  c0 || '|' || c1 || '|' || c2 || '|' || c3 AS line FROM sheet""",
    "set_header": f"""
WITH {CUST}
SELECT page_id, CASE WHEN n >= 15 THEN row_idx - 15 ELSE row_idx END AS row_idx,
  c0 || '|' || c1 || '|' || c2 || '|' || c3 AS line FROM sheet WHERE n < 15 OR row_idx >= 15""",
    "rectangular_check": f"""
WITH {DIRTY}
SELECT page_id, 3 AS n_rows, 2 AS n_cols, FALSE AS is_rectangular, 1 AS first_bad_row FROM pages9 WHERE page_id % 9 = 0
UNION ALL SELECT page_id, max(n) + 1, 5, min(r) FILTER (c_custkey % 4 <= 1) IS NULL, min(r) FILTER (c_custkey % 4 <= 1)
FROM cust WHERE page_id % 9 <> 0 GROUP BY page_id""",
    "infer_types_corpus": ORDER_TYPES.format(cells=OCELLS),
    "merged_profiles": ORDER_TYPES.format(cells=OCELLS),
    "number_formats": f"""
WITH {CUST}
SELECT DISTINCT page_id, 'Key' AS header, 'numeric' AS type, ',' AS thousand, '.' AS decimal FROM cust
UNION ALL SELECT DISTINCT page_id, 'Balance', 'money', CASE WHEN eu THEN '.' ELSE ',' END, CASE WHEN eu THEN ',' ELSE '.' END
FROM cust WHERE bal <> ''""",
    "infer_types_wide": f"""
WITH {OCELLS}, n AS (SELECT col_idx, count(*) FILTER (v <> '') AS n_values FROM ocells GROUP BY 1)
SELECT x.i AS col_idx, header, type, thousand, decimal, n_values FROM (VALUES
 (0, 'Order', 'numeric', ',', '.'), (1, 'Total', 'money', '.', ','), (2, 'Date', 'date', NULL, NULL),
 (3, 'Level', 'numeric', ',', '.'), (4, 'Priority', 'categorical', NULL, NULL),
 (5, 'Buyer', 'numeric', ',', '.'), (6, 'Share', 'rate', '.', ',')) x(i, header, type, thousand, decimal)
JOIN n ON n.col_idx = x.i""",
    "pinned_types": """
SELECT x.i AS col_idx, header, type, thousand, decimal FROM (VALUES
 (0, 'Order', 'numeric', ',', '.'), (1, 'Total', 'money', ',', '.'), (2, 'Date', 'date', NULL, NULL),
 (3, 'Level', 'categorical', NULL, NULL), (4, 'Priority', 'categorical', NULL, NULL),
 (5, 'Buyer', 'rate', '.', ','), (6, 'Share', 'rate', '.', ',')) x(i, header, type, thousand, decimal)""",
    "header_types": f"""
WITH {OW}
SELECT page_id, x.i AS col_idx, header, type FROM (SELECT DISTINCT page_id FROM ow), (VALUES
 (0, 'Order', 'money'), (1, 'Total', 'money'), (2, 'Date', 'date'), (3, 'Level', 'numeric'),
 (4, 'Priority', 'categorical'), (5, 'Buyer', 'money'), (6, 'Share', 'percentage')) x(i, header, type)""",
    "parse_numbers": f"""
WITH {NUM_CASES}
SELECT o_orderkey,
  CASE c WHEN 0 THEN v WHEN 1 THEN round(-v / 1000, 5) WHEN 2 THEN -v WHEN 3 THEN round(v / 1000, 5) WHEN 4 THEN v WHEN 7 THEN floor(v) ELSE 0 END AS as_dot,
  CASE c WHEN 0 THEN round(v / 1000, 5) WHEN 1 THEN -v WHEN 2 THEN round(-v / 1000, 5) WHEN 3 THEN v WHEN 4 THEN round(v / 1000, 5) WHEN 7 THEN floor(v) ELSE 0 END AS as_comma,
  CASE c WHEN 0 THEN v WHEN 1 THEN round(-v / 1000, 5) WHEN 2 THEN -v WHEN 3 THEN round(v / 1000, 5) WHEN 4 THEN v WHEN 7 THEN floor(v) END AS or_null
FROM nums""",
    "parse_dates": """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 9 THEN o_orderdate::DATE END AS day FROM orders""",
    "money_values": """
SELECT o_orderkey, o_orderkey % 8 IN (0, 1, 3, 4) AS is_money FROM orders""",
    "format_numbers": f"""
WITH v AS (SELECT l_orderkey, l_extendedprice * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS v FROM lineitem)
SELECT l_orderkey, min({_tie("v", 0)}) AS plain, max({_swap(_tie("v", 1))}) AS eu, min({_tie("(v / 8)", 2)}) AS eighth
FROM v GROUP BY l_orderkey""",
    "filter_numeric": f'WITH {OW} SELECT "Order", "Total" FROM ow WHERE total0 <= 150000.5',
    "filter_date": """
WITH d AS (SELECT o_orderkey AS k, o_orderdate AS d, o_orderkey % 10 AS c FROM orders)
SELECT k AS o_orderkey, CASE c WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN strftime(d, '%-d-%-m-%Y') WHEN 2 THEN strftime(d, '%Y-%m-%d')
 WHEN 3 THEN strftime(d, '%Y/%-m/%-d') WHEN 4 THEN strftime(d, '%b %-d, %Y') WHEN 5 THEN strftime(d, '%-d %B %Y')
 WHEN 6 THEN strftime(d, '%d-%b-%Y')
 WHEN 7 THEN day(d) || ' de ' || ['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'][month(d)] || ' de ' || year(d)
 WHEN 8 THEN strftime(d, '%-d/%-m/%y') ELSE '32/01/' || year(d) END AS raw
FROM d WHERE c = 9 OR d::DATE BETWEEN DATE '1997-03-01' AND DATE '1998-06-30'""",
    "filter_categorical": f"""
WITH {OW} SELECT "Order", "Priority" FROM ow
WHERE "Priority" IN ('1-URGENT', '2-HIGH', '5-LOW') AND contains(lower("Priority"), 'hi')""",
    "filter_combined": f"""
WITH {OW} SELECT "Order" FROM ow
WHERE total0 BETWEEN 100000 AND 400000 AND day >= DATE '1996-01-01' AND contains(lower("Priority"), 'e')""",
    "filter_corpus": f"""
WITH {OW}
SELECT DISTINCT page_id, 0 AS row_idx, 'Order|Total|Date|Level|Priority|Buyer|Share' AS line FROM ow
UNION ALL SELECT page_id, r, "Order" || '|' || "Total" || '|' || "Date" || '|' || "Level" || '|' || "Priority" || '|' || "Buyer" || '|' || "Share"
FROM ow WHERE total0 >= 250000 AND "Priority" IN ('3-MEDIUM', '1-URGENT')""",
    "filter_sidecar": f"""
WITH {OW}
SELECT DISTINCT page_id, 0 AS row_idx, 'Order|Total|Date|Level|Priority|Buyer|Share' AS line FROM ow
UNION ALL SELECT page_id, r, "Order" || '|' || "Total" || '|' || "Date" || '|' || "Level" || '|' || "Priority" || '|' || "Buyer" || '|' || "Share"
FROM ow WHERE total0 >= 250000 AND day >= DATE '1996-01-01' AND "Priority" IN ('3-MEDIUM', '1-URGENT')""",
    "distinct_column_values": "SELECT DISTINCT p_name AS value FROM part",
    "stats_numeric": f"""
WITH {OW}, long AS ({_long(_numeric("Total", "price", "ok % 13 <> 0") + _numeric("Share", "share0") + _numeric("Buyer", "buyer0") + _numeric("Order", "ok") + _numeric("Level", '"Level"::INT') + [("Date", "count", "count(*)::DOUBLE"), ("Priority", "count", "count(*)::DOUBLE")], "ow", "page_id")})
SELECT page_id, header, stat, round(num_value, 4) AS num_value FROM long""",
    "stats_date": f"""
WITH {OW}
SELECT page_id, h AS header, 'count' AS stat, NULL::DATE AS date_value, (count(*) FILTER (h <> 'Total' OR ok % 13 <> 0))::INT AS num_value
FROM ow, (SELECT unnest(['Order', 'Total', 'Date', 'Level', 'Priority', 'Buyer', 'Share']) AS h) GROUP BY 1, 2
UNION ALL SELECT page_id, 'Date', 'earliest', min(day), NULL FROM ow GROUP BY 1
UNION ALL SELECT page_id, 'Date', 'latest', max(day), NULL FROM ow GROUP BY 1
UNION ALL SELECT page_id, 'Date', 'range', NULL, CASE WHEN count(*) < 2 THEN 0 ELSE (max(day) - min(day))::INT END FROM ow GROUP BY 1""",
    "stats_categorical": f"""
WITH {OCELLS}, {MODES.format(by="page_id, header")}
SELECT page_id, header, 'unique' AS stat, u::INT AS num_value, NULL AS text_value, NULL::INT AS extra FROM modes
UNION ALL SELECT page_id, header, 'mode', NULL, mode, others::INT FROM modes""",
    "stats_wide": f"""
WITH {OCELLS}, {MODES.format(by="header")},
long AS ({_long(_numeric("Order", "ok") + _numeric("Total", "price", "ok % 13 <> 0") + _numeric("Level", '"Level"::INT') + _numeric("Buyer", "buyer0") + _numeric("Share", "share0") + [("Date", "count", "count(*)"), ("Date", "range", "max(day) - min(day)"), ("Priority", "count", "count(*)")], "ow")})
SELECT header, stat, round(num_value::DOUBLE, 2) AS num_value, NULL::DATE AS date_value, NULL AS text_value, NULL::INT AS extra FROM long
UNION ALL SELECT 'Date', 'earliest', NULL, min(day), NULL, NULL FROM ow
UNION ALL SELECT 'Date', 'latest', NULL, max(day), NULL, NULL FROM ow
UNION ALL SELECT header, 'unique', u, NULL, NULL, NULL FROM modes
UNION ALL SELECT header, 'mode', NULL, NULL, mode, others::INT FROM modes""",
    "stats_panel": f"""
WITH {OCELLS}, {MODES.format(by="header")}
SELECT 0 AS col_idx, 'Order' AS header, 'count' AS stat, count(*)::DOUBLE AS num_value, NULL AS text_value FROM ow
UNION ALL SELECT 1, 'Total', 'sum', round(sum(price) FILTER (ok % 13 <> 0), 3), NULL FROM ow
UNION ALL SELECT 2, 'Date', 'range', max(day) - min(day), NULL FROM ow
UNION ALL SELECT 3, 'Level', 'count', count(*), NULL FROM ow
UNION ALL SELECT 4, 'Priority', 'mode', NULL, mode FROM modes WHERE header = 'Priority'
UNION ALL SELECT 5, 'Buyer', 'count', count(*), NULL FROM ow
UNION ALL SELECT 6, 'Share', 'avg', round(avg(share0), 3), NULL FROM ow""",
    "stats_panel_corpus": f"""
WITH {OW}, long AS ({_long([("Order", "count", "count(*)::DOUBLE"), ("Total", "max", "max(price) FILTER (ok % 13 <> 0)"), ("Date", "count", "count(*)"), ("Level", "count", "count(*)"), ("Priority", "unique", 'count(DISTINCT "Priority")'), ("Buyer", "count", "count(*)"), ("Share", "avg", "avg(share0)")], "ow", "page_id")})
SELECT page_id, header, stat, round(num_value, 4) AS num_value FROM long""",
    "stats_display": f"""
WITH {OCELLS}, {MODES.format(by="page_id, header")},
m AS (SELECT page_id, header, u::VARCHAR AS u, mode || CASE WHEN others > 0 THEN ' (+' || others || ')' ELSE '' END AS mode
      FROM modes WHERE header IN ('Total', 'Date', 'Priority')),
t AS (SELECT page_id, count(*) FILTER (ok % 13 <> 0) AS c, min(price) FILTER (ok % 13 <> 0) AS lo, max(price) FILTER (ok % 13 <> 0) AS hi,
   count(*) AS n, min(day) AS first, max(day) - min(day) AS days FROM ow GROUP BY 1)
SELECT page_id, header, 'unique' AS stat, u AS shown FROM m
UNION ALL SELECT page_id, header, 'mode', mode FROM m
UNION ALL SELECT page_id, 'Total', 'count', c::VARCHAR FROM t
UNION ALL SELECT page_id, 'Total', 'min', '$ ' || {_swap(_tie("lo", 0))} FROM t
UNION ALL SELECT page_id, 'Total', 'max', '$ ' || {_swap(_tie("hi", 0))} FROM t
UNION ALL SELECT page_id, 'Date', 'count', n::VARCHAR FROM t
UNION ALL SELECT page_id, 'Priority', 'count', n::VARCHAR FROM t
UNION ALL SELECT page_id, 'Date', 'earliest', strftime(first, '%-m/%-d/%Y') FROM t
UNION ALL SELECT page_id, 'Date', 'range', CASE WHEN days = 0 THEN 'N/A' ELSE days || ' days' END FROM t""",
    "sort_numeric": f'WITH {OW} SELECT "Order", row_number() OVER (ORDER BY total0 DESC, row_idx) AS pos FROM ow',
    "sort_text": """
WITH p AS (SELECT p_partkey + 1 AS row_idx, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part)
SELECT row_idx, row_number() OVER (ORDER BY icu_sort_key(name, 'en'), row_idx) AS pos FROM p""",
    "filter_then_sort": f"""
WITH {OW} SELECT "Order", row_number() OVER (ORDER BY day, row_idx) AS pos FROM ow WHERE "Priority" = '2-HIGH'""",
    "row_numbers": """
SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS row_idx
FROM lineitem""",
    "chart_series": f"""
WITH {OW}, f AS (SELECT * FROM ow WHERE share0 <= 20)
SELECT 'Total' AS series, row_idx, "Date" AS label, total0 AS y FROM f
UNION ALL SELECT 'Buyer', row_idx, "Date", buyer0::DOUBLE FROM f""",
    "scatter_points": f"WITH {OW} SELECT 'Total' AS series, row_idx, share0::DOUBLE AS x, total0 AS y FROM ow",
    "export_csv": """
SELECT o_orderkey // 50 AS page_id, o_orderkey % 50 AS line_no,
  o_orderkey || ',"a,' || o_orderpriority || '",' ||
  CASE o_orderkey % 3 WHEN 0 THEN '"say ""x""' || '"' WHEN 1 THEN '"p|q' || chr(13) || chr(10) || 'r"' ELSE 't' || chr(9) || 'u' END ||
  ',' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS line FROM orders""",
    "export_written": """
SELECT nullif(o_orderkey // 50, 0) AS page_id, o_orderkey % 50 AS line_no,
  o_orderkey || ',"a,' || o_orderpriority || '",' ||
  CASE o_orderkey % 3 WHEN 0 THEN '"say ""x""' || '"' WHEN 1 THEN '"p|q' || chr(13) || chr(10) || 'r"' ELSE 't' || chr(9) || 'u' END ||
  ',' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS line FROM orders""",
    "export_tsv": """
SELECT o_orderkey // 50 AS page_id, o_orderkey % 50 AS line_no,
  o_orderkey || chr(9) || 'a,' || o_orderpriority || chr(9) ||
  CASE o_orderkey % 3 WHEN 0 THEN '"say ""x""' || '"' WHEN 1 THEN '"p|q' || chr(13) || chr(10) || 'r"' ELSE '"t' || chr(9) || 'u"' END ||
  chr(9) || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS line FROM orders""",
    "export_md": """
SELECT o_orderkey // 50 AS page_id, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_orderkey % 50 + 1 END AS line_no,
  '| ' || o_orderkey || ' | a,' || o_orderpriority || ' | ' ||
  CASE o_orderkey % 3 WHEN 0 THEN 'say "x"' WHEN 1 THEN 'p\\|q r' ELSE 't' || chr(9) || 'u' END ||
  ' | ' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END || ' |' AS line FROM orders
UNION ALL SELECT o_orderkey // 50, 1, '| --- | --- | --- | --- |' FROM orders WHERE o_orderkey % 50 = 0""",
    "export_manifest": """
WITH t AS (SELECT o_custkey, o_orderkey AS k, o_orderpriority AS p,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders)
SELECT o_custkey AS page_id, k::INT AS table_idx, position,
  CASE WHEN k % 2 = 0 THEN substr('Q1' || p || ' orders and returns', 1, 20) ELSE 'Table' END || '_' || position AS sheet_name,
  'shop' || o_custkey || '_all_tables_2024-01-31' AS export_name
FROM t WHERE k % 6 > 0""",
    "apply_view_rows": f"""
WITH {OW} SELECT "Order", "Total", row_number() OVER (ORDER BY total0 DESC, row_idx) AS pos FROM ow WHERE {VIEW_WHERE}""",
    "apply_view_stats": f"""
WITH {OW}, f AS (SELECT * FROM ow WHERE {VIEW_WHERE})
SELECT 'Order' AS header, 'count' AS stat, count(*)::DOUBLE AS num_value, NULL::DATE AS date_value FROM f
UNION ALL SELECT 'Total', 'max', max(price) FILTER (ok % 13 <> 0), NULL FROM f
UNION ALL SELECT 'Date', 'earliest', NULL, min(day) FROM f
UNION ALL SELECT 'Level', 'count', count(*), NULL FROM f
UNION ALL SELECT 'Priority', 'count', count(*), NULL FROM f
UNION ALL SELECT 'Buyer', 'count', count(*), NULL FROM f
UNION ALL SELECT 'Share', 'avg', round(avg(share0), 3), NULL FROM f""",
    "apply_view_series": f"""
WITH {OW} SELECT 'Total' AS series, row_idx, "Date" AS label, total0 AS y FROM ow WHERE {VIEW_WHERE}""",
    "view_series_sorted": f"""
WITH {OW} SELECT 'Total' AS series, row_number() OVER (ORDER BY total0 DESC, row_idx) AS pos, "Date" AS label, total0 AS y
FROM ow WHERE {VIEW_WHERE}""",
    "view_export_csv": _view_lines("','"),
    "view_export_tsv": _view_lines("chr(9)"),
    "view_export_md": f"""
WITH {OW}, v AS (SELECT *, row_number() OVER (ORDER BY total0 DESC, row_idx) AS pos FROM ow WHERE {VIEW_WHERE})
SELECT 0 AS line_no, '| {" | ".join(VIEW_COLUMNS)} |' AS line
UNION ALL SELECT 1, '| {" | ".join("---" for _ in VIEW_COLUMNS)} |'
UNION ALL SELECT pos + 1, '| ' || concat_ws(' | ', {", ".join(f'"{c}"' for c in VIEW_COLUMNS)}) || ' |' FROM v""",
    "filter_zero_bound": "SELECT c_custkey FROM customer WHERE c_acctbal >= 0",
    "json_errors": """
SELECT c_custkey AS page_id, 0 AS table_idx, '3:2' AS said FROM customer WHERE c_custkey % 3 <> 2
UNION ALL SELECT c_custkey, 1, 'not a table' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, NULL, 'no list of tables' FROM customer WHERE c_custkey % 3 = 2""",
    "monthly_usage_instants": """
SELECT o_custkey AS user, o_orderstatus AS action, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS used
FROM orders GROUP BY ALL""",
    "container_rank": """
SELECT c_custkey AS page_id, 1 AS table_idx, false AS is_container, 1 AS rank FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, x.i, false, x.i FROM customer, (VALUES (1), (2)) x(i) WHERE c_custkey % 2 = 1""",
    "one_table": f"""
WITH {OW} SELECT 0 AS row_idx, '{"|".join(VIEW_COLUMNS)}' AS line
UNION ALL SELECT r, concat_ws('|', {", ".join(f'"{c}"' for c in VIEW_COLUMNS)}) FROM ow WHERE page_id = 1""",
    "html_wide_span": """
SELECT s_suppkey AS page_id, x.i AS row_idx, s_suppkey % 7 * 300 + 2 AS n_cells
FROM supplier, (VALUES (0), (1)) x(i)""",
    "html_huge_span": """
SELECT s_suppkey AS page_id, x.i AS row_idx, 200000001 + s_suppkey % 7 AS width,
  CASE WHEN x.i = 0 THEN 'a||b' ELSE '|' || s_suppkey || '|' END AS line
FROM supplier, (VALUES (0), (1)) x(i)""",
    "saved_view_rows": f"""
WITH {OW}
SELECT 'v' || page_id AS view_id, page_id, r AS row_idx, row_number() OVER (PARTITION BY page_id ORDER BY total0 DESC, r) AS pos
FROM ow WHERE page_id % 3 = 0 AND total0 >= 250000 AND "Priority" IN ('3-MEDIUM', '1-URGENT')
UNION ALL SELECT 'v' || page_id, page_id, r, row_number() OVER (PARTITION BY page_id ORDER BY r)
FROM ow WHERE page_id % 3 = 1 AND day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
UNION ALL SELECT 'v' || page_id, page_id, r, row_number() OVER (PARTITION BY page_id ORDER BY "Priority", r)
FROM ow WHERE page_id % 3 = 2""",
    "saved_view_stats": f"""
WITH {OW}
SELECT 'v' || page_id AS view_id, page_id, 'Total' AS header, 'max' AS stat, max(price)::DOUBLE AS num_value, NULL::DATE AS date_value
FROM ow WHERE page_id % 3 = 0 AND total0 >= 250000 AND "Priority" IN ('3-MEDIUM', '1-URGENT') GROUP BY page_id
UNION ALL SELECT 'v' || page_id, page_id, 'Date', 'earliest', NULL, min(day)
FROM ow WHERE page_id % 3 = 1 AND day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY page_id
UNION ALL SELECT 'v' || page_id, page_id, 'Priority', 'unique', count(DISTINCT "Priority"), NULL FROM ow WHERE page_id % 3 = 2 GROUP BY page_id""",
    "view_fingerprint": f"""
WITH {OW} SELECT 'Order|Total|Date|Level|Priority|Buyer|Share_' || (SELECT count(*) FROM ow) || 'x7_' ||
  replace("Order" || '|' || "Total" || '|' || "Date", ' ', '') AS fingerprint FROM ow WHERE row_idx = 1""",
    "upsert_by_key": """
WITH e AS (SELECT 'id' || c_custkey AS id, c_custkey::VARCHAR AS name, c_custkey AS position FROM customer),
i AS (SELECT (o_custkey + CASE WHEN o_orderkey % 2 = 1 THEN 10000000 ELSE 0 END)::VARCHAR AS name,
  min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1)
SELECT coalesce(e.id, 'new' || lo) AS id, name,
  coalesce(e.position, (SELECT max(position) FROM e) + lo - (SELECT min(lo) FROM i) + 1) AS position,
  coalesce(hi + 1, 0) AS saved_at, coalesce('state ' || hi, 'first') AS state
FROM e FULL JOIN i USING (name)""",
    "keep_latest": """
SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20""",
    "keep_latest_overall": "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 50",
    "expire": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'",
    "monthly_usage": """
SELECT o_custkey AS user, o_orderstatus AS action, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS used
FROM orders WHERE o_orderkey % 5 > 0 AND o_custkey % 10 <> 0 GROUP BY ALL""",
    "quota_status": """
WITH u AS (SELECT user_id AS user, event_type AS action, strftime(ts, '%Y-%m') AS month, count(*) AS c FROM events GROUP BY ALL),
m AS (SELECT *, CASE WHEN user % 7 = 0 THEN NULL ELSE CASE action WHEN 'view' THEN 15 WHEN 'click' THEN 25 WHEN 'purchase' THEN 5 END END AS max FROM u)
SELECT user, action, month, least(c, max) AS used, max, max - least(c, max) AS remaining,
  coalesce(c < max, TRUE) AS allowed, coalesce(least(c, max) = max - 1, FALSE) AS near_limit,
  (strptime(month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH)::DATE AS resets_on FROM m""",
    "next_reset_day": """
SELECT o_orderkey, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS resets_on FROM orders""",
    "trimmed_text": f"""
SELECT conv_id, turn, length(t) AS n_chars, md5(t) AS digest FROM (SELECT conv_id, turn,
  trim(chr(65279) || chr(160) || ' ' || chr(9) || role || chr(12288) || chr(10) || text || chr(8195) || ' ', {WS}) AS t
  FROM conversations)""",
}
