"""DuckDB counterparts of the numbered queries, where SQL can express them on whole tables.

Secrets, personal data and licences report spans that patterns without lookaround cannot find; fingerprints and
byte pairs hash or iterate; scores and packing are not relational.
"""

_BLANK = "'[ \\t\\n\\x0B\\f\\r]+'"


def _words(text: str) -> str:
    """One row per word of every document: ``doc_id, pos, word``; and ``d``, the word lists."""
    return f"""
d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({text}, ''), {_BLANK}), lambda x: x <> '') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d)"""


#: from ``links`` (a, b): every row's least reachable id
_REACH = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least AS (SELECT a, min(b) AS least FROM reach GROUP BY a)"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op7_ngram_jaccard_join": f"""
WITH RECURSIVE {_words(_LOWER)},
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, string_agg(word, ' ') OVER w AS shingle, count(*) OVER w AS n FROM e
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
judged AS (SELECT a, b, c = p.n AND c = q.n AS same FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
links AS (SELECT a, b FROM judged),
{_REACH},
classes AS (SELECT b, min(a) AS class_id FROM judged WHERE same GROUP BY b)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, coalesce(class_id, d.doc_id) AS class_id,
  coalesce(least(least.least, d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN classes ON classes.b = d.doc_id LEFT JOIN least ON least.a = d.doc_id""",
    "op8_pivot_permutation": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id
  WHERE len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.95),
{_REACH},
counts AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(least.least, vec_id), vec_id) AS component_id,
  vec_id = coalesce(least(least.least, vec_id), vec_id) AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id""",
    "op9_substring_dedup": f"""
WITH {_words("text")},
windows AS (
  SELECT doc_id, pos, h FROM (
    SELECT doc_id, pos, md5(string_agg(word, ' ') OVER w) AS h, count(*) OVER w AS n FROM e
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) WHERE n = 35),
repeated AS (SELECT doc_id, pos FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM repeated, range(0, 35) t(j)),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.pos) AS text FROM e ANTI JOIN gone USING (doc_id, pos) GROUP BY e.doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(removed.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)""",
    "op13_vector_file_search": """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score, c.r AS other
  FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) AS n FROM pairs)
SELECT query_id, n::INT AS rank, vec_id, score FROM ranked WHERE n <= 20""",
}
