"""Byte-level BPE by DuckDB recursive queries inside Spark tasks.

Texts are cut into pieces by the tokenizer's pattern.  Each Python worker holds a small
DuckDB database with the merge table: all pairs of tokens whose joined bytes are a token,
with its rank.  New pieces of a batch become token-position rows; a recursive query joins
neighbours with the merge table and contracts the leftmost pair of least rank of every
piece until none is left; a piece that is a token skips the query.  Pieces repeat, so the ids of
recent units are remembered, ``UNITS`` per worker at most.  Decoding starts from the ids of each
document as they are returned: their token-position rows join the vocabulary, and an ordered aggregate
per document puts the bytes together.

Defined results: null and empty texts have no tokens and decode to nothing; ties take the
leftmost pair; long pieces contract all places of the least pair at once where that cannot
change the result; other columns are kept out.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import process_memo, slices, texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: units (a space and what follows it, cut before punctuation after a letter) a worker remembers, in two generations
UNITS = 1_200_000
#: a mark after one of these letters starts a piece in any case
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!\"#$%&()*+,./:;<=>?@\[\\\]^`{|}~\-"
#: pieces of more bytes than this contract many places in one round
LONG = 48
#: pieces handed to one recursive query
ROUND = 30_000
# Unicode white space as the Rust regular expressions read it.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

CONTRACT = """
WITH RECURSIVE state(w, p, t, live) AS (
  SELECT w, p, t, true FROM start_rows
  UNION ALL
  (WITH pairs AS (
     SELECT s.w, s.p, s.t, s.prev, m.r
     FROM (SELECT w, p, t, lead(t) OVER x AS t2, lag(p) OVER x AS prev
           FROM state WHERE live WINDOW x AS (PARTITION BY w ORDER BY p)) s
     LEFT JOIN merges m ON m.a = s.t AND m.b = s.t2),
   best AS (SELECT w, min(r::BIGINT * 1048576 + p) AS k FROM pairs GROUP BY w)
   SELECT pairs.w, pairs.p,
          CASE WHEN best.k IS NOT NULL AND pairs.p = (best.k & 1048575) THEN (best.k >> 20)::INT ELSE t END,
          best.k IS NOT NULL
   FROM pairs JOIN best USING (w)
   WHERE best.k IS NULL OR prev IS NULL OR prev IS DISTINCT FROM (best.k & 1048575))
)
SELECT w, p, t FROM state WHERE NOT live
"""

#: the same for long pieces; `many` marks ranks no token of which is part of an earlier one, so
#: that all its places (every second one in a run) may be contracted together
CONTRACT_LONG = """
WITH RECURSIVE state(w, p, t, live) AS (
  SELECT w, p, t, true FROM start_rows
  UNION ALL
  (WITH pairs AS (
     SELECT s.w, s.p, s.t, s.n, m.r, coalesce(m.many, false) AS many
     FROM (SELECT w, p, t, row_number() OVER x AS n, lead(t) OVER x AS t2
           FROM state WHERE live WINDOW x AS (PARTITION BY w ORDER BY p)) s
     LEFT JOIN merges m ON m.a = s.t AND m.b = s.t2),
   best AS (SELECT w, min(r) AS r FROM pairs GROUP BY w),
   hits AS (
     SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY n) AS nth, min(n) OVER (PARTITION BY w) AS first_n
     FROM (SELECT pairs.w, n, many, n - row_number() OVER (PARTITION BY pairs.w ORDER BY n) AS run
           FROM pairs JOIN best ON best.w = pairs.w AND best.r = pairs.r)),
   taken AS (SELECT w, n FROM hits WHERE n = first_n OR many AND nth % 2 = 1)
   SELECT pairs.w, pairs.p, CASE WHEN h.n IS NOT NULL THEN best.r ELSE pairs.t END, best.r IS NOT NULL
   FROM pairs JOIN best ON best.w = pairs.w
   LEFT JOIN taken h ON h.w = pairs.w AND h.n = pairs.n
   LEFT JOIN taken e ON e.w = pairs.w AND e.n + 1 = pairs.n
   WHERE e.n IS NULL)
)
SELECT w, p, t FROM state WHERE NOT live
"""

#: bytes travel as the characters of the same numbers
DECODE = """
SELECT d, string_agg(v.bytes, '' ORDER BY p) AS decoded FROM ids JOIN vocabulary v USING (t) GROUP BY d
"""

IDS = "SELECT w, string_agg(t::VARCHAR, ',' ORDER BY p) AS ids FROM coded GROUP BY w"


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int, bool]]:
    """(left id, right id, joined id, many) of every pair of tokens whose joined bytes are a token."""
    rows = [
        (left, right, rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
    ]
    early = {part for left, right, rank in rows for part in (left, right) if rank < part}
    return [(a, b, r, r not in early) for a, b, r in rows]


class _Coder:
    """The worker's DuckDB database and the units it has coded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        white = pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")
        self.pieces = regex.compile(white).findall
        rest = f"[^{WHITE}{MARKS}]*+(?:(?<![{LETTERS}])[{MARKS}][^{WHITE}{MARKS}]*+)*+"
        # a tokenizer whose pattern runs on from letters into marks gets units cut at white space only
        marked = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'_")
        if any(regex.match(white, f"{before}{c}{after}").end() > len(before) for c in marked for before in ("ab", " é") for after in ("", "x", c)):
            rest = f"[^{WHITE}]*+"
        self.units = re.compile(f" ?[^{WHITE}]{rest}|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
        word = regex.compile(white)
        self.whole = all(word.fullmatch(f"{a}{b}") for a in ("", " ") for b in ("a", "aZ", "éß", "ab日"))
        self.ranks = ranks
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # nothing goes to a machine's own disk
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        a, b, r, many = zip(*merge_rows(ranks))
        int32 = pa.int32()
        merges = pa.table({"a": pa.array(a, int32), "b": pa.array(b, int32), "r": pa.array(r, int32), "many": pa.array(many)})
        vocabulary = pa.table({"t": pa.array(ranks.values(), int32), "bytes": pa.array([k.decode("latin-1") for k in ranks])})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("incoming", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
            self.db.unregister("incoming")
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def _rows(self, query: str, pieces: list[tuple[int, bytes]]) -> pa.Table:
        lengths = np.array([len(x) for _, x in pieces])
        starts = np.cumsum(lengths) - lengths
        table = pa.table(
            {
                "w": np.repeat(np.array([i for i, _ in pieces], np.int32), lengths),
                "p": (np.arange(lengths.sum()) - np.repeat(starts, lengths)).astype(np.int32),
                "t": self.single[np.frombuffer(b"".join(x for _, x in pieces), np.uint8)],
            }
        )
        self.db.register("start_rows", table)
        return self.db.sql(query).to_arrow_table()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, joined by commas."""
        coded, short, long = [], [], []
        out: list = [None] * len(pieces)
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:  # a token as it stands
                out[i] = b"%d" % rank
            else:
                (long if len(piece) > LONG else short).append((i, piece))
        schema = pa.schema([("w", pa.int32()), ("p", pa.int32()), ("t", pa.int32())])
        for query, some in ((CONTRACT, short), (CONTRACT_LONG, long)):
            for k in range(0, len(some), ROUND):
                coded.append(self._rows(query, some[k : k + ROUND]).cast(schema))
        if not coded:
            return out
        self.db.register("coded", pa.concat_tables(coded))
        got = self.db.sql(IDS).to_arrow_table()
        for w, ids in zip(*(got.column(c).to_pylist() for c in ("w", "ids"))):
            out[w] = ids.encode()
        return out

    def decode(self, lines: list[bytes], counts: list[int]) -> list[bytes]:
        """The bytes of each document's ids, given joined by commas."""
        n = np.array(counts, np.int64)
        ids = np.fromstring(b",".join(x for x in lines if x), np.int32, sep=",") if n.sum() else np.zeros(0, np.int32)
        documents = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.db.register("ids", pa.table({"d": documents, "p": np.arange(len(ids), dtype=np.int32), "t": ids}))
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("ids")
        out = [b""] * len(n)
        for d, decoded in zip(got.column("d").to_pylist(), got.column("decoded").to_pylist()):
            out[d] = decoded.encode("latin-1")
        return out

    def learn(self, units: set[str]) -> None:
        if len(self.known) > UNITS // 2:
            self.older, self.known = self.known, {}
        new = [u for u in units if not self._remembered(u)]
        split = [[u] if self.whole and u[u[0] == " " :].isalpha() else self.pieces(u) for u in new]
        order = [p for p in {p: None for parts in split for p in parts} if not self._remembered(p)]
        self.known.update(zip(order, self.encode_pieces([p.encode() for p in order])))
        for unit, parts in zip(new, split):
            if len(parts) > 1:
                self.known[unit] = b",".join([self.known[p] for p in parts])

    def _remembered(self, unit: str) -> bool:
        if unit in self.known:
            return True
        value = self.older.get(unit)
        if value is not None:
            self.known[unit] = value
        return value is not None


def _coder(rank_file: bytes, pattern: str) -> _Coder:
    memo = process_memo("bpe")
    if memo.get("key") != (rank_file, pattern):
        memo.clear()
        memo.update(key=(rank_file, pattern), coder=_Coder(load_ranks(rank_file), pattern))
    return memo["coder"]


def _encoder(rank_file: bytes, pattern: str, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(rank_file, pattern)
        for batch in slices(batches, 1, batch_bytes):
            found = [coder.units(t) for t in texts(batch.column(1))]
            coder.learn(set().union(*found))
            ids = [b",".join(map(coder.known.__getitem__, units)) for units in found]
            counts = [line.count(b",") + 1 if line else 0 for line in ids]
            del found
            decoded = coder.decode(ids, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()).cast(pa.string()), pa.array(decoded, pa.binary())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return run


def encode_documents(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20
) -> DataFrame:
    """``doc_id, n_tokens, ids`` (decimal, joined by commas) and ``decoded`` (bytes) of every text.

    The rank file is read once by the driver; its size, under 1 MB, bounds what travels to executors.
    """
    with open(rank_file, "rb") as f:
        data = f.read()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_encoder(data, pattern, batch_bytes), "doc_id long, n_tokens long, ids string, decoded binary")
