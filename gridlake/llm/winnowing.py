"""Winnowed fingerprints of texts, in DataFrame functions only.

Tokens, in lower case, are words (runs of characters that are not white space) of at most
sixteen characters, and every single character of longer runs, so that a shift inside a text
without spaces moves all tokens alike.  Each token is hashed once; hashes of ``k`` neighbouring
tokens roll over the text, and a window of ``w`` of them slides along; each window keeps its
least hash, the rightmost of equal ones.  Any passage of ``w + k - 1`` tokens that two texts
share therefore gives both a common hash.  A kept value holds 32 bits of hash above 31 bits of
reversed position, more than an array has elements, so that the least value is the least hash
and, among equals, the rightmost; every kept position can be read back from it.

Defined results: null counts as an empty text, which keeps nothing; two empty fingerprints
are alike (1), an empty and another are not (0); a text with fewer tokens than ``k`` is one
hash; equal texts have equal fingerprints; texts of any length are read whole, in linear time;
repeated rows stay rows of their own, each followed by the next; an empty table gives no rows;
other columns, whatever their names, are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.grid import number_rows
from ..plans.staging import stage

POSITION_BITS = 31
HASH_BITS = 63 - POSITION_BITS
_TOP = (1 << POSITION_BITS) - 1
#: texts of 2 ** BLOCK_BITS neighbouring ids are lined up in one window
BLOCK_BITS = 6
#: runs of more characters are taken character by character
WORD = 16


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"((?<!\S)\S{{1,{WORD}}}+(?!\S)|\S)"))


def winnow(text: Column, k: int = 5, w: int = 12) -> Column:
    """Kept values of a text in order of position."""

    def slide(items: Column, size: int, value) -> Column:
        last = F.greatest(F.size(items) - size, F.lit(0))
        return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), last), value)).otherwise(
            F.array().cast("array<bigint>")
        )

    def named(items: Column, hashes) -> Column:
        """Bind ``items`` once, so that it is not computed anew for each use."""
        return F.flatten(F.transform(F.array(items), hashes))

    def grams(items: Column) -> Column:
        return slide(
            items,
            k,
            lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(*(F.get(items, i + j) for j in range(k))), 64 - HASH_BITS), POSITION_BITS)
            + (F.lit(_TOP) - i),
        )

    def least(values: Column) -> Column:
        return F.array_distinct(slide(values, w, lambda i: F.array_min(F.slice(values, i + 1, F.lit(w)))))

    return named(named(F.transform(tokens(text), lambda t: F.xxhash64(t)), grams), least)


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda v: F.shiftrightunsigned(v, POSITION_BITS)))


def positions(kept: Column) -> Column:
    return F.transform(kept, lambda v: (F.lit(_TOP) - F.pmod(v, F.lit(_TOP + 1))).cast("int"))


def fingerprint(kept: Column) -> Column:
    """Kept hashes as hexadecimal text, in order of position."""
    return F.array_join(
        F.transform(kept, lambda v: F.lower(F.lpad(F.hex(F.shiftrightunsigned(v, POSITION_BITS)), HASH_BITS // 4, "0"))), ","
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


BLOCK = ["block", "part", "slice"]


def _blocks(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``base`` with its block of neighbouring ids, and all blocks.

    A block has no more rows than ids unless ids repeat or are null; such a block is split by id and
    by hash of the text, so that no id gathers all its rows in one task.
    """
    base = base.withColumn("block", F.coalesce(F.shiftright("doc_id", BLOCK_BITS), F.lit(-(1 << 62))))
    sizes = stage(base.groupBy("block").agg(F.count("*").alias("rows")), "blocks")
    crowded = sizes.where(F.col("rows") > 1 << BLOCK_BITS).select("block", F.lit(True).alias("crowded"))
    nothing = [F.lit(0).cast("long").alias(c) for c in BLOCK[1:]]
    if crowded.isEmpty():
        return base.select("*", *nothing), sizes.select("block", *nothing)
    base = base.join(crowded, "block", "left")  # a written table of its crowded blocks: Spark checks its size
    part = F.when(F.col("crowded"), F.coalesce(F.col("doc_id").bitwiseAND((1 << BLOCK_BITS) - 1), F.lit(0)))
    piece = F.when(F.col("crowded"), F.shiftrightunsigned(F.xxhash64("text"), 52))
    base = base.withColumns({"part": F.coalesce(part, F.lit(0)), "slice": F.coalesce(piece, F.lit(0))}).drop("crowded")
    return base, base.select(*BLOCK).distinct()


def _chain(blocks: DataFrame) -> DataFrame:
    """Each block and the one ``after`` it, in falling order of ids; the last is followed by the first."""
    lined = number_rows(blocks, [F.desc("block"), F.desc("part"), F.asc("slice")], "at")
    follows = (F.pmod(F.col("at"), F.lit(max(lined.count(), 1))) + 1).alias("next_at")
    after = lined.select(F.col("at").alias("next_at"), F.struct(*BLOCK).alias("after"))
    return lined.select(*BLOCK, follows).join(after, "next_at").select(*BLOCK, "after")


def with_next(docs: DataFrame, id_col: str, text_col: str, values: dict[str, Column]) -> DataFrame:
    """``doc_id, text``, each of ``values`` (computed from ``text``), and ``next_`` of all, in falling id order.

    Texts are exchanged once, by blocks of neighbouring ids; of each block only the first text travels
    again.  Rows of one id are ordered by text, in blocks of more rows than ids by its hash first; null ids come last.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base, blocks = _blocks(base)
    order = Window.partitionBy(*BLOCK).orderBy(F.desc_nulls_last("doc_id"), "text")
    heads = base.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    heads = heads.select("*", *(v.alias(c) for c, v in values.items()))
    names = ["text", *values]
    firsts = heads.select(F.struct(*BLOCK).alias("after"), *(F.col(c).alias(f"first_{c}") for c in names))
    firsts = _chain(blocks).join(firsts, "after").drop("after")
    lined = base.withColumn("next_text", F.lead("text").over(order))
    lined = lined.select("*", *(v.alias(c) for c, v in values.items()))
    lined = lined.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in values))
    joined = lined.join(firsts, BLOCK)
    return joined.select("doc_id", *names, *(F.coalesce(f"next_{c}", f"first_{c}").alias(f"next_{c}") for c in names))


def compare_edited(docs: DataFrame, k: int = 5, w: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, whose last third comes from the next text."""
    pairs = with_next(docs, id_col, text_col, {"kept": winnow(F.col("text"), k, w)})
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    pairs = pairs.withColumn("edited_kept", winnow(F.col("edited"), k, w)).withColumn("own", hashes(F.col("kept")))
    return pairs.select(
        "doc_id",
        "text",
        "edited",
        "kept",
        "edited_kept",
        fingerprint(F.col("kept")).alias("fingerprint"),
        fingerprint(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes(F.col("edited_kept"))).alias("near_edited"),
        likeness(F.col("own"), hashes(F.col("next_kept"))).alias("near_next"),
    )
