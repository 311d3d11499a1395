"""A training-data pipeline over the documents table.

Toxic documents go, one document of each group of near duplicates stays, passages that repeat
are taken out, personal data is masked, and what is left is packed into sequences.  Each stage
takes all rows that its predecessor kept and is written as Parquet before the next reads it.
All but the last return the columns they were given, in their order; columns the pipeline does
not know pass through, whatever their names.

Defined results: a null text is scored, compared and masked as an empty one and stays null
through the first two stages; of near duplicates exactly one row stays, one without an id only if none
has an id; blank texts are no near duplicates; documents that lose all words stay, empty; ``n_chars`` follows the text where the column is there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import ngram_join, packing, pii, queries, recompression, toxicity
from gridlake.plans.staging import remove_stages, stage, stages_listed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: learned scores and graph components have no SQL counterpart
ORACLE_SQL = None


#: folders that the stage before staged for its result, which is written when the next begins
_staged: list[str] = []


def stage_of(function: Stage) -> Stage:
    """The stage, which first removes what the one before staged, unless ``docs`` still reads it."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _staged and not any(f"{path}/" in name for name in docs.inputFiles() for path in _staged):
            remove_stages(spark, _staged)
            _staged.clear()
        with stages_listed() as made:
            out = function(spark, docs, sf_dir)
        _staged.extend(made)
        return out

    return run_stage


def _numbered(df: DataFrame) -> DataFrame:
    """The same columns named by position, so that no name can clash."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def _with_text(df: DataFrame, columns: list[str], rest: list[str], text: Column) -> DataFrame:
    """``columns`` of a numbered frame whose first ones are ``rest``, with a new text and its length."""
    at = {c: F.col(f"_{i}") for i, c in enumerate(rest)}
    at["text"] = text
    if "n_chars" in columns:
        at["n_chars"] = F.length(text).cast("long")
    return df.select(*(at[c].alias(c) for c in columns))


@stage_of
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.toxicity_model(docs, queries.read(spark, sf_dir, "labels"))
    scored = _numbered(toxicity.score(docs, model, keep=docs.columns))
    kept = scored.where(F.col(f"_{len(docs.columns)}") < queries.TOXIC)
    return kept.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


@stage_of
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the least id stays, a null one last; of repeats of that row, one."""
    surplus = stage(ngram_join.surplus_rows(docs, n=5, percent=80), "surplus")
    names = [f"_{i}" for i in range(len(docs.columns))]
    rows = _numbered(docs.select("*", *ngram_join.row_key()))
    doc_id, text_name = (F.col(f"_{len(names) + i}") for i in range(2))
    same = doc_id.eqNullSafe(F.col("doc_id")) & (text_name == F.col("text_name"))
    alone = rows.join(surplus, same, "left_anti").select(*names)
    repeated = rows.join(surplus.where("first"), same, "left_semi").groupBy(doc_id, text_name)
    repeated = repeated.agg(F.first(F.struct(*names)).alias("row")).select("row.*")
    return alone.unionAll(repeated).toDF(*docs.columns)


@stage_of
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]
    cleaned = _numbered(recompression.remove_repeats(docs, size=35, keep=rest))
    n = len(rest)  # text, the rest, n_words, n_removed, kept
    text = F.when(F.col(f"_{n + 2}") > 0, F.col(f"_{n + 3}")).otherwise(F.col("_0"))
    at = cleaned.select(*(F.col(f"_{i + 1}").alias(f"_{i}") for i in range(n)), text.alias("cleaned"))
    return _with_text(at, docs.columns, rest, F.col("cleaned"))


@stage_of
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]
    found = _numbered(pii.find_personal_data(docs, keep=rest))
    return _with_text(found, docs.columns, rest, F.col(f"_{len(found.columns) - 1}"))


@stage_of
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    pieces = packing.pack_documents(docs, tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
