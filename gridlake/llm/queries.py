"""The numbered operators as queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    bpe,
    licenses,
    ngram_join,
    packing,
    pii,
    pivots,
    recompression,
    secrets,
    toxicity,
    vafile,
    whitening,
    winnowing,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    coded = bpe.encode_documents(
        read(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    )
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"), n=5, percent=80)


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = recompression.remove_repeats(read(spark, sf_dir, "documents"), size=35, keep=("doc_id",))
    return cleaned.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    pieces = packing.pack_documents(read(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = winnowing.compare_edited(read(spark, sf_dir, "documents"))
    return compared.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        winnowing.positions(F.col("kept")).alias("positions"),
    )


@query
def op1_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner is a source, a repository one language of a source."""
    found = secrets.find_secrets(
        read(spark, sf_dir, "documents"), repository=F.concat_ws("/", "source", "lang"), owner=F.col("source")
    )
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
        "n_live",
        "n_copied",
    )


@query
def op4_anchored_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


@query
def op8_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(read(spark, sf_dir, "embeddings"), least=0.95)


TOXIC = 0.7


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from the rows that are not held out."""
    return toxicity.fit(docs, labels.where(~toxicity.held_out()))


@query
def op6_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity_model(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a file in the directory of its language below its source; a text with a statement in every
    twenty words licenses its directory."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan_licenses(read(spark, sf_dir, "documents"), path, share=0.05)


@query
def op11_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it does not fit a long; ``deviation_exact`` always holds it."""
    white = whitening.whiten(read(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000)
    return white.select(
        "vec_id",
        "component",
        "n",
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
        F.col("deviation").alias("deviation_exact"),
    )


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = read(spark, sf_dir, "documents")
    return alignment.align_tokenizers(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))


@query
def op13_vector_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)
