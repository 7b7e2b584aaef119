"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import align, conversations, decontaminate, fingerprint, fixity, jaccard, language, linededup, mixing, repeats, tokencount, tokenids, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_decontamination(spark, folder):
    return decontaminate.digests(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op2_language(spark, folder):
    return language.held_out_predictions(read(spark, folder, "documents"))


@query
def op3_jaccard(spark, folder):
    return jaccard.components_of(read(spark, folder, "documents"))


@query
def op4_fixity(spark, folder):
    """The replica is the table with every page of a residue changed, and every one of another gone."""
    residue = F.pmod("page_id", F.lit(50))
    return fixity.page_audit(read(spark, folder, "pages"), changed=residue == 7, lost=residue == 31)


@query
def op5_token_counts(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return tokencount.counted(docs, vocabulary("word_bpe_49k.json")).drop("text")


@query
def op6_mixing(spark, folder):
    return mixing.mixed_sizes(read(spark, folder, "documents"))


@query
def op7_toxicity(spark, folder):
    return toxicity.held_out_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op8_repeats(spark, folder):
    return repeats.digests(read(spark, folder, "documents"))


@query
def op9_fingerprints(spark, folder):
    return fingerprint.edited_fingerprints(read(spark, folder, "documents"))


@query
def op10_token_files(spark, folder):
    return tokenids.token_digests(read(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op11_alignment(spark, folder):
    return align.alignment_digests(read(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op12_conversation_repair(spark, folder):
    return conversations.repair_digests(read(spark, folder, "conversations"))


@query
def op13_line_dedup(spark, folder):
    return linededup.line_digests(read(spark, folder, "documents"))
