"""A training-data pipeline over `documents`: every stage is written as Parquet and read as the next one's input.

All but the last stage return the columns of `documents`; the last one the digests of the token
files it wrote. A document taken twice by the mix is two rows with one id from then on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ridespark.llm import decontaminate, jaccard, language, mixing, tokenids
from ridespark.llm.queries import read, vocabulary
from ridespark.llm.tables import written
from ridespark.session import drop_table, noted_tables


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Intermediate tables of the last stage that was called.
_left: list[str] = []


def stage(fn: Stage) -> Stage:
    """A stage is given its predecessor's rows as written, so it first deletes the tables that led to them.
    Tables that the given rows are still read from stay.
    """

    @wraps(fn)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _left else []
        for path in _left:
            if not any(path.rsplit("/", 1)[1] in f for f in files):
                drop_table(spark, path)
        _left.clear()
        with noted_tables() as made:
            out = fn(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return call


@stage
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those unlike every language."""
    return language.keep_identified(docs)


@stage
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of every group of near copies."""
    return jaccard.keep_one(docs)


@stage
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until the sources' words meet their targets."""
    return mixing.mixed_documents(docs)


@stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and returns doc_id, start, n_tokens, ids_crc32 as read from them."""
    return tokenids.token_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", identified),
    ("near_duplicates", distinct),
    ("decontamination", clean),
    ("mixing", mixed),
    ("token_files", token_files),
]

#: Learned prototypes and a tokenizer's ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
