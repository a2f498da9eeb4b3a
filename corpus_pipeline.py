"""Corpus pipeline: five operators in a row, each stage written as Parquet and read by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.

Null texts, repeated rows, rows that share an id or have none, and empty tables go through every stage without an error: a
null or empty text is rejected by ``language`` (no letters), links with nothing in ``near_duplicates``, stays null in
``personal_data``, has no words for ``mix`` to take, and has no tokens in ``tokens``. Further columns, of any name, are
kept as they are by all stages but the last.

Texts are scanned in place: stages find rows again by their file and position (``llm.common.keyed``) and stage
ids and figures only; each stage's own tables are small, and ``run`` deletes what a stage has read once it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, mixing, neardup, pii
from tidemark.llm.common import discard, own_columns, staged
from tidemark.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that a language explains better than noise, by text, declaration and host together."""
    ship(spark)
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by 0.8 or more of their five-word shingles: the smallest id."""
    ship(spark)
    return neardup.deduplicated(docs, width=5, threshold=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data and secrets replaced by its kind; n_chars follows."""
    ship(spark)
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*own_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    ship(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): token ids of every text, with digests of the ids and of the
    text decoded from them."""
    import public_tokenizers

    ship(spark)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN, digests=True).drop("decoded")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("tokens", tokens)]

#: Trained models and sampling are not written in SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
