"""From raw documents to token ids: quality rules, line dedup, near dedup, mixing, encoding.

Every stage works on all that the one before kept and takes and returns the columns
of documents, whatever others they have, but the last, which returns the ids. An empty table stays empty in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelframe.llm import bpe, cascade, linededup, mixing, similar
from panelframe.llm.shared import saved, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a rule of the cascade rejects; null and empty texts have no words and go. Repeated rows share a verdict."""
    return cascade.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines of any length that an earlier line repeats within one word; n_chars, where there is one, follows the text.

    Earlier is by (doc_id, text of a repeated id, line). Documents without an id lose nothing; null texts stay.
    """
    left = linededup.dedup_lines(docs)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group that five-word shingles at a similarity of 0.8 or more link.

    Rows without an id stay, rows of one id are one document; null and wordless texts are alike.
    """
    return similar.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, rows equal in all columns as one item; a null source is a source, null texts have size 0."""
    return mixing.mix(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row, and the digests of ids and decoded bytes; null and empty texts have no ids."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, stable=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_sha256("ids").alias("ids_sha256"),
        F.sha2(bpe.decode(spark, "ids", vocabulary), 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_round_trip", bpe_round_trip),
]

#: Fingerprints, rounding and merges are beyond SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, len(STAGES))


def _after(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The rows of the first k stages, saved; the rows of the stage before, and what a stage saved on its way, go then."""
    if not k:
        return spark.read.parquet(f"{sf_dir}/documents.parquet")
    name, stage = STAGES[k - 1]
    with scratch(spark):
        return saved(stage(spark, _after(spark, sf_dir, k - 1), sf_dir), f"pipeline-{name}", keep=True)
