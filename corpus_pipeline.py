"""The corpus pipeline: language ID, near-dedup, decontamination, secret redaction, tokenising.

``STAGES`` lists ``(name, function)``.  Each function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame; ``run`` writes each result as Parquet in the shared folder and reads
it again as the documents of the next stage, so that a stage that loses executors starts
from the table before it.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import byte_bpe, decontaminate, language_id, secret_scan, simhash_dedup
from dossier.llm.common import cut, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which no language is found, or with less than ``LEAST_KNOWN`` of their letters in words that fit one.

    So null texts and those without a letter go.  Where no document has a language to learn
    from, all texts with a letter stay; repeated rows stay, no rows give no rows.
    """
    return language_id.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id.

    Rows with a null id stay, of rows that repeat the smallest id all; empty texts are alike;
    no rows give no rows.
    """
    return simhash_dedup.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and wordless texts and rows with a null id stay, no rows give no rows."""
    return decontaminate.drop_leaky(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated ones too; secrets in their texts are replaced by a mark, and n_chars follows (null for a null text)."""
    cleaned = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with counts and hashes of the ids and of what they decode to; a null text counts as empty."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # Workers are shared with the other stages, so the tables kept are smaller here.
    return byte_bpe.tokenize(docs, path, public_tokenizers.PATTERN, keep_ids=True, max_words=130_000, max_states=100_000)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("byte_bpe", tokenize),
]

#: The stages fit a mixture, link fingerprints and run a transducer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
