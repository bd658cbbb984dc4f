"""A corpus pipeline: quality rules, near-duplicates, benchmark leaks, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of ``documents``: the first three drop rows, the fourth replaces secrets in texts by placeholders.
The last adds the ids of the texts.

In every stage: null texts count as empty (the quality rules reject them), rows with null doc_ids are
kept where the other columns pass, very long texts are judged whole, of ties and repeated texts the
smallest doc_id stays, an empty table gives an empty one, and other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stemma.llm import decontaminate, minhash_dedup, quality_rules, secret_scan, sentencepiece_codec
from stemma.llm.common import read, stored
from stemma.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no quality rule rejects. Repeated rows are judged each for itself."""
    return quality_rules.filter_quality(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id; repeated rows of that doc_id all stay, as do rows without words."""
    return minhash_dedup.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no benchmark item contaminates; those with a null doc_id stay."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with placeholders for the secrets in their texts and n_chars to match; null texts stay null."""
    return secret_scan.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the ids of their texts; a null text has none."""
    return sentencepiece_codec.encode_pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", keep_quality),
    ("minhash_dedup", keep_one_of_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]
#: SQL can't express the secret scan's tests and the encoding; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; what goes between stages is stored."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
