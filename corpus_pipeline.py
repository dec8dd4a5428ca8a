"""A corpus pipeline: toxicity, near-dedup, secrets, mixing, tokens.

Each stage takes all documents that the one before kept and returns documents; the last returns
tokens. STAGES may be run one by one, each result written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, jaccard, mixing, secret_scan, simhash, toxicity
from docloom.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go; the lexicon is fitted on labels of these documents."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: they share four fifths of their shingles of five words.

    Fingerprints linked by pivot tables are verified first; an exact join of the sets finds the near copies that fingerprints don't.
    """
    return simhash.keep_one(docs, jaccard.groups)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific secrets are replaced in the texts; every document stays."""
    return secret_scan.redact_live(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until the sources meet their targets."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one per document and copy."""
    return bpe.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("secrets", redact_secrets), ("mixing", mix_sources), ("bpe", tokens)]

#: Fingerprints, learned weights and merges can't be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
