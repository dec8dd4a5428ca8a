"""The flagship: contacts and cards in documents, merged and redacted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.operators import detect
from docloom.sources.tables import load, spread

CONTACTS = ("email_address", "phone_number", "card_number")


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents"))
    return detect.redacted(docs, CONTACTS)
