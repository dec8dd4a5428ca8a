"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, brown, flac, infill, language, mixing, packing, repair, secret_scan, simhash, topk, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.query,
        "op2_bpe": bpe.query,
        "op3_flac": flac.query,
        "op4_secrets": secret_scan.query,
        "op5_language": language.query,
        "op6_simhash": simhash.query,
        "op7_toxicity": toxicity.query,
        "op8_mixing": mixing.query,
        "op9_brown": brown.query,
        "op10_topk": topk.query,
        "op11_repair": repair.query,
        "op12_infill": infill.query,
        "op13_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE, "op10_topk": topk.ORACLE, "op12_infill": infill.ORACLE}
