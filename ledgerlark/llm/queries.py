"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, decontaminate, langid, licenses, lines, sharding, simhash, suffixes, topk, warc


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": lambda s, d: warc.query(table(s, d, "pages")),
        "op2_simhash": lambda s, d: simhash.query(table(s, d, "documents")),
        "op3_suffix_dedup": lambda s, d: suffixes.query(table(s, d, "documents")),
        "op4_license_scan": lambda s, d: licenses.query(table(s, d, "documents")),
        "op5_decontaminate": lambda s, d: decontaminate.query(table(s, d, "documents"), table(s, d, "benchmark")),
        "op6_language_id": lambda s, d: langid.query(table(s, d, "documents")),
        "op7_line_dedup": lambda s, d: lines.query(table(s, d, "documents")),
        "op8_bpe": lambda s, d: bpe.query(table(s, d, "documents"), vocabulary()),
        "op9_topk": lambda s, d: topk.query(table(s, d, "embeddings")),
        "op10_sharding": lambda s, d: sharding.extendible_shards(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licenses.oracle(), "op7_line_dedup": lines.ORACLE, "op9_topk": topk.ORACLE, "op10_sharding": sharding.oracle()}
