"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaymill.llm.audit import OP13_SQL, op13_filter_audit
from assaymill.llm.imatch import op10_imatch_fingerprints
from assaymill.llm.language import op6_language_id
from assaymill.llm.licences import OP5_SQL, op5_license_scan
from assaymill.llm.merkle import OP11_SQL, op11_merkle_manifest
from assaymill.llm.mixing import OP7_SQL, op7_mix_sources
from assaymill.llm.packing import op8_pack_sequences
from assaymill.llm.quality import op2_quality_rules
from assaymill.llm.secrets import op1_secret_scan
from assaymill.llm.simhash import op3_simhash_near_dedup
from assaymill.llm.sstable import op9_sstable_roundtrip
from assaymill.llm.toxicity import op12_toxicity
from assaymill.llm.urls import OP4_SQL, op4_url_filter

QUERIES = [
    op1_secret_scan,
    op2_quality_rules,
    op3_simhash_near_dedup,
    op4_url_filter,
    op5_license_scan,
    op6_language_id,
    op7_mix_sources,
    op8_pack_sequences,
    op9_sstable_roundtrip,
    op10_imatch_fingerprints,
    op11_merkle_manifest,
    op12_toxicity,
    op13_filter_audit,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": OP4_SQL,
        "op5_license_scan": OP5_SQL,
        "op7_mix_sources": OP7_SQL,
        "op11_merkle_manifest": OP11_SQL,
        "op13_filter_audit": OP13_SQL,
    }
