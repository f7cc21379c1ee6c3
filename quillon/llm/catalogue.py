"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, exact_dedup, fingerprint, html_text, language_id, license_scan, line_dedup, near_dedup, packing, secrets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
    "op2_document_fingerprints": fingerprint.op2_document_fingerprints,
    "op3_language_id": language_id.op3_language_id,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_packing": packing.op5_packing,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_html_extraction": html_text.op8_html_extraction,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_license_scan": license_scan.op10_license_scan,
    "fingerprint_whole_texts": fingerprint.fingerprint_whole_texts,
}
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": near_dedup.OP1_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "fingerprint_whole_texts": fingerprint.WHOLE_TEXTS_SQL,
}
