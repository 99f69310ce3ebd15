"""The queries of this subpackage and the SQL that states the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, flac, hard_negatives, html_extract, jaccard_join, language_id, licenses, line_dedup, order_minhash, packing, sharding, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_flac": flac.op2_flac,
        "op3_ngram_jaccard": jaccard_join.op3_ngram_jaccard,
        "op4_byte_bpe": byte_bpe.op4_byte_bpe,
        "op5_language_id": language_id.op5_language_id,
        "op6_html_extraction": html_extract.op6_html_extraction,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_order_minhash": order_minhash.op8_order_minhash,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_sharding": sharding.op10_sharding,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_url_filter": url_filter.op12_url_filter,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
        "language_id_pages": language_id.language_id_pages,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_license_scan": licenses.oracle(), "op12_url_filter": url_filter.oracle(), "op13_hard_negatives": hard_negatives.oracle()}
