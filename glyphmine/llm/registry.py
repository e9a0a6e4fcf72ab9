"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import capture_index, decontaminate, exact_dedup, html_extract, langid, lm_scoring, ngram_join, packing, sharding, sstable


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
        "op3_lm_scoring": lm_scoring.op3_lm_scoring,
        "op4_html_extraction": html_extract.op4_html_extraction,
        "op5_sorted_string_tables": sstable.op5_sorted_string_tables,
        "op6_capture_index": capture_index.op6_capture_index,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_language_id": langid.op8_language_id,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_sharding": sharding.op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": ngram_join.ORACLE_SQL,
        "op6_capture_index": capture_index.ORACLE_SQL,
        "op7_exact_dedup": exact_dedup.ORACLE_SQL,
        "op9_decontamination": decontaminate.ORACLE_SQL,
    }
