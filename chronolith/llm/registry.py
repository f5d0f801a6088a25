"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op11_token_alignment
from .bpe import op12_bpe_round_trip
from .codes import codes_sql, op13_vector_codes
from .counts import op4_token_counts
from .html_cut import op6_html_extraction
from .mixing import mixing_sql, op8_source_mixing
from .packing import op1_packing
from .pii import op9_pii
from .quality import op3_quality_rules
from .simhash import op5_simhash_dedup
from .suffix_dedup import op7_suffix_dedup
from .token_files import op10_token_files
from .topk import TOPK_SQL, op2_topk_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_topk_search": op2_topk_search,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_pii": op9_pii,
    "op10_token_files": op10_token_files,
    "op11_token_alignment": op11_token_alignment,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {"op2_topk_search": TOPK_SQL, "op8_source_mixing": mixing_sql(), "op13_vector_codes": codes_sql()}
