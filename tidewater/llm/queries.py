"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.decontamination import op10_decontamination
from tidewater.llm.html_text import op1_html_extraction
from tidewater.llm.language import op3_language_id
from tidewater.llm.packing import op8_best_fit_packing
from tidewater.llm.quality import op2_quality_rules
from tidewater.llm.secrets import op6_secret_scans
from tidewater.llm.simhash import op4_simhash_near_dedup
from tidewater.llm.substring_dedup import op5_suffix_array_dedup
from tidewater.llm.token_files import op7_token_files
from tidewater.llm.toxicity import op9_toxicity

QUERIES = [
    op1_html_extraction, op2_quality_rules, op3_language_id, op4_simhash_near_dedup, op5_suffix_array_dedup,
    op6_secret_scans, op7_token_files, op8_best_fit_packing, op9_toxicity, op10_decontamination,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """No contract here is plain SQL: hashes, tokenizers and learnt models are tested against brute force instead."""
    return {}
