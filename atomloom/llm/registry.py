"""Queries of this subpackage and their SQL twins, by query name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, near_dup, source_mix, suffix_dedup, tiff, token_count, token_file, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_near_duplicates": near_dup.op2_near_duplicates,
    "op3_warc_members": warc.op3_warc_members,
    "op4_language_id": language_id.op4_language_id,
    "op5_token_count": token_count.op5_token_count,
    "op6_source_mix": source_mix.op6_source_mix,
    "op7_benchmark_leaks": decontaminate.op7_benchmark_leaks,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_token_file": token_file.op9_token_file,
    "op10_tiff_pages": tiff.op10_tiff_pages,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op6_source_mix": source_mix.OP6_SQL,
    "op7_benchmark_leaks": decontaminate.OP7_SQL,
    "op8_suffix_dedup": suffix_dedup.OP8_SQL,
}
