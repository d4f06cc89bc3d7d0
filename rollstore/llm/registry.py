"""The thin queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bytebpe, exact_dedup, license_scan, mixing, near_dedup, quality, substring_dedup, suffix_dedup, token_counts


_QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_license_scan": license_scan.query,
    "op3_ann": ann.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_quality": quality.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_bpe": bytebpe.query,
    "op8_token_counts": token_counts.query,
    "op9_mixing": mixing.query,
    "op10_suffix_dedup": suffix_dedup.query,
}

_SQL = {
    "op1_near_dedup": near_dedup.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op10_suffix_dedup": suffix_dedup.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op9_mixing": mixing.SQL,
}


def queries() -> dict:
    import corpus_pipeline

    return _QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
