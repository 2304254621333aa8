"""What __spark_entry__ registers of this subpackage."""

from __future__ import annotations

from . import decontaminate, jaccard, licenses, lines, mixing, quality, sql, substring, tokens, toxicity


def queries() -> dict:
    return {f.__name__: f for f in (substring.op1_substring_dedup, mixing.op3_context_mixing, decontaminate.op2_decontamination, licenses.op8_license_scan, jaccard.op5_ngram_jaccard, quality.op4_quality_rules, lines.op9_line_dedup, tokens.op6_bpe_codec, tokens.op7_token_counts, toxicity.op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
