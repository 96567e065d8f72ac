"""Names, queries and SQL of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coexnet.llm import collocations, decontaminate, fill_middle, html_text, jaccard, license_scan, line_dedup, lm_score, mix, quality, topk, warc, wordpiece


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_mix": mix.op2_mix,
        "op3_topk": topk.op3_topk,
        "op4_lm_score": lm_score.op4_lm_score,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_licenses": license_scan.op6_licenses,
        "op7_quality": quality.op7_quality,
        "op8_token_counts": wordpiece.op8_token_counts,
        "op9_html": html_text.op9_html,
        "op10_jaccard": jaccard.op10_jaccard,
        "op11_collocations": collocations.op11_collocations,
        "op12_line_dedup": line_dedup.op12_line_dedup,
        "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {**warc.SQL, **mix.SQL, **topk.SQL, **jaccard.SQL, **collocations.SQL, **line_dedup.SQL, **fill_middle.SQL}
