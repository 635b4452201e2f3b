"""The subpackage's entries for ``__spark_entry__``: one query per operator, SQL where it exists."""

from __future__ import annotations

from docloom.llm import decontaminate, golden, jaccard, lines, mixing, negatives, quality, sketches, substrings, tokens, toxicity, urls, warc


def queries() -> dict:
    return {
        "op1_tokens": tokens.op1_tokens,
        "op2_jaccard": jaccard.op2_jaccard,
        "op3_urls": urls.op3_urls,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_quality": quality.op5_quality,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_lines": lines.op7_lines,
        "op8_suffix_dedup": substrings.op8_suffix_dedup,
        "op9_mixing": mixing.op9_mixing,
        "op10_warc": warc.op10_warc,
        "op11_golden": golden.op11_golden,
        "op12_minhash": sketches.op12_minhash,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard": jaccard.ORACLE_SQL,
        "op4_decontaminate": decontaminate.ORACLE_SQL,
        "op5_quality": quality.ORACLE_SQL,
        "op7_lines": lines.ORACLE_SQL,
        "op9_mixing": mixing.ORACLE_SQL,
        "op11_golden": golden.ORACLE_SQL,
        "op12_minhash": sketches.ORACLE_SQL,
        "op13_hard_negatives": negatives.ORACLE_SQL,
    }
