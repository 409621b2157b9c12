"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import decontaminate, fingerprint, html, jaccard, passages, pii, quality, sentencepiece, substrings, warc


def queries() -> dict:
    return {
        "op1_fingerprint": fingerprint.op1_fingerprint,
        "op2_sentencepiece": sentencepiece.op2_sentencepiece,
        "op3_pii": pii.op3_pii,
        "op4_suffix_array": substrings.op4_suffix_array,
        "op5_quality": quality.op5_quality,
        "op6_passages": passages.op6_passages,
        "op7_html": html.op7_html,
        "op8_warc": warc.op8_warc,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_decontaminate": decontaminate.ORACLE,
        "op10_ngram_jaccard": jaccard.ORACLE,
    }
