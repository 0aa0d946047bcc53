"""Queries of the training-data operators and the SQL that some of them are compared with."""

from __future__ import annotations

from memjobs.llm import decontamination, extraction, jaccard, licenses, pii, quality, repair, sentencepiece, substrings, suffixes, toxicity, warc, whitening

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_license_scan": licenses.query,
    "op3_ngram_jaccard": jaccard.query,
    "op4_decontaminate": decontamination.query,
    "op5_warc_archive": warc.query,
    "op6_substring_dedup": substrings.query,
    "op7_html_extraction": extraction.query,
    "op8_pii": pii.query,
    "op9_sentencepiece": sentencepiece.query,
    "op10_toxicity": toxicity.query,
    "op11_whitening": whitening.query,
    "op12_conversation_repair": repair.query,
    "op13_suffix_dedup": suffixes.query,
}
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": jaccard.ORACLE_SQL,
    "op4_decontaminate": decontamination.ORACLE_SQL,
    "op5_warc_archive": warc.ORACLE_SQL,
    "op6_substring_dedup": substrings.ORACLE_SQL,
    "op12_conversation_repair": repair.ORACLE_SQL,
    "op13_suffix_dedup": suffixes.ORACLE_SQL,
}
