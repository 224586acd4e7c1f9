"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from ledgerloom.llm import bin_compaction, decontaminate, html_extract, jaccard_join, kd_clusters, phrase_automata, quality_classifier, quality_rules, secret_scan, sentence_pieces, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_quality_classifier": quality_classifier.query,
    "op2_html_extract": html_extract.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_sentence_pieces": sentence_pieces.query,
    "op5_toxicity": toxicity.query,
    "op6_secret_scan": secret_scan.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_warc": warc.query,
    "op9_decontaminate": decontaminate.query,
    "op10_quality_rules": quality_rules.query,
    "op11_phrase_automata": phrase_automata.query,
    "op12_bin_compaction": bin_compaction.query,
    "op13_kd_clusters": kd_clusters.query,
}

ORACLES: dict[str, str] = {"op8_warc": warc.ORACLE, "op10_quality_rules": quality_rules.ORACLE}
