"""Registered queries of the corpus operators and their DuckDB twins.

Operators 5, 7, 8 and 9 have no twin: SQL expresses neither the fitted models, nor
alignment, nor the parse of a page. Tests hold them against brute force, the source
documents and held-out labels.
"""

from __future__ import annotations

from tidemetric.llm import conv_trie, decontaminate, hard_negatives, html_extract, langid, line_dedup, mixing, ngram_join, quality_crf, suffix_dedup, topk, url_filter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_exact_top_k": topk.op2_exact_top_k,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality_classifier": quality_crf.op5_quality_classifier,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_language_id": langid.op9_language_id,
    "op10_url_filters": url_filter.op10_url_filters,
    "op11_prefix_trie": conv_trie.op11_prefix_trie,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}

ORACLE_SQL = {
    "op1_warc": warc.SQL,
    "op2_exact_top_k": topk.SQL,
    "op3_ngram_join": ngram_join.SQL,
    "op4_mixing": mixing.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op10_url_filters": url_filter.SQL,
    "op11_prefix_trie": conv_trie.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_suffix_dedup": suffix_dedup.SQL,
}
