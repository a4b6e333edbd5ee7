"""The queries of the operators here, and their SQL where SQL can express them."""

from __future__ import annotations

from corpusloom.llm import exact_dedup, fingerprints, infill, jaccard_join, language_crf, line_dedup, mixing, packing, prefix_trie, sharding, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_sharding": sharding.op3_sharding,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_language_id": language_crf.op6_language_id,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_packing": packing.op9_packing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_substring_dedup": substring_dedup.op12_substring_dedup,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op4_url_filter": url_filter.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_fill_in_middle": infill.SQL,
}
