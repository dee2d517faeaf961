"""The queries of this package, and SQL for those that SQL can express."""

from roadloom.llm import attention_lm, heap_search, line_variants, metric_tree, pii_boosting, piece_bpe, pivot_simhash, ppm_language, prefix_groups, sentence_spans, suffix_decontamination, toxicity_pu, variant_automata

QUERIES = {
    "op1_toxicity_pu": toxicity_pu.op1_toxicity_pu,
    "op2_suffix_decontamination": suffix_decontamination.op2_suffix_decontamination,
    "op3_sentence_spans": sentence_spans.op3_sentence_spans,
    "op4_piece_bpe": piece_bpe.op4_piece_bpe,
    "op5_prefix_groups": prefix_groups.op5_prefix_groups,
    "op6_line_variants": line_variants.op6_line_variants,
    "op7_ppm_language": ppm_language.op7_ppm_language,
    "op8_attention_lm": attention_lm.op8_attention_lm,
    "op9_metric_tree": metric_tree.op9_metric_tree,
    "op10_pii_boosting": pii_boosting.op10_pii_boosting,
    "op11_variant_automata": variant_automata.op11_variant_automata,
    "op12_heap_search": heap_search.op12_heap_search,
    "op13_pivot_simhash": pivot_simhash.op13_pivot_simhash,
}

ORACLE_SQL: dict[str, str] = {"op6_line_variants": line_variants.SQL, "op9_metric_tree": metric_tree.SQL, "op12_heap_search": heap_search.SQL}
