"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from starmill.llm import chat, classifier, collocations, licences, line_dedup, minhash, mixing, neighbours, packing, quality_rules, repair, substrings, token_files

QUERIES = {
    "op1_ngram_ratio": quality_rules.op1_ngram_ratio,
    "op2_suffix_groups": substrings.op2_suffix_groups,
    "op3_grammar_round_trip": chat.op3_grammar_round_trip,
    "op4_dart_minhash": minhash.op4_dart_minhash,
    "op5_patience_lines": line_dedup.op5_patience_lines,
    "op6_sainte_lague": mixing.op6_sainte_lague,
    "op7_conflict_best_fit": packing.op7_conflict_best_fit,
    "op8_quadratic_discriminant": classifier.op8_quadratic_discriminant,
    "op9_nn_descent": neighbours.op9_nn_descent,
    "op10_licence_paragraphs": licences.op10_licence_paragraphs,
    "op11_quotient_collocations": collocations.op11_quotient_collocations,
    "op12_arrow_sequences": token_files.op12_arrow_sequences,
    "op13_run_length_repair": repair.op13_run_length_repair,
}

ORACLES = {"op3_grammar_round_trip": chat.SQL, "op6_sainte_lague": mixing.SQL, "op11_quotient_collocations": collocations.SQL, "op13_run_length_repair": repair.SQL}
