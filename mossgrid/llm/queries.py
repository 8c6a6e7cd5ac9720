"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import attention_lm, bpe_trie, decontaminate, licenses, line_templates, ngram_join, packing, quality, suffix_dedup, token_planes, toxicity, turn_repair, turn_trie

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_token_planes": token_planes.query,
    "op3_line_templates": line_templates.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_quality_cascade": quality.query,
    "op6_attention_lm": attention_lm.query,
    "op7_packing": packing.query,
    "op8_toxicity": toxicity.query,
    "op10_ngram_join": ngram_join.query,
    "op9_license_digests": licenses.query,
    "op11_turn_repair": turn_repair.query,
    "op12_turn_trie": turn_trie.query,
    "op13_bpe_trie": bpe_trie.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op3_line_templates": line_templates.SQL,
    "op5_quality_cascade": quality.SQL,
    "op9_license_digests": licenses.SQL,
    "op11_turn_repair": turn_repair.SQL,
    "op12_turn_trie": turn_trie.SQL,
}
