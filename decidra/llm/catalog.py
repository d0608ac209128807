"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from . import decontaminate, htmltext, interaction, lines, lm, neardup, packing, rules, secrets, shards, tokencount, toxicity, trie

QUERIES = {
    "op1_consensus_host_paths": htmltext.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_secret_ownership": secrets.op3,
    "op4_deleted_interpolation": lm.op4,
    "op5_suffix_array_decontamination": decontaminate.op5,
    "op6_rule_ledger": rules.op6,
    "op7_winnowed_lines": lines.op7,
    "op8_hash_tree_shards": shards.op8,
    "op9_fast_similarity_sketches": neardup.op9,
    "op10_nnpu_toxicity": toxicity.op10,
    "op11_filter_audit": interaction.op11,
    "op12_prefix_trie": trie.op12,
    "op13_whole_token_shortcut": tokencount.op13,
}
SQL = {"op5_suffix_array_decontamination": decontaminate.SQL, "op3_secret_ownership": secrets.SQL, "op6_rule_ledger": rules.SQL, "op11_filter_audit": interaction.SQL, "op12_prefix_trie": trie.SQL}
