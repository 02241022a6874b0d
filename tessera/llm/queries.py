"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from tessera.llm import decontaminate, embed_dedup, html_text, langid, line_dedup, lm_score, near_dup, packing, secrets, token_store

QUERIES = {
    "op1_lattice_score": lm_score.op1_lattice_score,
    "op2_token_orc": token_store.op2_token_orc,
    "op3_tensor_minhash": near_dup.op3_tensor_minhash,
    "op4_bin_completion": packing.op4_bin_completion,
    "op5_deletion_lines": line_dedup.op5_deletion_lines,
    "op6_itq_hamming": embed_dedup.op6_itq_hamming,
    "op7_blob_ledger": secrets.op7_blob_ledger,
    "op8_script_viterbi": langid.op8_script_viterbi,
    "op9_template_leaks": decontaminate.op9_template_leaks,
    "op10_template_text": html_text.op10_template_text,
}

SQL: dict[str, str] = {
    "op3_tensor_minhash": near_dup.SQL,
    "op5_deletion_lines": line_dedup.SQL,
    "op6_itq_hamming": embed_dedup.SQL,
    "op7_blob_ledger": secrets.SQL,
    "op9_template_leaks": decontaminate.SQL,
}
