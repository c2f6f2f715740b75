"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bloom_exact, contamination, lang_bloom, mixing, quality_trees, run_index, schema_rewrite, simhash, sp_bpe, token_store, trie_counts, variants, warc_members


def queries():
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_sentencepiece": sp_bpe.op2_sentencepiece,
        "op3_quality": quality_trees.op3_quality,
        "op4_token_ids": token_store.op4_token_ids,
        "op5_langid": lang_bloom.op5_langid,
        "op6_warc": warc_members.op6_warc,
        "op7_mixing": mixing.op7_mixing,
        "op8_token_counts": trie_counts.op8_token_counts,
        "op9_suffix_dedup": run_index.op9_suffix_dedup,
        "op10_exact_dedup": bloom_exact.op10_exact_dedup,
        "op11_decontamination": contamination.op11_decontamination,
        "op12_spelling": variants.op12_spelling,
        "op13_schema_rewrite": schema_rewrite.op13_schema_rewrite,
    }


def oracle_sql():
    return {"op6_warc": warc_members.OP6_SQL, "op10_exact_dedup": bloom_exact.OP10_SQL, "op11_decontamination": contamination.OP11_SQL, "op12_spelling": variants.OP12_SQL}
