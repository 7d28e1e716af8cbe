"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from gridloom.llm import decontamination, embedding_dedup, licenses, mixing, ngram_join, packing, pii, prefix_trie, quality, suffix_dedup, token_alignment, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_licenses": licenses.op3_licenses,
        "op4_packing": packing.op4_packing,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_quality": quality.op6_quality,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_pii": pii.op8_pii,
        "op9_mixing": mixing.op9_mixing,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_decontamination": decontamination.op13_decontamination,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    found = {"op1_ngram_join": ngram_join.ORACLE, "op9_mixing": mixing.ORACLE, "op10_embedding_dedup": embedding_dedup.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op13_decontamination": decontamination.ORACLE}
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
