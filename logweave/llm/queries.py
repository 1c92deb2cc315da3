"""Registered queries of the package and their DuckDB SQL.

Each query applies its operator with production parameters to the whole table
and returns the contract's columns. Without SQL (tested by brute force in
tests/llm): op2, op4, op5, op9 to op13 and the pipeline.
"""

from __future__ import annotations

from logweave.llm import (line_dedup, minhash, mixing, piece_codec, quality, secret_scan, sharding, span_dedup,
                          suffix_dedup, token_align, toxicity, vector_dedup, whitening)
from logweave.sources.tables import read_table


def _over(table: str, query):
    return lambda spark, sf_dir: query(read_table(spark, sf_dir, table))


QUERIES = {
    "op1_sharding": _over("documents", sharding.q_sharding),
    "op2_suffixes": _over("documents", suffix_dedup.q_suffixes),
    "op3_span_dedup": _over("documents", span_dedup.q_span_dedup),
    "op4_pieces": _over("documents", piece_codec.q_pieces),
    "op5_minhash": _over("documents", minhash.q_minhash),
    "op6_line_dedup": _over("documents", line_dedup.q_line_dedup),
    "op7_quality_rules": _over("documents", quality.q_quality),
    "op8_mixing": _over("documents", mixing.q_mixing),
    "op9_vectors": _over("embeddings", vector_dedup.q_vectors),
    "op10_secrets": _over("documents", secret_scan.q_secrets),
    "op11_alignment": _over("documents", token_align.q_alignment),
    "op12_whitening": _over("embeddings", whitening.q_whitening),
    "op13_toxicity": lambda spark, sf_dir: toxicity.q_toxicity(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")),
}

ORACLE = {
    "op1_sharding": sharding.oracle(),
    "op3_span_dedup": span_dedup.oracle(),
    "op6_line_dedup": line_dedup.oracle(),
    "op7_quality_rules": quality.oracle(),
    "op8_mixing": mixing.oracle(),
}
