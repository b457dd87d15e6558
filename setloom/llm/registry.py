"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import corpus_pipeline

from . import embedding_dedup, html_text, language_id, line_dedup, lz_fingerprint, mixing, packing, pii, simhash, token_counts
from .common import read

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op2_embedding_multi_index": lambda spark, sf_dir: embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings")),
    "op1_lz_fingerprint": lambda spark, sf_dir: lz_fingerprint.lz_fingerprints(read(spark, sf_dir, "documents")),
    "op3_language_kernels": lambda spark, sf_dir: language_id.identify(read(spark, sf_dir, "documents")),
    "op4_html_main_text": lambda spark, sf_dir: html_text.extract(read(spark, sf_dir, "pages")),
    "op5_mix_sources": lambda spark, sf_dir: mixing.mix(read(spark, sf_dir, "documents")),
    "op6_simhash_covering": lambda spark, sf_dir: simhash.near_duplicates(read(spark, sf_dir, "documents")),
    "op7_fuzzy_lines": lambda spark, sf_dir: line_dedup.repeated_lines(read(spark, sf_dir, "documents")),
    "op8_pack_sequences": lambda spark, sf_dir: packing.pack(read(spark, sf_dir, "documents")),
    "op9_pii_weak_supervision": lambda spark, sf_dir: pii.personal_data(read(spark, sf_dir, "documents")),
    "op10_token_counts": lambda spark, sf_dir: token_counts.token_counts(read(spark, sf_dir, "documents")),
}

ORACLES = {"op5_mix_sources": mixing.ORACLE}
