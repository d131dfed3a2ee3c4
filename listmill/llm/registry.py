"""Queries of the ten operators and of the pipeline, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from listmill.llm import (
    decontaminate, fixity, lines, manifest, mixing, neardup, pii, quality, quotes, secrets, sharding, tokens,
    whitening)

QUERIES = {
    "op1_merkle_fixity": fixity.query,
    "op2_hypergeometric_shards": sharding.query,
    "op3_bootstrapped_pii": pii.query,
    "op4_minhash_components": neardup.query,
    "op5_line_dedup": lines.query,
    "op6_line_first_cleaning": quality.query,
    "op7_spaced_seeds": decontaminate.query,
    "op8_quotation_links": quotes.query,
    "op9_whole_token_counts": tokens.query,
    "op10_fair_queueing": mixing.query,
    "op11_randomness_battery": secrets.query,
    "op12_merkle_manifest": manifest.query,
    "op13_jacobi_davidson_whitening": whitening.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op8_quotation_links": quotes.SQL,
    "op1_merkle_fixity": fixity.SQL,
    "op4_minhash_components": neardup.SQL,
    "op5_line_dedup": lines.SQL,
    "op6_line_first_cleaning": quality.SQL,
    "op7_spaced_seeds": decontaminate.SQL,
}
