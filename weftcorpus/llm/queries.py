"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from weftcorpus.llm import additive_ann, bpe, chat, html_extract, jaccard, lloyd, lsm_dedup, mixing, norm_codes, oracles, packing, quality, substrings, toxicity

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_quality_classifier": quality.op2,
    "op3_html_extraction": html_extract.op3,
    "op4_chat_format": chat.op4,
    "op5_nearest_neighbours": additive_ann.op5,
    "op6_bpe_encoding": bpe.op6,
    "op7_suffix_dedup": substrings.op7,
    "op8_toxicity": toxicity.op8,
    "op9_jaccard_join": jaccard.op9,
    "op10_exact_dedup": lsm_dedup.op10,
    "op11_norm_codes": norm_codes.op11,
    "op12_lloyd_clusters": lloyd.op12,
    "op13_sequence_packing": packing.op13,
    "mix_targets": mixing.mix_targets,
}
ORACLES = {
    "mix_targets": oracles.MIX_TARGETS,
    "op5_nearest_neighbours": oracles.NEIGHBOURS,
    "op7_suffix_dedup": oracles.REPEATS,
    "op9_jaccard_join": oracles.NEAR_GROUPS,
    "op10_exact_dedup": lsm_dedup.ORACLE,
    "op11_norm_codes": norm_codes.oracle(),
    "op12_lloyd_clusters": lloyd.oracle(),
}
