"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from undertone.llm import bpe, decontamination, fingerprints, interaction, language, merkle, pitman_yor, quality, repeats, secrets, simhash, tokens, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_repeats": repeats.op3_repeats,
    "op4_language": language.op4_language,
    "op5_bpe": bpe.op5_bpe,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_secrets": secrets.op7_secrets,
    "op8_simhash": simhash.op8_simhash,
    "op9_language_model": pitman_yor.op9_language_model,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_merkle": merkle.op11_merkle,
    "op12_interaction": interaction.op12_interaction,
    "op13_fingerprints": fingerprints.op13_fingerprints,
}

SQL = {
    "op1_quality": quality.SQL,
    "op6_decontamination": decontamination.SQL,
    "op11_merkle": merkle.SQL,
    "op12_interaction": interaction.SQL,
}
