"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, language, licences, lines, merkle, personal, quality, resampling, sentencepiece_codec, sharding, simhash, token_counts, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_language": language.op2_language,
    "op3_simhash": simhash.op3_simhash,
    "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
    "op5_personal_data": personal.op5_personal_data,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_licences": licences.op7_licences,
    "op8_quality": quality.op8_quality,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_merkle": merkle.op11_merkle,
    "op12_sharding": sharding.op12_sharding,
    "op13_resampling": resampling.op13_resampling,
}

ORACLES = {"op1_decontamination": decontaminate.ORACLE, "op6_line_dedup": lines.ORACLE, "op7_licences": licences.oracle(), "op8_quality": quality.ORACLE, "op11_merkle": merkle.oracle(), "op12_sharding": sharding.ORACLE, "op13_resampling": resampling.ORACLE}
