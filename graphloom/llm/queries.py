"""The registered queries of this package and their SQL."""

from __future__ import annotations

from graphloom.llm import bpe, curriculum, embedding_dedup, hard_negatives, imatch, language, line_dedup, packing, periodic, quality, simhash, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_quality": quality.op2_quality,
    "op3_packing": packing.op3_packing,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_imatch": imatch.op5_imatch,
    "op6_bpe": bpe.op6_bpe,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_language": language.op9_language,
    "op10_warc": warc.op10_warc,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_curriculum": curriculum.op12_curriculum,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op4_embedding_dedup": embedding_dedup.ORACLE,
    "op5_imatch": imatch.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_warc": warc.ORACLE,
    "op12_curriculum": curriculum.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
