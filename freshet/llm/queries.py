"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from freshet.llm import align, bpe, jaccard, language, lines, merkle, mixing, negatives, pii, ppm, shards, toxicity, urls

QUERIES = {f.__name__: f for f in (
    ppm.op1_ppm, language.op2_language, lines.op3_quality_rules, merkle.op4_fingerprints, mixing.op5_mixing, jaccard.op6_jaccard_join,
    pii.op7_pii, bpe.op8_bpe, toxicity.op9_toxicity, urls.op10_url_filters, align.op11_alignment, shards.op12_sharding,
    negatives.op13_hard_negatives)}
SQL = {"op3_quality_rules": lines.SQL, "op4_fingerprints": merkle.SQL, "op5_mixing": mixing.SQL, "op10_url_filters": urls.SQL,
       "op13_hard_negatives": negatives.SQL}
