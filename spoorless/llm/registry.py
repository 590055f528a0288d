"""Queries and oracles of the corpus operators."""

from __future__ import annotations

import corpus_pipeline

from . import alignment, caps, language, licences, lines, mixing, ngram_join, packing, scoring, tool_calls, tournament, toxicity, winnowing

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_language": language.op2_language,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_licences": licences.op5_licences,
    "op6_cap_filters": caps.op6_cap_filters,
    "op7_winnowing": winnowing.op7_winnowing,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_tool_calls": tool_calls.op9_tool_calls,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_alignment": alignment.op11_alignment,
    "op12_scoring": scoring.op12_scoring,
    "op13_centroids": tournament.op13_centroids,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op3_mix_sources": mixing.ORACLE,
    "op9_tool_calls": tool_calls.ORACLE,
    "op13_centroids": tournament.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
