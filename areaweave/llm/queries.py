"""The queries of this subpackage and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

import corpus_pipeline
from areaweave.llm import (
    bpe,
    decontaminate,
    lines,
    neardup,
    periodic,
    quality,
    rtree,
    rules,
    search,
    secrets,
    substrings,
    tokenfiles,
    toxicity,
)

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_token_files": tokenfiles.op10_token_files,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_jaccard_join": rtree.op12_jaccard_join,
    "op13_ranked_search": search.op13_ranked_search,
    "pipeline": corpus_pipeline.run,
}

#: Place of matches (1), trained models (6, 7, 9), tokenizers (3, 10) and edit distances in
#: windows (5) are beyond SQL; these queries are tested against brute force.
ORACLES = {
    "op2_substring_dedup": substrings.ORACLE,
    "op4_near_duplicates": neardup.ORACLE,
    "op8_line_dedup": lines.ORACLE,
    "op11_periodic_runs": periodic.ORACLE,
    "op12_jaccard_join": rtree.ORACLE,
    "op13_ranked_search": search.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
