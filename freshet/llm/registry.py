"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from freshet.llm.bpe import op1_bpe_roundtrip
from freshet.llm.html_text import op6_layout_text
from freshet.llm.language_model import op9_pitman_yor
from freshet.llm.neardup import op3_chosen_path
from freshet.llm.packing import op8_sum_of_squares
from freshet.llm.quality import op10_risk_controlled
from freshet.llm.secrets import op5_markov_secrets
from freshet.llm.sharding import op2_prefix_shards
from freshet.llm.token_counts import op7_separator_scan
from freshet.llm.topk import OP4_SQL, op4_dual_tree

QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_roundtrip, op2_prefix_shards, op3_chosen_path, op4_dual_tree, op5_markov_secrets,
        op6_layout_text, op7_separator_scan, op8_sum_of_squares, op9_pitman_yor, op10_risk_controlled,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = {"op4_dual_tree": OP4_SQL}
