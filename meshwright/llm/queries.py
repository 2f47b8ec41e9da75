"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from meshwright.llm.op1_html import op1_html_extraction
from meshwright.llm.op10_toxicity import op10_toxicity
from meshwright.llm.op11_negatives import SQL as NEGATIVES_SQL
from meshwright.llm.op11_negatives import op11_hard_negatives
from meshwright.llm.op12_whitening import op12_embedding_whitening
from meshwright.llm.op13_tokens import op13_token_counts
from meshwright.llm.op2_lines import op2_line_dedup
from meshwright.llm.op3_quality import op3_quality
from meshwright.llm.op4_lm import op4_lm_scoring
from meshwright.llm.op5_media import op5_media_columns
from meshwright.llm.op6_minhash import op6_minhash_dedup
from meshwright.llm.op7_packing import op7_packing
from meshwright.llm.op8_mixing import op8_mixing
from meshwright.llm.op9_rules import op9_quality_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_line_dedup,
        op3_quality,
        op4_lm_scoring,
        op5_media_columns,
        op6_minhash_dedup,
        op7_packing,
        op8_mixing,
        op9_quality_rules,
        op10_toxicity,
        op11_hard_negatives,
        op12_embedding_whitening,
        op13_token_counts,
    )
}

QUERIES["pipeline"] = corpus_pipeline.run

ORACLE_SQL: dict[str, str] = {"op11_hard_negatives": NEGATIVES_SQL}
ORACLE_SQL |= {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
