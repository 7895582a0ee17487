"""Registry of the corpus queries: one ``opN_<name>`` per operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from cellweave.llm import decontaminate, language, linededup, mixing, pagetext, quality, secrets, simhash, tokencount, toxicity


def queries() -> dict:
    return {
        "op1_html_text": pagetext.op1,
        "op2_decontamination": decontaminate.op2,
        "op3_secrets": secrets.op3,
        "op4_toxicity": toxicity.op4,
        "op5_quality_rules": quality.op5,
        "op6_language": language.op6,
        "op7_line_dedup": linededup.op7,
        "op8_token_counts": tokencount.op8,
        "op9_mixing": mixing.op9,
        "op10_simhash": simhash.op10,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontaminate.OP2_SQL, "op7_line_dedup": linededup.OP7_SQL}
