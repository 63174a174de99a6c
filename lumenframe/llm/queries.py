"""Registry of the training-data queries: one ``opN_<name>`` each, plus the pipeline."""

from __future__ import annotations

import importlib

from lumenframe.llm import decontaminate

#: Query name -> module of this package that defines the function of that name.
MODULES = {
    "op1_repair_tokens": "token_shards",
    "op2_context_mixing": "lm_score",
    "op3_host_text": "html_text",
    "op4_chat_windows": "chat",
    "op5_near_dup": "near_dup",
    "op6_decontaminate": "decontaminate",
    "op7_vector_dedup": "vector_dedup",
    "op8_curriculum_mix": "mixing",
    "op9_quality": "quality",
    "op10_chunk_dedup": "chunk_dedup",
}
ORACLE_SQL: dict[str, str] = {"op6_decontaminate": decontaminate.ORACLE}


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f"lumenframe.llm.{module}"), name) for name, module in MODULES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
