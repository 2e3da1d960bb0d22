"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, mixing, pii, secrets, simhash, token_counts, token_file, topk, toxicity, warc

_MODULES = {
    "op1_secrets": secrets,
    "op2_token_counts": token_counts,
    "op3_toxicity": toxicity,
    "op4_mixing": mixing,
    "op5_decontaminate": decontaminate,
    "op6_warc": warc,
    "op7_topk": topk,
    "op8_simhash": simhash,
    "op9_pii": pii,
    "op10_token_file": token_file,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if hasattr(module, "SQL")}
