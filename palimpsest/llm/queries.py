"""Registry of the training-data queries."""

from __future__ import annotations

import importlib

#: Query name -> module.
MODULES = {
    "op1_pii": "pii",
    "op2_mixing": "mixing",
    "op3_language_id": "language_id",
    "op4_lm_score": "lm_score",
    "op5_packing": "packing",
    "op6_simhash": "simhash",
    "op7_toxicity": "toxicity",
    "op8_quality": "quality",
    "op9_media": "media",
    "op10_exact_dedup": "exact_dedup",
    "op11_line_cleaning": "line_cleaning",
    "op12_filter_audit": "filter_audit",
    "op13_centroids": "centroids",
}


def queries() -> dict:
    return {name: importlib.import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
