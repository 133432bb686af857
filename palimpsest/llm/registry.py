"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

from . import hard_negatives, licenses

_QUERIES = {
    "op7_html_text": "html_text",
    "op8_nearest": "nearest",
    "op5_license_scan": "licenses",
    "op1_lm_scoring": "language_model",
    "op2_quality_classifier": "quality",
    "op4_decontaminate": "decontaminate",
    "op9_token_orc": "token_orc",
    "op10_best_fit_packing": "packing",
    "op3_ngram_join": "ngram_join",
    "op6_substring_dedup": "substring_dedup",
    "op11_tokenizer_fertility": "fertility",
    "op12_periodic_runs": "periodic_runs",
    "op13_hard_negatives": "hard_negatives",
}
_SQL: dict[str, str] = {"op5_license_scan": licenses.SQL, "op13_hard_negatives": hard_negatives.SQL}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
