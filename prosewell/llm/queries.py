"""The queries of this subpackage, by name, and the SQL that some of them must agree with."""

from __future__ import annotations

import importlib

#: Query name to the module that has it; a module is loaded when its query runs or its SQL is asked for.
MODULES = {
    "op1_minhash": "minhash",
    "op2_url_filters": "url_filters",
    "op3_suffix_tree_lm": "suffix_tree_lm",
    "op4_suffix_dedup": "suffix_dedup",
    "op5_decontamination": "decontamination",
    "op6_token_output": "token_output",
    "op7_quality": "quality",
    "op8_compact_windows": "compact_windows",
    "op9_media": "media",
    "op10_mixing": "mixing",
}


def _module(name: str):
    return importlib.import_module(f"prosewell.llm.{MODULES[name]}")


def queries() -> dict:
    return {name: lambda spark, sf_dir, name=name: _module(name).query(spark, sf_dir) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "SQL", None))}
