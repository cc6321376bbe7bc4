"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

# Module and query of each operator.
OPERATORS = (
    ("token_align", "op11_token_align"),
    ("whitening", "op12_whitening"),
    ("chat_format", "op13_chat_format"),
    ("embed_dedup", "op6_embedding_dedup"),
    ("line_dedup", "op4_line_dedup"),
    ("toxicity", "op8_toxicity"),
    ("langid", "op3_language_id"),
    ("url_filter", "op5_url_filter"),
    ("token_output", "op10_token_output"),
    ("mixing", "op1_mixing"),
    ("secrets", "op2_secrets"),
    ("simhash", "op7_simhash"),
    ("decontaminate", "op9_decontaminate"),
)


def all_queries() -> dict:
    found = {}
    for module, name in OPERATORS:
        held = importlib.import_module(f"feedloom.llm.{module}")
        found[name] = (getattr(held, name), getattr(held, "SQL", None))
    return found
