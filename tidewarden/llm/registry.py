"""Names of the corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from . import brown_lm, decontaminate, exact_dedup, html_extract, jaccard_join, license_scan, line_dedup, packing, pii, toxicity

OPERATORS = {
    "op1_exact_dedup": exact_dedup,
    "op2_line_dedup": line_dedup,
    "op3_jaccard_join": jaccard_join,
    "op4_packing": packing,
    "op5_license_scan": license_scan,
    "op6_decontaminate": decontaminate,
    "op7_brown_lm": brown_lm,
    "op8_pii": pii,
    "op9_toxicity": toxicity,
    "op10_html_extract": html_extract,
}
#: The columns of operators 5, 7 and 8 that SQL can express, as queries of their own.
BASE = {"license_scan_base": license_scan, "brown_lm_base": brown_lm, "pii_base": pii}


def queries() -> dict:
    return {name: module.query for name, module in OPERATORS.items()} | {name: module.base_query for name, module in BASE.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: module.SQL for name, module in OPERATORS.items() if hasattr(module, "SQL")}
    return found | {name: module.BASE_SQL for name, module in BASE.items()}
