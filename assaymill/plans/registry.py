"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F

from assaymill.plans import analytics, evidence, handover, ledger, loop, reports, routing, screening, star

MODULES = (screening, evidence, analytics, handover, ledger, star, routing, reports, loop)

#: Columns of small integers, which both sides give as 64-bit ones.
INTEGERS = {
    "rule_findings": ["rule_seq"], "callout_ids": ["seq"], "reviewer_candidates": ["place"], "page_texts": ["empty_pages"],
    "asserted_loader": ["seq"], "base_rate_cohort": ["rung"], "route_topk": ["rank"], "route_pages_saved": ["k"],
    "forecast_baselines": ["step"], "forecast_audit": ["step"], "history_sweep": ["length"], "cohort_covariate": ["t_from_end"],
    "quarter_facts": ["days"], "tag_fallback": ["tag_priority"], "nearest_events": ["place"], "colour_bins": ["place"],
    "grid_rows": ["line"], "assignment_pairs": ["img"], "label_match": ["img", "labels", "unmatched"],
    "fold_back_violations": ["idx"], "top_parts_by_brand": ["place"], "memo_diff": ["idx"], "route_items": ["rank"], "route_titles": ["rank"], "route_titles_saved": ["k"], "nearest_vectors": ["rank"],
    "page_blocks": ["n_chars"], "screened": ["by_text", "by_vision", "off_axis"],
}


def _widened(name: str, query: Callable) -> Callable:
    @wraps(query)
    def run(spark, sf_dir):
        return query(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in INTEGERS[name]})

    return run


def _widened_sql(name: str, sql: str) -> str:
    return f"select * replace ({', '.join(f'cast({c} as bigint) as {c}' for c in INTEGERS[name])}) from ({sql})"


def queries() -> dict[str, Callable]:
    return {n: _widened(n, f) if n in INTEGERS else f for m in MODULES for n, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: _widened_sql(n, s) if n in INTEGERS else s for m in MODULES for n, s in m.SQL.items()}
