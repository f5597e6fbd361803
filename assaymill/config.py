"""Rubrics, keyword lists and bands: all thresholds live here, as data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

# The ten metrics, the words that name each of them on a page, and their kinds.
METRICS = [
    "arr_usd", "mrr_usd", "recurring_pct", "grr_pct", "nrr_pct",
    "gross_margin_pct", "ebitda_usd", "yoy_growth_pct", "top1_customer_pct", "top5_customer_pct",
]
MONEY_METRICS = ["arr_usd", "mrr_usd", "ebitda_usd"]
METRIC_WORDS = {
    "arr_usd": ["annual recurring revenue", "arr"],
    "mrr_usd": ["monthly recurring revenue", "mrr"],
    "recurring_pct": ["recurring"],
    "grr_pct": ["gross revenue retention", "gross retention"],
    "nrr_pct": ["net revenue retention", "net retention"],
    "gross_margin_pct": ["gross margin"],
    "ebitda_usd": ["ebitda"],
    "yoy_growth_pct": ["grew", "growth", "year over year"],
    "top1_customer_pct": ["largest customer", "top customer", "customer concentration"],
    "top5_customer_pct": ["top five", "top 5", "customers 2-5", "customer concentration"],
}
REQUIRED_METRICS = ["arr_usd", "recurring_pct", "grr_pct", "ebitda_usd"]

# Terms of the question classifier, in the order in which they are tried. Terms between
# bars match as whole words.
NOVEL_TERMS = {
    "founder_dependency": ["founder", "key person", "succession", "single point", "bus factor", "one person", "departs", "leaves"],
    "legacy_tech": ["legacy", "delphi", "rewrite", "modernis", "moderniz", "technical debt", "unsupported", "test coverage", "1998"],
    "ai_displacement": ["|ai|", "commodit", "displace", "|llm|", "automat"],
    "customer_health": ["going out of business", "insolven", "creditor", "customer's own", "distress", "acquired by a competitor", "consolidat", "bankrupt"],
    "definition_quality": ["definition", "basis", "adjusted", "add-back", "add back", "excludes", "flatter"],
}
RULE_TERMS = {
    "concentration": ["concentration", "largest customer", "top five", "top 5", "single customer", "one customer"],
    "recurring": ["recurring", "one-time", "one time", "services revenue"],
    "ebitda": ["ebitda", "loss-making", "unprofitable", "negative earnings"],
    "retention": ["retention", "grr", "nrr", "churn rate"],
    "margin": ["gross margin", "margin"],
    "arr_band": ["arr", "annual recurring revenue", "size of the business"],
}
NOVEL_PRESENT = {
    "clean_gem": ["definition_quality", "ai_displacement"],
    "concentration_risk": ["customer_health", "definition_quality", "ai_displacement"],
    "fake_saas_low_recurring": ["definition_quality", "customer_health", "ai_displacement"],
    "unprofitable_high_growth": ["definition_quality", "customer_health", "ai_displacement"],
    "legacy_tech_key_person": ["founder_dependency", "legacy_tech", "customer_health", "definition_quality", "ai_displacement"],
}


@dataclass(frozen=True)
class Rubric:
    """What a target is held against, and how much each part weighs."""

    # The default criteria; any other rubric is read from a file.
    name: str = "Buy-and-hold software"
    arr_min: float = 2_000_000.0
    arr_max: float = 30_000_000.0
    arr_weight: float = 15.0
    recurring_floor: float = 80.0
    recurring_weight: float = 20.0
    grr_floor: float = 85.0
    grr_weight: float = 20.0
    nrr_target: float = 100.0
    nrr_weight: float = 10.0
    margin_floor: float = 65.0
    margin_weight: float = 10.0
    ebitda_required: bool = True
    ebitda_weight: float = 15.0
    rule_of_40: float = 40.0
    top1_cap: float = 15.0
    top5_cap: float = 35.0
    concentration_weight: float = 10.0
    tier_1: float = 75.0
    tier_2: float = 55.0
    mrr_drift: float = 0.05
    blockers: tuple[str, ...] = field(default=("R2", "R3", "R8"))

    @classmethod
    def read(cls, path: str | Path) -> Rubric:
        """A rubric file: one JSON object with a group for each criterion."""
        d = json.loads(Path(path).read_text(encoding="utf-8"))
        return cls(
            name=d["profile_name"],
            arr_min=float(d["arr_band_usd"]["min"]),
            arr_max=float(d["arr_band_usd"]["max"]),
            arr_weight=float(d["arr_band_usd"]["weight"]),
            recurring_floor=float(d["recurring_pct_floor"]["value"]),
            recurring_weight=float(d["recurring_pct_floor"]["weight"]),
            grr_floor=float(d["grr_pct_floor"]["value"]),
            grr_weight=float(d["grr_pct_floor"]["weight"]),
            nrr_target=float(d["nrr_pct_target"]["value"]),
            nrr_weight=float(d["nrr_pct_target"]["weight"]),
            margin_floor=float(d["gross_margin_pct_floor"]["value"]),
            margin_weight=float(d["gross_margin_pct_floor"]["weight"]),
            ebitda_required=bool(d["ebitda_positive"]["required"]),
            ebitda_weight=float(d["ebitda_positive"]["weight"]),
            rule_of_40=float(d["rule_of_40_floor"]["value"]),
            top1_cap=float(d["concentration_caps"]["top1_pct_max"]),
            top5_cap=float(d["concentration_caps"]["top5_pct_max"]),
            concentration_weight=float(d["concentration_caps"]["weight"]),
            tier_1=float(d["tiers"]["tier_1_min_score"]),
            tier_2=float(d["tiers"]["tier_2_min_score"]),
        )


DEFAULT = Rubric()
#: For the cells of the star-schema tables, whose retention is lower and margins higher than a company's.
CELLS = replace(DEFAULT, name="cells", grr_floor=50.0, margin_floor=95.0)

#: Cohorts: upper bounds of size and retention bands, rungs from narrow to wide, and the least cohort.
SIZE_BANDS = [("small", 3_000_000.0), ("lower", 10_000_000.0), ("mid", 20_000_000.0), ("large", None)]
RETENTION_BANDS = [("weak", 85.0), ("solid", 92.0), ("strong", None)]
#: Which keys a rung matches on: vertical, size, retention.
RUNGS = [(True, True, True), (False, True, True), (False, False, True), (False, True, False), (False, False, False)]
LEAST_COHORT = 8
OUT_OF_RANGE = 1.5

#: Customer signal: share of revenue from which a single customer, or all together, is material.
MATERIAL_SINGLE, MATERIAL_TOTAL = 10.0, 15.0

#: Characters around a word that names a metric in which its number is looked for.
NEAR_CHARS = 140

# Patterns by which a page announces an exhibit of a metric that was not recovered.
EXHIBIT_HINTS = {
    "grr_pct": [r"gross\s+revenue\s+retention", r"gross\s+retention"],
    "nrr_pct": [r"net\s+revenue\s+retention", r"net\s+retention"],
    "top1_customer_pct": [r"largest\s+customer", r"top\s+customer"],
    "top5_customer_pct": [r"top\s+(five|5)\s+customers"],
}
EXHIBIT_WORDS = r"chart|graph|figure|exhibit|axis"
READ_KINDS = ["prose", "table", "label", "axis"]
MOST_PAGE_RECORDS = 40
