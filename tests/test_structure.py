"""What may import what, and what plans may look like."""

import ast
from pathlib import Path

import pytest

from assaymill.plans import registry

ROOT = Path(__file__).resolve().parents[1]
MAIN = [p for p in (ROOT / "assaymill").rglob("*.py") if "llm" not in p.parts]


def imports(path):
    for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
        if isinstance(node, ast.ImportFrom):
            yield node.module or ""
            yield from (f"{node.module}.{a.name}" for a in node.names)
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


@pytest.mark.parametrize("path", MAIN, ids=lambda p: p.name)
def test_nothing_imports_the_text_subpackage(path):
    assert not [m for m in imports(path) if "llm" in m.split(".")]


@pytest.mark.parametrize("name", ["rules.py", "fit.py", "metrics.py"])
def test_signals_never_feed_a_score(name):
    assert not [m for m in imports(ROOT / "assaymill/operators" / name) if m.split(".")[-1] in ("signal", "cohort", "classify")]


@pytest.mark.parametrize("name", ["signal.py", "cohort.py", "classify.py"])
def test_scores_never_feed_a_signal(name):
    assert not [m for m in imports(ROOT / "assaymill/operators" / name) if m.split(".")[-1] in ("fit", "rules")]


def plan(spark, sf_dir, name):
    return registry.queries()[name](spark, sf_dir)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_scans_read_only_what_they_need(spark, sf_dir):
    text = plan(spark, sf_dir, "fit_score")
    schemas = [x for x in text.splitlines() if x.startswith("ReadSchema")]
    assert schemas and not any("l_shipdate" in x or "o_orderpriority" in x for x in schemas)
    assert "PushedFilters: [IsNotNull(o_orderdate)" in text


@pytest.mark.parametrize("name", ["fit_score", "rule_findings", "base_rate_cohort", "customer_signal", "forecast_scores"])
def test_no_python_and_no_cartesian_product(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text
