"""The driver's entry points, and independence from the optional subpackage."""

import ast
from pathlib import Path

import __spark_entry__ as entry_module

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["s1_id", "cand_id", "matched_rules", "has_exact_rule", "rank"]


def test_twins_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_nothing_else_imports_llm():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("tessera.llm") for n in names), p
