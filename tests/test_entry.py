"""The driver contract: oracles belong to queries, and nothing in the library imports the corpus subpackage."""

from __future__ import annotations

import ast
from pathlib import Path

import __spark_entry__ as entry
from surveyspark.plans import registry

ROOT = Path(entry.__file__).parent


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries()) and len(registry.QUERIES) > 200


def test_nothing_imports_the_corpus_subpackage():
    for path in (ROOT / "surveyspark").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
