import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and all(r.label >= 3 for r in rows) and rows[0].vector_score == 1.0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_optional_part():
    for file in (ROOT / "siltstone").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", file.read_text(), re.M), file
