"""The driver's contract, and that the core stands without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from quillmesh import registry


def test_entry_runs_the_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r.stance for r in rows} <= {"praise", "critique", "suggestion", "neutral"}


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_nothing_of_the_core_imports_llm():
    root = Path(entry.__file__).parent
    for path in (root / "quillmesh").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quillmesh.llm" not in path.read_text()


def test_queries_without_the_llm_folder():
    code = "import sys; sys.modules['quillmesh.llm'] = None\nimport importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('quillmesh.llm') else f(n, *a)\nimport __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q[0] == 'p' and q[1].isdigit()]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)
