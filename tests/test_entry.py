import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names_at(folder):
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    queries, oracles = (set(line.split()) for line in out.stdout.strip().splitlines())
    return queries, oracles


def test_the_rest_works_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT / "panelloom", tmp_path / "panelloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    queries, oracles = names_at(tmp_path)
    assert "monthly_ic_momentum" in queries and oracles <= queries and not any(q.startswith("op") and q[2].isdigit() for q in queries)


def test_every_oracle_has_a_query():
    queries, oracles = names_at(ROOT)
    assert oracles <= queries and len(queries) > 80


def test_no_other_part_imports_the_corpus_subpackage():
    for path in (ROOT / "panelloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
