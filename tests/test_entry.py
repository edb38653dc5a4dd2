import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    """On a copy: neither folder, nor the pipeline, is there."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for gone in ("siltstone/llm", "tests/llm"):
        shutil.rmtree(copy / gone, ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(len(e.oracle_sql()))"], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120, check=True).stdout
    names, n = said.splitlines()
    assert "bm25_topk" in names.split() and "pipeline" not in names.split() and not any(x.startswith("op1_") for x in names.split()) and int(n) > 70
