"""The driver contract, with the optional subpackage and without it."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SHOWN = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()), 'pipeline' in e.queries())"


def shown(folder) -> list[str]:
    return subprocess.run([sys.executable, "-c", SHOWN], cwd=folder, capture_output=True, text=True, check=True, timeout=120).stdout.split()


def test_rest_works_without_the_subpackage(tmp_path):
    from worktide.plans import registry

    whole = tmp_path / "whole"
    shutil.copytree(ROOT, whole, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(whole / "worktide" / "llm", ignore_errors=True)
    core = [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL)), "False", "False"]
    assert shown(whole) == core  # the pipeline's module is there, its operators are not
    (whole / "corpus_pipeline.py").unlink(missing_ok=True)
    assert shown(whole) == core
