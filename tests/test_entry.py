"""The driver contract, with and without the optional parts."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def names(folder: Path) -> tuple[list[str], list[str]]:
    """What ``queries`` and ``oracle_sql`` name in a copy of the repository."""
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": "", "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout
    return tuple(line.split() for line in out.splitlines())


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_optional_parts_can_be_deleted(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    here = tmp_path / "repo"
    optional = [here / "tallyforge/llm", here / "tests/llm"]
    every, _ = names(here)
    if all(part.exists() for part in optional):
        assert {"pipeline", "op1_simhash", "op10_chat"} <= set(every)
        for part in optional:
            shutil.rmtree(part)
    for left in ("corpus_pipeline.py", None):
        queries, oracles = names(here)
        assert set(oracles) <= set(queries) and queries == [n for n in every if n != "pipeline" and not re.match(r"op\d", n)]
        if left:
            (here / left).unlink(missing_ok=True)
