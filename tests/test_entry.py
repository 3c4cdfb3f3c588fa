"""The driver's entry with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(' '.join(e.queries()), '|', ' '.join(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=copy, capture_output=True, text=True, check=True).stdout
    queries, oracles = (set(x.split()) for x in said.split("|"))
    assert "brand_metrics_orders" in queries and oracles <= queries and "pipeline" not in queries
    assert not any(q.startswith("op") and q[2].isdigit() for q in queries)


def test_oracles_belong_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
