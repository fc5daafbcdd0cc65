"""The driver entry without the corpus operators, with and without their pipeline's file."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent
RUN = """
import tempfile
from pyspark.sql import SparkSession
import __spark_entry__ as entry
assert not any(k.startswith("op") or k == "pipeline" for k in entry.queries()), "corpus queries are still there"
assert set(entry.oracle_sql()) == set(entry.queries())
spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.sql.warehouse.dir", tempfile.mkdtemp()).getOrCreate()
)
assert entry.entry(spark).count() > 0
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_corpus_operators(tmp_path, pipeline):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    done = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr
