import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


SAYS = """
import importlib.util
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("SAID", len(e.queries()), len(e.oracle_sql()), sum(q.startswith("op") or q == "pipeline" for q in e.queries()), e.entry(spark).count(), int(importlib.util.find_spec("corpus_pipeline") is not None))
"""


@pytest.mark.parametrize("gone", [("motiontab/llm", "tests/llm"), ("motiontab/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_optional_parts(tmp_path, gone):
    """A whole copy without them still imports, lists its queries and runs entry()."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for path in map((tmp_path / "copy").joinpath, gone):
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    # nothing of the original may be found from the copy
    bare = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path / "copy", env=bare, capture_output=True, text=True, check=True).stdout
    n, sql, optional, rows, pipeline = map(int, said.split("SAID")[1].split())
    kept = gone == ("corpus_pipeline.py",) and (ROOT / "motiontab/llm").exists()
    assert n > 50 and sql > 50 and rows > 0 and pipeline == int(not {"corpus_pipeline.py"} & set(gone) and (ROOT / "corpus_pipeline.py").exists())
    assert (optional >= 10) if kept else optional == 0
