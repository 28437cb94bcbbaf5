import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from compare import both, connect

from lemmagraph.plans import catalog


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, data, name):
    mine, other = both(spark, con, data, catalog.QUERIES[name], catalog.ORACLES[name])
    assert mine == other


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["root", "key", "hops", "missing"]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_module_without_operators_on_training_data(tmp_path, pipeline):
    top = Path(__file__).resolve().parents[1]
    left = shutil.ignore_patterns("llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(top / "lemmagraph", tmp_path / "lemmagraph", ignore=left)
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (top / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(top / name, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))]
