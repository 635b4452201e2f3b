import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def names():
    from docloom.plans import queries

    return sorted(queries.oracle_sql())


def plain(value):
    import math

    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return tuple(plain(v) for v in value)
    if hasattr(value, "item"):
        value = value.item()
    if value is None or str(value) == "<NA>" or value != value:
        return None
    return round(value, 9) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    import duckdb

    from docloom.plans import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_entry_imports_without_the_llm_parts(tmp_path, pipeline_stays):
    import shutil

    shutil.copytree(ROOT / "docloom", tmp_path / "docloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline_stays and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'topk_cosine' in e.queries() and 'pipeline' not in e.queries() and not any(k.startswith('op1') for k in e.queries()); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    listed = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=tmp_path, check=True, env=env, capture_output=True, text=True)
    assert "test_entry" in listed.stdout and "error" not in listed.stdout
