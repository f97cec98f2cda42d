"""The driver's entry module, and its queries against SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


LIBRARY = [n for n in __spark_entry__.oracle_sql() if not n.startswith(("op", "pipeline"))]


def test_enough_queries():
    assert len(LIBRARY) > 140


@pytest.mark.parametrize("part", range(8))
def test_queries_equal_sql(spark, part):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    run, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in LIBRARY[part::8]:
        df = run[name](spark, SF)
        found = c.execute(sql[name])
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names), name
        want = [tuple(plain(v) for v in r) for r in found.fetchall()]
        got = [tuple(plain(r[n]) for n in names) for r in df.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), name


def test_library_stands_without_the_optional_subpackage(tmp_path):
    """With what the subpackage needs out of reach, and with its folders gone, the other queries are there."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    count = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith(('op', 'pipeline')) for n in q))"
    blocked = "import sys; sys.modules['tokenizers'] = sys.modules['zstandard'] = None; "
    out = subprocess.run([sys.executable, "-c", blocked + count], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 200 and out[1] == "False"
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    out = subprocess.run([sys.executable, "-c", count], cwd=copy, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ""}).stdout.split()
    assert int(out[0]) > 200 and out[1] == "False"
