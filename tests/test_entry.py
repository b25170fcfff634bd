"""The driver's contract, and registered queries against their SQL."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
SOME = ["find_products_for_weed", "products_for_crop", "product_details", "graph_stats", "load_labels_moa_edges", "vector_topk", "hybrid_mentions", "chunk_context", "usage_rows", "clean_html", "pii_types", "violation_rate_stream", "absolute_links"]


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(plain(tuple(r))) for r in got.select(*names).collect()) == sorted(repr(plain(r)) for r in want.fetchall())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_everything_else_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(n[:3] == 'op1' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": ""})
