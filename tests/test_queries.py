"""Registered queries against their SQL on the smallest tables, and properties of their plans."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import differences, duck

SF = "/root/testdata/sf0.001"
# Fits of many models; their results are tested on fixtures.
SLOW = {n for n in entry.queries() if n.startswith(("ml_", "gbt_"))} | {"recommendations", "recommendation_counts", "executive_overview"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []
    spark.catalog.clearCache()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["business_kpis", "numeric_stats", "duplicate_rows", "quality_score", "column_profile", "latest_per_key", "class_metrics", "anomaly_zscore", "scale_standard", "resample_interpolate"])
def test_no_cartesian_product(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_the_needed_columns(spark):
    text = plan(entry.queries()["box_by_class"](spark, SF))
    assert "l_returnflag" in text and "l_shipdate" not in text


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"segment_name", "customer_count"} <= set(rows[0].asDict())


@pytest.mark.parametrize("gone", [["brightledger/llm"], ["brightledger/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_without_the_corpus_operators(tmp_path, gone):
    """A copy of the library without that folder or the pipeline still lists the other queries and their SQL."""
    root = Path(entry.__file__).parent
    skip = {root / g for g in gone}
    for name in ("brightledger", "__spark_entry__.py", "corpus_pipeline.py"):
        for f in [root / name] if (root / name).is_file() else (root / name).rglob("*.py"):
            if f.exists() and not skip & {f, *f.parents}:
                (tmp_path / f.relative_to(root)).parent.mkdir(parents=True, exist_ok=True)
                (tmp_path / f.relative_to(root)).write_bytes(f.read_bytes())
    (tmp_path / "brightledger" / "llm").mkdir(exist_ok=True)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    names = set(out.stdout.split())
    assert "pipeline" not in names and len(names) > 100 and ("op4_substrings" in names) == (gone == ["corpus_pipeline.py"] and "op4_substrings" in entry.queries())
