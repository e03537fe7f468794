"""Shared building blocks, with their large-table paths forced on small inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brightledger.functions.columns import column_kinds, iso_text_columns
from brightledger.functions.counts import count_summary, value_counts
from brightledger.functions.joins import frequent_values, lookup_join
from brightledger.functions.moments import _gram_correlations, pair_correlations
from brightledger.functions.quantiles import quantiles, quantiles_by_class
from brightledger.functions.ranking import average_ranks, hash_positions, positions


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({
        "k": np.arange(n),
        "spread": rng.normal(0, 1000, n),
        "hot": np.where(rng.random(n) < 0.35, 7.0, rng.integers(0, 40, n)),
        "two": rng.integers(0, 2, n).astype(float),
        "gaps": np.where(rng.random(n) < 0.2, np.nan, rng.exponential(5, n)),
    })
    df = spark.createDataFrame(pdf).withColumn("gaps", F.when(~F.isnan("gaps"), F.col("gaps")))
    return pdf, df.persist()


PROBS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.95, 1.0]


@pytest.mark.parametrize("column", ["spread", "hot", "two", "gaps"])
@pytest.mark.parametrize("buffer", [10**7, 0])
def test_quantiles_equal_numpy_on_both_paths(numbers, column, buffer):
    pdf, df = numbers
    got = quantiles(df, {"x": F.col(column)}, PROBS, buffer_values=buffer, last_values=50)["x"]
    assert np.allclose(got, np.nanquantile(pdf[column], PROBS), rtol=1e-12, atol=1e-12)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": [None]}


def test_quantiles_by_class_with_a_class_too_large_for_one_buffer(numbers):
    pdf, df = numbers
    got = {r["class"]: r["q"] for r in quantiles_by_class(df, F.col("hot"), F.col("spread"), [0.25, 0.5], class_rows=1000).collect()}
    for c, part in pdf.groupby("hot")["spread"]:
        assert np.allclose(got[c], part.quantile([0.25, 0.5]))


@pytest.mark.parametrize("limit", [10**6, 0])
def test_positions_number_all_rows_in_order(numbers, limit):
    pdf, df = numbers
    got = positions(df.select("k", "hot"), ["hot", "k"], "at", len(pdf), one_task_rows=limit).orderBy("at").toPandas()
    want = pdf[["hot", "k"]].sort_values(["hot", "k"])
    assert got["at"].tolist() == list(range(len(pdf))) and got["k"].tolist() == want["k"].tolist()


def test_hash_positions_cover_each_group(numbers):
    pdf, df = numbers
    got = hash_positions(df.select("k", "hot"), ["hot"], F.md5(F.col("k").cast("string")), "at", ["k"]).toPandas()
    assert len(got) == len(pdf)
    for _, part in got.groupby("hot"):
        assert sorted(part["at"]) == list(range(len(part))) and (part["at_size"] == len(part)).all()


@pytest.mark.parametrize("per_slice", [10**6, 700])
def test_average_ranks_equal_pandas(numbers, per_slice):
    pdf, df = numbers
    got = average_ranks(df.select("k", "spread", "hot"), ["spread", "hot"], len(pdf), per_slice).toPandas().sort_values("k")
    for c in ("spread", "hot"):
        assert np.allclose(got[c], pdf[c].rank())


def test_lookup_join_keeps_rows_with_hot_and_null_keys(spark):
    rows = [("a",)] * 500 + [(None,)] * 300 + [("b",)] * 3 + [("zz",)]
    df = spark.createDataFrame([(i, k[0]) for i, k in enumerate(rows)], "i int, k string")
    hot = frequent_values(df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "n", len(rows), 0.1)
    assert hot == ["a"]
    out = lookup_join(df, spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "k", hot)
    assert {(r["k"], r["v"]): r["n"] for r in out.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).collect()} == {("a", 1): 500, (None, None): 300, ("b", 2): 3, ("zz", None): 1}


def test_gram_correlations_are_pairwise_complete(numbers):
    pdf, df = numbers
    cols = ["spread", "hot", "two", "gaps"]
    table = df.withColumn("flat", F.lit(4.0)).withColumn("twin", F.col("spread") * 2 + F.col("two"))
    names = [*cols, "flat", "twin"]
    from itertools import combinations
    got = _gram_correlations(table, names, list(combinations(names, 2)))
    want = pdf[cols].assign(flat=4.0, twin=pdf["spread"] * 2 + pdf["two"])[names].corr()
    for (a, b), r in got.items():
        if "flat" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)
    few = pair_correlations(df, ["spread", "gaps"])
    assert few[("spread", "gaps")] == pytest.approx(pdf["spread"].corr(pdf["gaps"]), abs=1e-9)


def test_value_counts_and_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), (None, 2), ("b", 2), ("a", None)], "s string, n int")
    got = {r["column_name"]: r for r in count_summary(value_counts(df, ["s", "n"])).collect()}
    assert (got["s"]["distinct_count"], got["s"]["top_value"], got["s"]["top_freq"], got["s"]["filled"]) == (2, "a", 2, 4)
    assert (got["n"]["distinct_count"], got["n"]["top_value"]) == (2, "1")


def test_kinds_and_iso_text(spark):
    df = spark.createDataFrame([(True, "2024-01-02", "x1", "12")] * 6 + [(False, "soon", None, "13")], "b boolean, d string, s string, n string")
    assert iso_text_columns(df) == {"d"}
    assert column_kinds(df) == {"b": "numerical", "d": "datetime", "s": "categorical", "n": "categorical"}


@pytest.mark.parametrize("class_rows,last", [(10**6, 100), (50, 20), (50, 5), (0, 1)])
def test_quantiles_of_all_large_classes_together(spark, monkeypatch, class_rows, last):
    from brightledger.functions import quantiles as Q

    monkeypatch.setattr(Q, "LATTICE", 8)
    rng = np.random.default_rng(class_rows + last)
    pdf = pd.DataFrame({"c": rng.choice(["a", "b", "c", "d", None], 4000, p=[0.7, 0.2, 0.05, 0.04, 0.01]), "v": np.round(rng.normal(0, 3, 4000), 1)})
    pdf.loc[rng.random(4000) < 0.05, "v"] = np.nan
    pdf.loc[pdf["c"] == "b", "v"] = 7.0
    pdf = pd.concat([pdf, pd.DataFrame({"c": ["one"], "v": [3.25]})])
    df = spark.createDataFrame([(c, None if np.isnan(v) else float(v)) for c, v in zip(pdf["c"], pdf["v"])], "c string, v double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["class"]: r["q"] for r in Q.quantiles_by_class(df, F.col("c"), F.col("v"), probs, class_rows, last).collect()}
    want = pdf.dropna().groupby("c")["v"].quantile(probs).unstack()
    assert set(got) == set(want.index) and all(np.allclose(got[c], want.loc[c]) for c in got)


def test_compact_holds_the_partitions_to_the_rows(spark):
    from brightledger.functions.layout import compact

    # More partitions than cores are left, and still no more than the rows ask for.
    df = spark.range(0, 1000, 1, 64)
    assert compact(df, rows_per_task=50).rdd.getNumPartitions() == 21
    assert compact(df, 1000, 1).rdd.getNumPartitions() == 64


def test_compact_holds_large_tables_to_a_few_partitions_a_core(spark):
    from brightledger.functions.layout import compact

    # 1,001 partitions of 100 rows would be 40 for each of 8 cores; they get ten times the rows.
    df = spark.range(0, 100_000, 1, 200)
    assert compact(df, rows_per_task=100).rdd.getNumPartitions() == 101
    # And never so few that cores are idle.
    assert compact(df, rows_per_task=2_500).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
