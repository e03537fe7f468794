"""Exploration and customer analytics on small tables."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brightledger.operators import customers as C
from brightledger.operators import explore as E


def test_explore_finds_the_planted_patterns(spark):
    rng = np.random.default_rng(42)
    n = 100
    amount = rng.normal(100, 10, n)
    amount[10] = 999
    rows = [((datetime(2024, 1, 1) + timedelta(days=i)).strftime("%Y-%m-%d"), None if i % 20 == 0 else float(a), float(3.5 * a), "gold" if i % 5 else "silver", i % 2) for i, a in enumerate(amount)]
    df = spark.createDataFrame(rows, "timestamp string, amount double, amount_scaled double, tier string, target int")
    out = E.explore(df, "target")
    stats = {r["column_name"]: r for r in out["numeric"].collect()}
    assert stats["amount"]["missing_count"] == 5 and stats["amount"]["skewness"] != 0
    top = out["pairs"].first()
    assert {top["feature1"], top["feature2"]} == {"amount", "amount_scaled"} and top["abs_pearson"] > 0.8
    assert out["outliers"].where("column_name = 'amount'").first()["iqr_outliers"] >= 1
    assert out["trends"].count() == 3
    assert {"CORRELATION", "CATEGORICAL"} <= {r["category"] for r in out["insights"].collect()}
    assert {r["class"]: r["n"] for r in out["target_classes"].collect()} == {"0": 50, "1": 50}


def test_sample_is_stable_and_about_the_size(spark):
    df = spark.range(20000)
    a = {r[0] for r in E.sampled(df, 2000, ["id"]).collect()}
    assert a == {r[0] for r in E.sampled(df.repartition(13), 2000, ["id"]).collect()} and 1600 < len(a) < 2400


def test_spearman_with_ties_equals_pandas(spark):
    pdf = pd.DataFrame({"a": [1, 2, 2, 3, 9, 9, 9.0], "b": [5, 5, 4, 3, 2, 1, 1.0]})
    got = E.spearman_matrix(spark.createDataFrame(pdf)).where("feature1 = 'a' and feature2 = 'b'").first()["spearman"]
    assert got == pytest.approx(pdf["a"].rank().corr(pdf["b"].rank()), abs=1e-4)


def test_mapping_by_alias(spark):
    m = C.resolve_mapping(["client_identifier", "transaction_date", "sales_revenue", "net_margin"])
    assert (m.customer_id, m.order_date, m.revenue, m.profit) == (None, "transaction_date", "sales_revenue", "net_margin") or m.customer_id == "client_identifier"
    given = C.resolve_mapping(["a", "date", "price"], C.ColumnMapping(customer_id="a", revenue="missing"))
    assert (given.customer_id, given.order_date, given.revenue, given.churn) == ("a", "date", "price", None)


def test_kpis_without_customers(spark):
    df = spark.createDataFrame([("p1", 100.0), ("p2", 200.0), ("p3", 150.0), ("p4", 300.0)], "product string, sales double")
    out = C.analyse_customers(df)
    k = out["kpis"].first()
    assert (k["total_revenue"], k["average_order_value"], k["total_customers"], k["total_profit"]) == (750.0, 187.5, 4, None)
    assert out["insights"].count() == 1 and "rfm" not in out


@pytest.fixture(scope="module")
def orders(spark):
    rng = np.random.default_rng(42)
    rows = [(f"C_{int(rng.integers(0, 29))}", datetime(2024, 1, 1) + timedelta(hours=12 * i), float(rng.uniform(10, 500)), float(rng.uniform(1, 50))) for i in range(150)]
    return spark.createDataFrame(rows, "customer_id string, order_date timestamp, revenue double, profit double").persist()


@pytest.fixture(scope="module")
def two_kinds(spark):
    """Six customers with ten large recent orders each, nine with one small old one."""
    last = datetime(2024, 6, 30)
    rows = [(f"big{c}", last - timedelta(days=3 * i + c), 1000.0 + c) for c in range(6) for i in range(10)]
    rows += [(f"small{c}", last - timedelta(days=300 + c), 20.0 + c) for c in range(9)]
    return spark.createDataFrame(rows, "customer_id string, order_date timestamp, revenue double")


@pytest.mark.parametrize("algorithm", ["kmeans", "hierarchical"])
def test_two_kinds_of_customers_are_two_clusters(two_kinds, algorithm):
    out = C.analyse_customers(two_kinds, algorithm=algorithm)
    assert out["cluster_quality"].first()["optimal_k"] == 2
    labels = {r["customer_id"]: r["cluster"] for r in out["clusters"].collect()}
    assert len({v for k, v in labels.items() if k[0] == "b"}) == len({v for k, v in labels.items() if k[0] == "s"}) == 1
    assert labels["big0"] != labels["small0"] and len(labels) == 15
    spent = out["segments"].agg(F.sum("customer_count"), F.sum("total_revenue_share_pct")).first()
    assert spent[0] == 15 and spent[1] == pytest.approx(100, abs=0.1)


def test_the_hierarchy_is_one_method_for_every_size(spark):
    """256 and 257 customers in three far groups give the same three clusters."""
    for n in (256, 257):
        df = spark.range(n).select(F.col("id").alias("customer_id"), (F.col("id") % 3 * 100 + F.col("id") % 2).alias("recency"), (F.col("id") % 3 * 40 + 1).alias("frequency"), (F.col("id") % 3 * 5000.0 + F.col("id") % 5).alias("monetary"))
        got = C.cluster_customers(df, "hierarchical")
        groups = got.assigned.groupBy((F.col("customer_id") % 3).alias("g")).agg(F.collect_set("cluster").alias("c")).collect()
        assert got.k == 3 and sorted(len(r["c"]) for r in groups) == [1, 1, 1] and len({r["c"][0] for r in groups}) == 3


def test_scores_match_pandas_cuts_and_the_distributed_rank(orders):
    mapping = C.resolve_mapping(orders.columns)
    a = C.rfm_table(orders, mapping).toPandas().sort_values("customer_id").reset_index(drop=True)
    b = C.rfm_table(orders, mapping, one_task_rows=0).toPandas().sort_values("customer_id").reset_index(drop=True)
    assert a.equals(b)
    assert (a["f_score"] == pd.qcut(a["frequency"].rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)).all()
    assert (a["m_score"] == pd.qcut(a["monetary"], 5, labels=[1, 2, 3, 4, 5]).astype(int)).all()


def test_equal_edges_give_the_middle_score(spark):
    df = spark.createDataFrame([(i, 5, 1, 10.0) for i in range(8)], "customer_id int, recency long, frequency long, monetary double")
    got = C.rfm_scores(df).collect()
    assert {r["r_score"] for r in got} == {3} and {r["m_score"] for r in got} == {3}
    assert sorted(r["f_score"] for r in got) == sorted(pd.qcut(pd.Series(range(8)), 5, labels=[1, 2, 3, 4, 5]).astype(int))


def test_results_do_not_depend_on_partitions(orders):
    mapping = C.resolve_mapping(orders.columns)
    runs = [sorted(map(tuple, C.rfm_table(orders.repartition(n), mapping).select("customer_id", "segment_name", "monetary").collect())) for n in (1, 17)]
    assert runs[0] == runs[1]


def brute_force_ward(x, w, k):
    """Always the two clusters whose union adds least to the sum of squares."""
    groups = [([i], w[i], x[i]) for i in range(len(x))]
    while len(groups) > k:
        a, b = min(((a, b) for a in range(len(groups)) for b in range(a)), key=lambda p: groups[p[0]][1] * groups[p[1]][1] / (groups[p[0]][1] + groups[p[1]][1]) * ((groups[p[0]][2] - groups[p[1]][2]) ** 2).sum())
        (m1, n1, c1), (m2, n2, c2) = groups[a], groups[b]
        groups = [g for i, g in enumerate(groups) if i not in (a, b)] + [(m1 + m2, n1 + n2, (n1 * c1 + n2 * c2) / (n1 + n2))]
    return {frozenset(m) for m, _, _ in groups}


def test_ward_equals_brute_force():
    from brightledger.functions.ward import cut_tree, merge_tree

    rng = np.random.default_rng(12)
    x, w = rng.normal(0, 1, (70, 3)), rng.integers(1, 9, 70).astype(float)
    merges = merge_tree(x, w)
    for k in (2, 3, 6, 20):
        labels = cut_tree(merges, 70, k)
        assert {frozenset(np.flatnonzero(labels == v)) for v in range(k)} == brute_force_ward(x, w, k)
    heights = sorted(m[2] for m in merges)
    assert len(merges) == 69 and sum(heights) * 1.0 == pytest.approx((w[:, None] * (x - np.average(x, axis=0, weights=w)) ** 2).sum())


@pytest.mark.parametrize("most", [4000, 120])
def test_ward_over_rows_and_over_cells(spark, most):
    from brightledger.functions.ward import cut_tree, merge_tree, ward_labels

    rng = np.random.default_rng(most)
    x = np.concatenate([rng.normal(c, 0.3, (100, 3)) for c in (-4, 0, 5)])
    x = np.concatenate([x, x[:20]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(i=range(320)))
    out, width = ward_labels(df, ["a", "b", "c"], [2, 3, 5], most)
    got = out.orderBy("i").toPandas()
    assert len(got) == 320 and (width == 0) == (most == 4000)
    labels = np.stack(got["_labels"].to_numpy())
    planted = np.r_[np.repeat([0, 1, 2], 100), np.zeros(20, int)]
    assert len(set(zip(labels[:, 1], planted))) == 3
    if most == 4000:
        uniq, inverse, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
        merges = merge_tree(uniq, n)
        for i, k in enumerate([2, 3, 5]):
            want = cut_tree(merges, len(uniq), k)[inverse.ravel()]
            assert len(set(zip(want, labels[:, i]))) == k


def test_ward_finds_its_width_without_a_sketch_per_width(spark, monkeypatch):
    from brightledger.functions import ward

    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (400, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])).persist()
    asked = []
    monkeypatch.setattr(ward, "_cell", lambda columns, width, cell=ward._cell: asked.append(width) or cell(columns, width))
    _, width = ward.ward_labels(df, ["a", "b"], [2], 50)
    fits = [w for w in (ward.FIRST_WIDTH * 2**i for i in range(40)) if len(np.unique(np.floor(x / w), axis=0)) <= 50]
    assert width == fits[0] and len(asked) <= 12
