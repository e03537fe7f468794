"""Customer analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import customers as C
from .views import TRANSACTIONS, TRANSACTIONS_SQL, table, transactions


def _rfm(s, d):
    return C.rfm_table(transactions(s, d), TRANSACTIONS)


def _base(s, d):
    return C.rfm_base(transactions(s, d), TRANSACTIONS).persist()


def _head(s, d):
    return C.business_kpis(transactions(s, d), TRANSACTIONS).first()


RFM_SQL = f"""t AS {TRANSACTIONS_SQL},
  g AS (SELECT customer_id, max(order_date) AS last_ts, count(*) AS frequency, greatest(round(sum(revenue), 6), 0.01::DOUBLE) AS monetary FROM t WHERE customer_id IS NOT NULL GROUP BY 1),
  b AS (SELECT customer_id, CAST(greatest(floor((epoch((SELECT max(order_date) FROM t)) - epoch(last_ts)) / 86400), 0) AS BIGINT) AS recency, frequency, monetary FROM g),
  q AS (SELECT quantile_cont(recency, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS re, quantile_cont(monetary, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS me, count(*) AS n FROM b),
  k AS (SELECT b.*, row_number() OVER (ORDER BY frequency, customer_id) - 1 AS pos FROM b),
  s AS (SELECT k.customer_id, k.recency, k.frequency, k.monetary,
    CAST(CASE WHEN len(list_distinct(re)) < 6 THEN 3 ELSE 5 - (CASE WHEN recency > re[2] THEN 1 ELSE 0 END) - (CASE WHEN recency > re[3] THEN 1 ELSE 0 END)
      - (CASE WHEN recency > re[4] THEN 1 ELSE 0 END) - (CASE WHEN recency > re[5] THEN 1 ELSE 0 END) END AS INTEGER) AS r_score,
    CAST(1 + (CASE WHEN 5*pos > (n-1)*1 THEN 1 ELSE 0 END) + (CASE WHEN 5*pos > (n-1)*2 THEN 1 ELSE 0 END) + (CASE WHEN 5*pos > (n-1)*3 THEN 1 ELSE 0 END)
      + (CASE WHEN 5*pos > (n-1)*4 THEN 1 ELSE 0 END) AS INTEGER) AS f_score,
    CAST(CASE WHEN len(list_distinct(me)) < 6 THEN 3 ELSE 1 + (CASE WHEN monetary > me[2] THEN 1 ELSE 0 END) + (CASE WHEN monetary > me[3] THEN 1 ELSE 0 END)
      + (CASE WHEN monetary > me[4] THEN 1 ELSE 0 END) + (CASE WHEN monetary > me[5] THEN 1 ELSE 0 END) END AS INTEGER) AS m_score FROM k, q),
  r AS (SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions' WHEN f_score >= 4 AND m_score >= 3 THEN 'Loyal Customers'
      WHEN r_score >= 3 AND f_score >= 2 AND m_score >= 2 THEN 'Potential Loyalists' WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'At Risk'
      WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Hibernating' WHEN r_score = 1 AND f_score = 1 THEN 'Lost' ELSE 'Promising' END AS segment_name FROM s)"""

KPI_SQL = f"""kp AS (SELECT round(sum(revenue), 2) AS total_revenue, round(sum(profit), 2) AS total_profit, round(sum(revenue) / count(*), 2) AS average_order_value,
   count(DISTINCT customer_id) AS total_customers,
   round((SELECT count(*) FROM (SELECT customer_id FROM {TRANSACTIONS_SQL} x GROUP BY 1 HAVING count(*) > 1) z) * 100.0::DOUBLE / count(DISTINCT customer_id), 2) AS repeat_purchase_rate,
   round(sum(profit) * 100.0 / sum(revenue), 2) AS profit_margin_pct FROM {TRANSACTIONS_SQL} y)"""

_SEGMENTS = """sg AS (SELECT segment_name, count(*) AS customer_count, round(avg(recency), 1) AS avg_recency_days, round(avg(frequency), 1) AS avg_frequency,
   round(avg(monetary), 2) AS avg_monetary_value, round(sum(monetary) * 100.0 / greatest(1.0::DOUBLE, (SELECT total_revenue FROM kp)), 2) AS total_revenue_share_pct FROM r GROUP BY 1)"""

_CLV = """cl AS (SELECT round(avg(monetary), 2) AS average_historical_clv, round(avg(frequency * (SELECT average_order_value FROM kp) * 0.80::DOUBLE), 2) AS average_projected_12m_clv,
   (SELECT segment_name FROM r GROUP BY 1 ORDER BY round(avg(frequency * (SELECT average_order_value FROM kp) * 0.80::DOUBLE), 6) DESC, segment_name LIMIT 1) AS top_clv_segment FROM r)"""

_DERIVED = """ch AS (SELECT r.*, CASE WHEN recency > greatest(60, 2 * (SELECT quantile_cont(recency, 0.5) FROM r)) THEN 1 ELSE 0 END AS churned FROM r)"""

# Clusters with fixed labels: customers by market segment.
_BY_MARKET = f"""WITH {RFM_SQL}, p AS (SELECT r.*, c_mktsegment AS cluster FROM r JOIN customer ON c_custkey = customer_id)"""


def _by_market(s, d):
    seg = table(s, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("cluster"))
    return _rfm(s, d).join(seg, "customer_id")


def _clusters(s, d, algorithm):
    return C.cluster_customers(_base(s, d), algorithm).profile


def _quality(s, d):
    return C.cluster_customers(_base(s, d)).quality


def _no_churn():
    from dataclasses import replace
    return replace(TRANSACTIONS, churn=None)


def _insights(s, d):
    kpis = C.business_kpis(transactions(s, d), TRANSACTIONS)
    head, rfm = kpis.first(), _rfm(s, d)
    churn = C.churn_rate(C.churn_labels(rfm, transactions(s, d), _no_churn())).withColumnRenamed("churned_customers", "high_risk_customers")
    return C.business_insights(kpis, C.segment_summary(rfm, head["total_revenue"]), churn, C.lifetime_value(rfm, head["average_order_value"]))


QUERIES = {
    "business_kpis": lambda s, d: C.business_kpis(transactions(s, d), TRANSACTIONS),
    "rfm_base": lambda s, d: C.rfm_base(transactions(s, d), TRANSACTIONS).withColumn("monetary", F.round("monetary", 4)),
    "rfm_scores": lambda s, d: _rfm(s, d).select("customer_id", "r_score", "f_score", "m_score"),
    "rfm_personas": lambda s, d: _rfm(s, d).select("customer_id", "segment_name"),
    "rfm_segment_summary": lambda s, d: C.segment_summary(_rfm(s, d), _head(s, d)["total_revenue"]),
    "segment_distribution": lambda s, d: C.segment_revenue(_rfm(s, d)),
    "segment_points": lambda s, d: C.segment_points(_rfm(s, d)).withColumn("monetary", F.round("monetary", 4)),
    "davies_bouldin": lambda s, d: C.davies_bouldin(_by_market(s, d), "cluster", ["recency", "frequency", "monetary"]),
    "cluster_profile": lambda s, d: C.cluster_profile(_by_market(s, d), "cluster"),
    "kmeans_segments": lambda s, d: _clusters(s, d, "kmeans"),
    "hierarchical_segments": lambda s, d: _clusters(s, d, "hierarchical"),
    "cluster_quality": _quality,
    "churn_explicit": lambda s, d: C.churn_rate(C.churn_labels(_rfm(s, d), transactions(s, d), TRANSACTIONS)),
    "churn_derived": lambda s, d: C.churn_rate(C.churn_labels(_rfm(s, d), transactions(s, d), _no_churn())),
    "churn_model": lambda s, d: C.churn_model(C.churn_labels(_rfm(s, d), transactions(s, d), _no_churn()))[1],
    "clv_summary": lambda s, d: C.lifetime_value(_rfm(s, d), _head(s, d)["average_order_value"]),
    "bi_insights": _insights,
    "daily_revenue": lambda s, d: C.daily_revenue(transactions(s, d), TRANSACTIONS),
    "profit_by_segment": lambda s, d: C.profit_by_segment(_rfm(s, d), transactions(s, d), TRANSACTIONS),
}

ORACLES = {
    "business_kpis": f"WITH {KPI_SQL} SELECT * FROM kp",
    "rfm_base": f"WITH {RFM_SQL} SELECT customer_id, recency, frequency, round(monetary, 4) AS monetary FROM b",
    "rfm_scores": f"WITH {RFM_SQL} SELECT customer_id, r_score, f_score, m_score FROM r",
    "rfm_personas": f"WITH {RFM_SQL} SELECT customer_id, segment_name FROM r",
    "rfm_segment_summary": f"WITH {RFM_SQL}, {KPI_SQL}, {_SEGMENTS} SELECT * FROM sg",
    "segment_distribution": f"WITH {RFM_SQL} SELECT segment_name, count(*) AS customer_count, round(sum(monetary), 2) AS revenue FROM r GROUP BY 1",
    "segment_points": f"WITH {RFM_SQL} SELECT customer_id, recency, round(monetary, 4) AS monetary, frequency, segment_name FROM r",
    "davies_bouldin": f"""{_BY_MARKET},
        ce AS (SELECT cluster, avg(recency) AS cr, avg(frequency) AS cf, avg(monetary) AS cm FROM p GROUP BY 1),
        sp AS (SELECT p.cluster, avg(sqrt((recency - cr) ** 2 + (frequency - cf) ** 2 + (monetary - cm) ** 2)) AS spread, any_value(cr) AS cr, any_value(cf) AS cf, any_value(cm) AS cm
               FROM p JOIN ce ON p.cluster = ce.cluster GROUP BY 1),
        w AS (SELECT x.cluster, max((x.spread + y.spread) / sqrt((x.cr - y.cr) ** 2 + (x.cf - y.cf) ** 2 + (x.cm - y.cm) ** 2)) AS worst FROM sp x JOIN sp y ON x.cluster <> y.cluster GROUP BY 1)
        SELECT CAST(count(*) AS INTEGER) AS clusters, round(avg(worst), 4) AS davies_bouldin FROM w""",
    "cluster_profile": f"""{_BY_MARKET} SELECT cluster, count(*) AS customer_count, round(avg(recency), 1) AS mean_recency, round(avg(frequency), 1) AS mean_frequency,
        round(avg(monetary), 2) AS mean_monetary, round(sum(monetary) * 100.0 / greatest(1.0::DOUBLE, (SELECT sum(monetary) FROM p)), 2) AS revenue_share_pct FROM p GROUP BY 1""",
    "churn_explicit": f"""WITH {RFM_SQL}, f AS (SELECT customer_id, max(churn) AS churned FROM t GROUP BY 1), j AS (SELECT r.customer_id, coalesce(churned, 0) AS churned FROM r LEFT JOIN f ON f.customer_id = r.customer_id)
        SELECT count(*) AS customers, CAST(sum(churned) AS BIGINT) AS churned_customers, round(avg(churned) * 100.0, 2) AS churn_rate_pct FROM j""",
    "churn_derived": f"WITH {RFM_SQL}, {_DERIVED} SELECT count(*) AS customers, CAST(sum(churned) AS BIGINT) AS churned_customers, round(avg(churned) * 100.0, 2) AS churn_rate_pct FROM ch",
    "clv_summary": f"WITH {RFM_SQL}, {KPI_SQL}, {_CLV} SELECT * FROM cl",
    "bi_insights": f"""WITH {RFM_SQL}, {KPI_SQL}, {_SEGMENTS}, {_CLV}, {_DERIVED}, cr AS (SELECT CAST(sum(churned) AS BIGINT) AS hi, round(avg(churned) * 100.0, 2) AS rate FROM ch)
        SELECT 1::INTEGER AS position, 'revenue' AS topic, 'Revenue $' || format('{{:,.2f}}', total_revenue) || ' from ' || format('{{:,}}', total_customers) || ' customers, $' || format('{{:,.2f}}', average_order_value) || ' per order' AS text FROM kp
        UNION ALL SELECT 2, 'champions', 'Champions: ' || customer_count || ' customers with ' || format('{{:,.2f}}', total_revenue_share_pct) || '% of revenue' FROM sg WHERE segment_name = 'Champions'
        UNION ALL SELECT 3, 'at_risk', 'At Risk: ' || customer_count || ' customers with ' || format('{{:,.2f}}', total_revenue_share_pct) || '% of revenue' FROM sg WHERE segment_name = 'At Risk'
        UNION ALL SELECT 4, 'churn', 'Churn rate ' || format('{{:,.2f}}', rate) || '%, ' || hi || ' customers at high risk' FROM cr
        UNION ALL SELECT 5, 'lifetime_value', 'Projected value $' || format('{{:,.2f}}', average_projected_12m_clv) || ' per customer, led by ' || top_clv_segment FROM cl""",
    "daily_revenue": f"""WITH t AS {TRANSACTIONS_SQL}, s AS (SELECT CAST(order_date AS DATE) AS day, sum(revenue) AS rev FROM t GROUP BY 1),
        g AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM s), (SELECT max(day) FROM s), INTERVAL 1 DAY)) AS DATE) AS day)
        SELECT g.day, round(coalesce(rev, 0.0), 2) AS revenue FROM g LEFT JOIN s ON s.day = g.day""",
    "profit_by_segment": f"""WITH {RFM_SQL}, pr AS (SELECT customer_id, sum(profit) AS profit FROM t GROUP BY 1)
        SELECT segment_name, round(sum(coalesce(profit, 0.0)), 2) AS profit FROM r LEFT JOIN pr ON pr.customer_id = r.customer_id GROUP BY 1""",
}
