"""Customer analytics: KPIs, recency / frequency / monetary segments, clusters, churn and lifetime value."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_moment, as_number, literal_rows, ref
from ..functions.durable import durable
from ..functions.joins import FEW_ROWS, join_few
from ..functions.layout import compact
from ..functions.quantiles import medians, quantiles
from ..functions.ranking import ONE_TASK_ROWS, positions
from ..functions.ward import ward_labels

# Accepted column names per role, most specific first.
COLUMN_ALIASES = {
    "customer_id": ("customer_id", "customer", "client_id", "user_id", "customer_name", "account_id", "cust_id"),
    "order_date": ("order_date", "date", "transaction_date", "timestamp", "created_at", "invoice_date"),
    "revenue": ("revenue", "sales", "amount", "total_price", "order_value", "monetary", "total_amount", "price"),
    "profit": ("profit", "margin", "net_profit", "gain"),
    "quantity": ("quantity", "qty", "units", "items_count"),
    "churn": ("churn", "churned", "is_churn", "is_churned"),
}

DEFAULT_RECENCY = 30
RETENTION = 0.80
MIN_CHURN_DAYS = 60
QUINTILES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


@dataclass(frozen=True)
class ColumnMapping:
    customer_id: str | None = None
    order_date: str | None = None
    revenue: str | None = None
    profit: str | None = None
    quantity: str | None = None
    churn: str | None = None


def resolve_mapping(columns: list[str], given: ColumnMapping | None = None) -> ColumnMapping:
    """Given names win when they exist; other roles take the first alias met, exactly or inside a name."""
    lower: dict[str, str] = {c.lower(): c for c in columns}
    chosen = ColumnMapping()
    for f in fields(ColumnMapping):
        manual = getattr(given, f.name) if given else None
        pick = manual if manual in columns else None
        for alias in COLUMN_ALIASES[f.name] if pick is None else ():
            pick = lower.get(alias) or next((c for low, c in lower.items() if alias in low), None)
            if pick:
                break
        chosen = replace(chosen, **{f.name: pick})
    return chosen


def business_kpis(df: DataFrame, mapping: ColumnMapping) -> DataFrame:
    """One row of headline figures. Orders per customer are pre-aggregated; everything sums up from there."""
    revenue = as_number(df, mapping.revenue) if mapping.revenue else F.lit(0.0)
    profit = as_number(df, mapping.profit) if mapping.profit else F.lit(None).cast("double")
    cells = df.select(
        (ref(mapping.customer_id) if mapping.customer_id else F.lit(None).cast("string")).alias("cust"),
        revenue.alias("rev"), profit.alias("prof"),
    )
    if mapping.customer_id:
        per = cells.groupBy("cust").agg(F.count(F.lit(1)).alias("n"), F.sum("rev").alias("rev"), F.sum("prof").alias("prof"))
        known = F.col("cust").isNotNull()
        total = per.agg(
            F.sum("n").alias("rows"), F.sum("rev").alias("rev"), F.sum("prof").alias("prof"),
            F.count_if(known).alias("customers"), F.count_if(known & (F.col("n") > 1)).alias("repeating"),
        )
    else:
        total = cells.agg(
            F.count(F.lit(1)).alias("rows"), F.sum("rev").alias("rev"), F.sum("prof").alias("prof"),
            F.count(F.lit(1)).alias("customers"), F.lit(0).cast("long").alias("repeating"),
        )
    rev = F.coalesce("rev", F.lit(0.0))
    prof = F.coalesce("prof", F.lit(0.0)) if mapping.profit else F.col("prof")
    return total.select(
        F.round(rev, 2).alias("total_revenue"),
        F.round(prof, 2).alias("total_profit"),
        F.round(rev / F.greatest(F.lit(1), F.coalesce("rows", F.lit(0))), 2).alias("average_order_value"),
        F.col("customers").alias("total_customers"),
        F.round(F.col("repeating") * 100.0 / F.greatest(F.lit(1), F.col("customers")), 2).alias("repeat_purchase_rate"),
        F.when(rev > 0, F.round(F.try_divide(prof * 100.0, rev), 2)).alias("profit_margin_pct"),
    )


def rfm_base(df: DataFrame, mapping: ColumnMapping) -> DataFrame:
    """One row per customer: recency (whole elapsed days before the last date), frequency, monetary.

    The monetary sum is kept to 6 decimals so that a recomputed partition yields the same value.
    """
    cust = ref(mapping.customer_id)
    revenue = F.coalesce(as_number(df, mapping.revenue), F.lit(0.0)) if mapping.revenue else F.lit(1.0)
    when = as_moment(df, mapping.order_date) if mapping.order_date else F.lit(None).cast("timestamp_ntz")
    cells = df.select(cust.alias("customer_id"), when.alias("ts"), revenue.alias("revenue"))
    last = cells.agg(F.max("ts")).first()[0] if mapping.order_date else None
    grouped = cells.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("frequency"), F.round(F.sum("revenue"), 6).alias("total"),
    )
    if mapping.order_date and last is not None:
        recency = F.floor(F.timestamp_diff("SECOND", F.col("last_ts"), F.lit(last).cast("timestamp_ntz")) / 86400)
    elif mapping.order_date:
        recency = F.lit(None)
    else:
        recency = F.lit(DEFAULT_RECENCY)
    return grouped.select(
        "customer_id",
        F.when(recency.isNotNull(), F.greatest(recency, F.lit(0))).cast("long").alias("recency"),
        F.greatest(F.col("frequency"), F.lit(1)).cast("long").alias("frequency"),
        F.greatest(F.col("total"), F.lit(0.01)).alias("monetary"),
    )


def _edge_score(value: Column, edges: list[float | None], descending: bool) -> Column:
    """Quintile score; when neighbouring edges coincide every customer gets the middle score."""
    if any(e is None for e in edges) or len(set(edges)) < len(edges):
        return F.lit(3)
    above = F.lit(0)
    for e in edges[1:-1]:
        above = above + (value > F.lit(float(e))).cast("int")
    return 5 - above if descending else 1 + above


def rfm_scores(base: DataFrame, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Adds r_score, f_score, m_score (1-5). ``base`` should be persisted: it is read by the fit and by the result."""
    size = base.agg(F.count(F.lit(1)).alias("n"), F.count("recency").alias("dated"), F.count("monetary").alias("paid")).first()
    n = size["n"]
    edges = quantiles(
        base, {"recency": F.col("recency"), "monetary": F.col("monetary")}, QUINTILES,
        counts={"recency": size["dated"], "monetary": size["paid"]},
    )
    r_edges = edges["recency"] if size["dated"] == n else [None]
    ranked = positions(base, ["frequency", "customer_id"], "_at", n, one_task_rows)
    f_score = F.lit(1)
    for k in range(1, 5):
        f_score = f_score + (F.col("_at") * 5 > F.lit((n - 1) * k)).cast("int")
    return ranked.select(
        *base.columns,
        _edge_score(F.col("recency"), r_edges, True).cast("int").alias("r_score"),
        (f_score if n > 1 else F.lit(3)).cast("int").alias("f_score"),
        _edge_score(F.col("monetary"), edges["monetary"], False).cast("int").alias("m_score"),
    )


def persona(r: Column, f: Column, m: Column) -> Column:
    """Fixed rule table, first match wins."""
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((f >= 4) & (m >= 3), "Loyal Customers")
        .when((r >= 3) & (f >= 2) & (m >= 2), "Potential Loyalists")
        .when((r <= 2) & (f >= 3) & (m >= 3), "At Risk")
        .when((r <= 2) & (f <= 2) & (m <= 2), "Hibernating")
        .when((r == 1) & (f == 1), "Lost")
        .otherwise("Promising")
    )


def rfm_table(df: DataFrame, mapping: ColumnMapping, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Scored customers with their persona; the customer-level base is persisted."""
    base = rfm_base(df, mapping).persist(StorageLevel.MEMORY_AND_DISK)
    return rfm_scores(base, one_task_rows).withColumn("segment_name", persona(F.col("r_score"), F.col("f_score"), F.col("m_score")))


def segment_summary(rfm: DataFrame, total_revenue: float) -> DataFrame:
    """Persona sizes, means and revenue share (largest share first)."""
    total = max(1.0, float(total_revenue or 0.0))
    return rfm.groupBy("segment_name").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.round(F.avg("recency"), 1).alias("avg_recency_days"),
        F.round(F.avg("frequency"), 1).alias("avg_frequency"),
        F.round(F.avg("monetary"), 2).alias("avg_monetary_value"),
        F.round(F.sum("monetary") * 100.0 / F.lit(total), 2).alias("total_revenue_share_pct"),
    ).orderBy(F.desc("total_revenue_share_pct"), "segment_name")


def segment_revenue(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("segment_name").agg(
        F.count(F.lit(1)).alias("customer_count"), F.round(F.sum("monetary"), 2).alias("revenue"),
    )


def segment_points(rfm: DataFrame, share: float = 1.0) -> DataFrame:
    """(customer, recency, monetary, frequency, persona) for a scatter; ``share`` < 1 thins by key hash."""
    out = rfm.select("customer_id", "recency", "monetary", "frequency", "segment_name")
    if share >= 1.0:
        return out
    return out.where(F.pmod(F.xxhash64("customer_id"), F.lit(1_000_000)) < int(share * 1_000_000))


# --- clusters -------------------------------------------------------------------------------------------

def _scaled(rfm: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    from pyspark.ml.feature import VectorAssembler

    row = rfm.agg(*[F.avg(c).alias(f"{c}_m") for c in cols], *[F.stddev_pop(c).alias(f"{c}_s") for c in cols]).first()
    z = rfm
    for c in cols:
        std = row[f"{c}_s"] or 1.0
        z = z.withColumn(f"_z_{c}", (F.col(c) - F.lit(row[f"{c}_m"])) / F.lit(std))
    return VectorAssembler(inputCols=[f"_z_{c}" for c in cols], outputCol="features").transform(z), row


def davies_bouldin(points: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Davies-Bouldin index from centroids and mean distances.

    Rows stay where they are while there are few clusters; the pairs of clusters are rows of their own, dealt by the
    one of the two whose worst neighbour is looked for.
    """
    centres = durable(points.groupBy(label).agg(F.array(*[F.avg(f) for f in features]).alias("_centre")))
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    spreads = join_few(points.select(label, F.array(*[F.col(f).cast("double") for f in features]).alias("_x")), centres, label).groupBy(label).agg(F.avg(gap(F.col("_x"), F.col("_centre"))).alias("spread"))
    stats = durable(spreads.join(centres, label).select(F.col(label).alias("c"), "spread", F.col("_centre").alias("centre")))
    few = stats.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    a, b = stats.alias("a"), (F.broadcast(stats) if few else stats).alias("b")
    pairs = a.join(b, F.col("a.c") != F.col("b.c"), "left")
    ratio = F.try_divide(F.col("a.spread") + F.col("b.spread"), gap(F.col("a.centre"), F.col("b.centre")))
    worst = pairs.groupBy("a.c").agg(F.coalesce(F.max(ratio), F.lit(0.0)).alias("worst"))
    return worst.agg(F.count(F.lit(1)).cast("int").alias("clusters"), F.round(F.coalesce(F.avg("worst"), F.lit(0.0)), 4).alias("davies_bouldin"))


def cluster_profile(points: DataFrame, label: str, total: float | None = None) -> DataFrame:
    """Size, mean recency / frequency / monetary and revenue share of each cluster."""
    if total is None:
        total = points.agg(F.sum("monetary")).first()[0] or 0.0
    return points.groupBy(label).agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.round(F.avg("recency"), 1).alias("mean_recency"),
        F.round(F.avg("frequency"), 1).alias("mean_frequency"),
        F.round(F.avg("monetary"), 2).alias("mean_monetary"),
        F.round(F.sum("monetary") * 100.0 / F.lit(max(1.0, float(total))), 2).alias("revenue_share_pct"),
    )


@dataclass
class Clusters:
    assigned: DataFrame
    quality: DataFrame
    profile: DataFrame
    k: int


def cluster_customers(rfm: DataFrame, algorithm: str = "kmeans", seed: int = 42) -> Clusters:
    """Clusters on standardised recency, frequency, monetary; k from 2 to 6 by best silhouette.

    The hierarchy is Ward's, over clustering features of the rows: exact up to 4,000 different customers, over cells of
    the documented width beyond.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    cols = ["recency", "frequency", "monetary"]
    features, _ = _scaled(rfm, cols)
    n = rfm.count()
    features = compact(features, n).persist(StorageLevel.MEMORY_AND_DISK)
    spark = rfm.sparkSession
    title = "K-Means" if algorithm == "kmeans" else "Hierarchical Ward"
    schema = "algorithm string, optimal_k int, silhouette double, davies_bouldin double"
    if min(6, n - 1) < 2:
        assigned = features.withColumn("cluster", F.lit(0))
        return Clusters(assigned.drop("features"), literal_rows(spark, [(title, 1, 1.0, 0.0)], schema), cluster_profile(assigned, "cluster"), 1)

    candidates = {}
    ks = list(range(2, min(6, n - 1) + 1))
    if algorithm == "hierarchical":
        labelled, _ = ward_labels(features, [f"_z_{c}" for c in cols], ks)
        labelled = durable(labelled)
        candidates = {k: labelled.withColumn("cluster", F.col("_labels")[i]).drop("_labels") for i, k in enumerate(ks)}
    for k in ks if algorithm != "hierarchical" else []:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(features)
        candidates[k] = model.transform(features)

    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    best_k, best = ks[0], -2.0
    for k, labelled in candidates.items():
        score = judge.evaluate(labelled) if labelled.select("cluster").distinct().limit(2).count() > 1 else -1.0
        if score > best:
            best_k, best = k, score
    chosen = candidates[best_k]
    db = davies_bouldin(chosen, "cluster", [f"_z_{c}" for c in cols]).first()["davies_bouldin"]
    quality = literal_rows(spark, [(title, best_k, round(float(best), 4), float(db))], schema)
    plain = chosen.drop("features", *[f"_z_{c}" for c in cols])
    return Clusters(plain, quality, cluster_profile(plain, "cluster"), best_k)


# --- churn and lifetime value ---------------------------------------------------------------------------

def churn_labels(rfm: DataFrame, df: DataFrame, mapping: ColumnMapping) -> DataFrame:
    """Adds ``churned`` 0/1: the largest flag of the customer, or inactivity beyond max(60, 2 x median recency)."""
    if mapping.churn:
        flags = df.select(ref(mapping.customer_id).alias("customer_id"), as_number(df, mapping.churn).cast("int").alias("flag"))
        per = flags.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.max("flag").alias("churned"))
        return rfm.join(per, "customer_id", "left").withColumn("churned", F.coalesce("churned", F.lit(0)).cast("int"))
    middle = medians(rfm, {"recency": F.col("recency")})["recency"]
    limit = max(MIN_CHURN_DAYS, 2 * (middle or 0.0))
    return rfm.withColumn("churned", F.coalesce((F.col("recency") > F.lit(float(limit))).cast("int"), F.lit(0)))


def churn_rate(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("churned"), F.lit(0)).cast("long").alias("churned_customers"),
        F.coalesce(F.round(F.avg("churned") * 100.0, 2), F.lit(0.0)).alias("churn_rate_pct"),
    )


HIGH_RISK = 0.70


def churn_model(labelled: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Scored customers (``churn_probability``) and a one-row summary with driver importances."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark = labelled.sparkSession
    size = labelled.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("churned") == 1).alias("pos"), F.countDistinct("churned").alias("classes")).first()
    schema = "churn_rate_pct double, high_risk_customers long, recency_importance double, frequency_importance double, monetary_importance double"
    rate = round(100.0 * size["pos"] / max(1, size["n"]), 2)
    if size["classes"] < 2 or size["n"] < 10:
        scored = labelled.withColumn("churn_probability", F.col("churned").cast("double"))
        return scored, literal_rows(spark, [(rate, size["pos"], 1.0, 0.0, 0.0)], schema)
    cols = ["recency", "frequency", "monetary"]
    filled = labelled.na.fill(0, cols)
    vectors = VectorAssembler(inputCols=cols, outputCol="features").transform(filled).persist(StorageLevel.MEMORY_AND_DISK)
    forest = RandomForestClassifier(numTrees=50, maxDepth=4, seed=seed, labelCol="churned", featuresCol="features").fit(vectors)
    scored = forest.transform(vectors).withColumn("churn_probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    high = scored.agg(F.count_if(F.col("churn_probability") >= HIGH_RISK)).first()[0]
    imp = [round(float(v), 4) for v in forest.featureImportances.toArray()]
    return scored, literal_rows(spark, [(rate, high, *imp)], schema)


def lifetime_value(rfm: DataFrame, average_order_value: float) -> DataFrame:
    """One row: mean monetary, mean projected value (frequency x order value x 0.80), strongest persona."""
    projected = F.col("frequency") * F.lit(float(average_order_value)) * F.lit(RETENTION)
    per = rfm.groupBy("segment_name").agg(
        F.sum("monetary").alias("m"), F.sum(projected).alias("p"), F.count(F.lit(1)).alias("n"), F.avg(projected).alias("mean_p"),
    )
    return per.agg(
        F.round(F.sum("m") / F.sum("n"), 2).alias("average_historical_clv"),
        F.round(F.sum("p") / F.sum("n"), 2).alias("average_projected_12m_clv"),
        F.min_by("segment_name", F.struct((-F.round("mean_p", 6)).alias("a"), F.col("segment_name").alias("b"))).alias("top_clv_segment"),
    )


# --- series and insights --------------------------------------------------------------------------------

def daily_revenue(df: DataFrame, mapping: ColumnMapping) -> DataFrame:
    """Revenue per day from the first to the last day; days without orders are 0."""
    cells = df.select(as_moment(df, mapping.order_date).cast("date").alias("day"), as_number(df, mapping.revenue).alias("rev"))
    sums = cells.where(F.col("day").isNotNull()).groupBy("day").agg(F.sum("rev").alias("rev"))
    span = sums.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return grid.join(sums, "day", "left").select("day", F.round(F.coalesce("rev", F.lit(0.0)), 2).alias("revenue"))


def profit_by_segment(rfm: DataFrame, df: DataFrame, mapping: ColumnMapping) -> DataFrame:
    profit = df.select(ref(mapping.customer_id).alias("customer_id"), as_number(df, mapping.profit).alias("profit"))
    per = profit.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.sum("profit").alias("profit"))
    return (
        rfm.select("customer_id", "segment_name").join(per, "customer_id", "left")
        .groupBy("segment_name").agg(F.round(F.sum(F.coalesce("profit", F.lit(0.0))), 2).alias("profit"))
    )


def business_insights(kpis: DataFrame, segments: DataFrame | None, churn: DataFrame | None, clv: DataFrame | None) -> DataFrame:
    """(position, topic, text) rows out of the summary tables."""
    def money(c):
        return F.concat(F.lit("$"), F.format_number(c, 2))
    out = kpis.select(F.lit(1).alias("position"), F.lit("revenue").alias("topic"), F.concat(
        F.lit("Revenue "), money("total_revenue"), F.lit(" from "), F.format_number("total_customers", 0),
        F.lit(" customers, "), money("average_order_value"), F.lit(" per order")).alias("text"))
    if segments is not None:
        for pos, name in ((2, "Champions"), (3, "At Risk")):
            out = out.unionByName(segments.where(F.col("segment_name") == name).select(
                F.lit(pos).alias("position"), F.lit(name.lower().replace(" ", "_")).alias("topic"),
                F.concat(F.lit(f"{name}: "), F.col("customer_count").cast("string"), F.lit(" customers with "),
                         F.format_number("total_revenue_share_pct", 2), F.lit("% of revenue")).alias("text")))
    if churn is not None:
        out = out.unionByName(churn.select(F.lit(4).alias("position"), F.lit("churn").alias("topic"), F.concat(
            F.lit("Churn rate "), F.format_number("churn_rate_pct", 2), F.lit("%, "),
            F.col("high_risk_customers").cast("string"), F.lit(" customers at high risk")).alias("text")))
    if clv is not None:
        out = out.unionByName(clv.select(F.lit(5).alias("position"), F.lit("lifetime_value").alias("topic"), F.concat(
            F.lit("Projected value "), money("average_projected_12m_clv"), F.lit(" per customer, led by "), F.col("top_clv_segment")).alias("text")))
    return out


def analyse_customers(df: DataFrame, mapping: ColumnMapping | None = None, algorithm: str = "kmeans") -> dict[str, DataFrame]:
    """Every customer table that the available columns allow."""
    if df.isEmpty():
        raise ValueError("the table has no rows")
    mapping = resolve_mapping(df.columns, mapping)
    kpis = business_kpis(df, mapping)
    out = {"kpis": kpis}
    segments = churn = clv = None
    if mapping.customer_id:
        head = kpis.first()
        rfm = rfm_table(df, mapping).persist(StorageLevel.MEMORY_AND_DISK)
        if not rfm.isEmpty():
            segments = segment_summary(rfm, head["total_revenue"])
            clusters = cluster_customers(rfm, algorithm)
            scored, churn = churn_model(churn_labels(rfm, df, mapping))
            clv = lifetime_value(rfm, head["average_order_value"])
            out.update(rfm=rfm, segments=segments, clusters=clusters.assigned, cluster_quality=clusters.quality,
                       cluster_profile=clusters.profile, churn_scores=scored, churn=churn, clv=clv, segment_revenue=segment_revenue(rfm))
            if mapping.profit:
                out["profit_by_segment"] = profit_by_segment(rfm, df, mapping)
    if mapping.order_date and mapping.revenue:
        out["daily_revenue"] = daily_revenue(df, mapping)
    out["insights"] = business_insights(kpis, segments, churn, clv)
    return out
