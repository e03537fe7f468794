"""Report history, dataset catalogue and exports, kept as append-only parquet tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import literal_rows
from ..operators.profile import cell_summary, quality_score

HISTORY_SCHEMA = "run_id string, dataset_id string, summary string, report string, created_at timestamp, module string"
CATALOGUE_SCHEMA = "dataset_id string, name string, file_type string, row_count long, column_count int, quality_score double, created_at timestamp"


def latest_per_key(df: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """The newest row of each key. ``max_by`` keeps one row per key on the map side; no key is ever sorted."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("_r"))
    return last.select(*key, "_r.*")


class ReportHistory:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, folder.rstrip("/") + "/reports"

    def append(self, module: str, run_id: str, dataset_id: str, report: DataFrame, summary: DataFrame | None = None, created_at: datetime | None = None) -> None:
        """Stores a small report table as JSON under its module."""
        def packed(t):
            return t.agg(F.to_json(F.collect_list(F.struct(*t.columns)))).first()[0]
        row = (run_id, dataset_id, packed(summary) if summary is not None else None, packed(report), created_at or datetime.now(), module)
        self.spark.createDataFrame([row], HISTORY_SCHEMA).coalesce(1).write.mode("append").partitionBy("module").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(HISTORY_SCHEMA).parquet(self.path)

    def by_id(self, module: str, run_id: str) -> DataFrame:
        return self.table().where((F.col("module") == module) & (F.col("run_id") == run_id))

    def latest(self, module: str) -> DataFrame:
        return latest_per_key(self.table().where(F.col("module") == module), ["dataset_id"], ["created_at", "run_id"])


class Catalogue:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, folder.rstrip("/") + "/catalogue"

    def register(self, dataset_id: str, name: str, file_type: str, df: DataFrame, created_at: datetime | None = None) -> None:
        cells, score = cell_summary(df).first(), quality_score(df).first()
        row = (dataset_id, name, file_type, cells["row_count"], cells["column_count"], score["quality_score"], created_at or datetime.now())
        self.spark.createDataFrame([row], CATALOGUE_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def list(self) -> DataFrame:
        """Datasets, newest first."""
        return self.spark.read.schema(CATALOGUE_SCHEMA).parquet(self.path).orderBy(F.desc("created_at"), "dataset_id")


def catalogue_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column counts of several tables."""
    parts = [t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("name"), "row_count", F.lit(len(t.columns)).alias("column_count")) for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def export_csv(items: DataFrame, path: str) -> None:
    """A small result (recommendations) as one CSV file with a header."""
    items.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
