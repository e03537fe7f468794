"""Tables from files, databases and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ref

# The delimiters that are tried, in this order.
DELIMITERS = (",", ";", "\t", "|")
BROKEN = "_broken_line"


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of most lines: the one whose most frequent number of fields, above one, covers most lines of the text.

    Among equals the one with more fields wins, then the order of DELIMITERS. All lines are counted, in one aggregate
    that keeps a row per number of fields.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.regexp_replace("value", '"[^"]*"', "").alias("line"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.length("line") - F.length(F.replace("line", F.lit(sep), F.lit("")))).alias("cuts")) for i, sep in enumerate(DELIMITERS)]))
    counts = lines.select(each.alias("x")).groupBy("x.i", "x.cuts").agg(F.count(F.lit(1)).alias("n"))
    best = counts.select(F.max(F.struct(F.when(F.col("cuts") > 0, F.col("n")).otherwise(0).alias("n"), "cuts", (-F.col("i")).alias("i")))).first()[0]
    if best is None:
        raise ValueError(f"{path} is empty")
    return DELIMITERS[-best["i"]] if best["n"] else DELIMITERS[0]


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless a line of the file is not valid UTF-8; then Latin-1, which reads any bytes."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if broken else "UTF-8"


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, schema: T.StructType | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header. Lines with too many fields are skipped, short lines are padded with nulls.

    Give a schema to spare the inference scan on large inputs.
    """
    sep = sep or detect_delimiter(spark, path)
    encoding = encoding or detect_encoding(spark, path)
    base = {"header": True, "sep": sep, "encoding": encoding, "multiLine": multiline}
    if schema is None:
        schema = spark.read.options(**base, inferSchema=True, enforceSchema=True).csv(path).schema
    width = len(schema.fields)
    marked = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    # Without column pruning in the parser, a line counts as broken whichever columns a query asks for.
    options = {**base, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "columnPruning": False}
    rows = spark.read.options(**options).schema(marked).csv(path)
    # A broken line is kept when it is only short; its fields are counted outside of quotes. The empty piece of
    # the first column keeps a data column in every query, which Spark demands beside the broken-line column.
    nothing = F.coalesce(F.substring(ref(schema.fields[0].name).cast("string"), 1, 0), F.lit(""))
    line = F.concat(F.regexp_replace(BROKEN, '"[^"]*"', ""), nothing)
    fields = F.size(F.split(line, "\\Q" + sep + "\\E", -1))
    kept = rows.where(F.when(line.isNotNull(), fields <= width).otherwise(True))
    return kept.select(*[ref(f.name) for f in schema.fields])


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Format by extension; anything unknown is tried as CSV."""
    low = path.rstrip("/").lower()
    for suffix, name in ((".parquet", "parquet"), (".json", "json"), (".jsonl", "json"), (".orc", "orc")):
        if low.endswith(suffix):
            return spark.read.options(**options).format(name).load(path)
    if low.endswith((".xlsx", ".xls")):
        raise ValueError("convert workbooks to CSV or parquet first")
    return read_csv(spark, path, **options)


def read_records(spark: SparkSession, records: list[dict], schema: T.StructType | str | None = None) -> DataFrame:
    if not records and schema is None:
        raise ValueError("no records and no schema")
    return spark.createDataFrame(records, schema) if schema else spark.createDataFrame(records)


def database_options(url: str, query_or_table: str, partition_column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int | None = None, **more: str) -> dict[str, str]:
    """JDBC options: a text that starts with "select" is a query, anything else a table name.

    A partition column with bounds lets the executors read slices in parallel.
    """
    text = query_or_table.strip().rstrip(";")
    is_query = text.lower().startswith("select")
    out = {"url": url, "dbtable": f"({text}) q" if is_query else text, **more}
    if partition_column:
        if lower is None or upper is None or not partitions:
            raise ValueError("a partition column needs lower, upper and partitions")
        out.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions))
    return out


def read_database(spark: SparkSession, url: str, query_or_table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**database_options(url, query_or_table, **options)).load()


def preview(df: DataFrame, rows: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first rows; with a key the same ones every time (a bounded top-k, no full sort)."""
    return (df.orderBy(*[ref(c) for c in order_by]) if order_by else df).limit(rows)


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "position int, column_name string, data_type string")
