"""Column kinds: which columns of a table are numbers, dates or categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERICAL, DATETIME, CATEGORICAL, IDENTIFIER = "numerical", "datetime", "categorical", "id"

ISO_SHARE = 0.8

# Name fragments that mark an identifier column.
ID_NAME_PARTS = ("id", "uuid", "guid", "code", "index", "key")


def ref(name: str) -> Column:
    """Column by exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_moment(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def as_number(df: DataFrame, name: str) -> Column:
    """Numeric view of a column; booleans count as 0 / 1, text that does not parse is null."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        return ref(name).cast("int").cast("double")
    if isinstance(dtype, T.NumericType):
        return ref(name).cast("double")
    return ref(name).try_cast("double")


def as_moment(df: DataFrame, name: str) -> Column:
    """timestamp_ntz view of a column; text that does not parse is null."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return ref(name)
    if is_moment(dtype):
        return ref(name).cast("timestamp_ntz")
    return F.try_to_timestamp(ref(name).cast("string")).cast("timestamp_ntz")


def plain(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that every column can be grouped and compared."""
    out = []
    for f in df.schema.fields:
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        out.append((F.to_json(ref(f.name)) if nested else ref(f.name)).alias(f.name))
    return df.select(*out)


def iso_text_columns(df: DataFrame, names: list[str] | None = None) -> set[str]:
    """Text columns that read as ISO dates: more than 80 % of all their non-null values, counted in one aggregate."""
    if names is None:
        names = [f.name for f in df.schema.fields if is_text(f.dataType)]
    if not names:
        return set()
    parsed = [F.avg(F.when(ref(n).isNotNull(), F.try_to_timestamp(ref(n)).isNotNull().cast("int"))).alias(f"c{i}") for i, n in enumerate(names)]
    row = df.agg(*parsed).first()
    return {n for i, n in enumerate(names) if row[f"c{i}"] is not None and row[f"c{i}"] > ISO_SHARE}


def column_kinds(df: DataFrame, look_into_text: bool = True) -> dict[str, str]:
    """Kind of every column in table order."""
    iso = iso_text_columns(df) if look_into_text else set()
    kinds = {}
    for f in df.schema.fields:
        if is_number(f.dataType):
            kinds[f.name] = NUMERICAL
        elif is_moment(f.dataType) or f.name in iso:
            kinds[f.name] = DATETIME
        else:
            kinds[f.name] = CATEGORICAL
    return kinds


def has_id_name(name: str) -> bool:
    low = name.lower()
    return any(part in low for part in ID_NAME_PARTS)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def rows_table(df: DataFrame, entries: list, keep: tuple[str, ...] = ()) -> DataFrame:
    """One output row per struct in ``entries``: a wide one-row aggregate turned into a tidy table."""
    return df.select(*keep, F.inline(F.array(*entries)))


def literal_rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small fitted result as a table."""
    return spark.createDataFrame(rows, schema)
