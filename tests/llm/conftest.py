import pytest
from edge_cases import CLASH, EDGE

@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string").repartition(3)
    df = df.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (4, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
