"""Moment and correlation expressions that match the usual sample statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; 0 for fewer than three values or a constant."""
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return F.coalesce(F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)), F.lit(0.0))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for fewer than four values or a constant."""
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.coalesce(F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are present; null when either does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def round4(c: Column) -> Column:
    return F.round(c, 4)


FEW_PAIRS = 15
#: Pairs of one pass: the generated code of many more is too long to be compiled, and rows then take several times as long.
PASS_PAIRS = 10


def pair_correlations(df, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson value of every column pair (in list order) over the rows where both are present.

    A few pairs are plain aggregates, PASS_PAIRS of them a pass. For more, one Gram matrix of (present, value, value squared) per column
    holds all the pairwise sums; it comes from the JVM covariance job, which adds up one small matrix per
    partition in a tree, so neither rows nor pairs are shuffled.
    """
    from itertools import combinations

    from .columns import as_number

    pairs = list(combinations(columns, 2))
    if not pairs:
        return {}
    if len(pairs) <= FEW_PAIRS:
        out = {}
        for at in range(0, len(pairs), PASS_PAIRS):
            some = pairs[at : at + PASS_PAIRS]
            row = df.agg(*[pearson(as_number(df, a), as_number(df, b)).alias(f"p{i}") for i, (a, b) in enumerate(some)]).first()
            out.update({p: row[i] for i, p in enumerate(some)})
        return out
    return _gram_correlations(df, columns, pairs)


def _gram_correlations(df, columns, pairs):
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation, Summarizer

    from .columns import as_number

    views = [as_number(df, c) for c in columns]
    fit = df.agg(*[F.struct(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(f"s{i}") for i, x in enumerate(views)]).first()
    k = len(columns)
    present, value, square = [], [], []
    for i, x in enumerate(views):
        z = (x - F.lit(fit[i]["m"] or 0.0)) / F.lit(fit[i]["s"] or 1.0)
        present.append(x.isNotNull().cast("double").alias(f"m{i}"))
        value.append(F.coalesce(z, F.lit(0.0)).alias(f"x{i}"))
        square.append(F.coalesce(z * z, F.lit(0.0)).alias(f"q{i}"))
    cells = df.select(*present, *value, *square)
    vectors = VectorAssembler(inputCols=cells.columns, outputCol="v").transform(cells).select("v")
    head = vectors.select(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")).select("s.count", "s.mean", "s.variance").first()
    n = head[0]
    if n < 2:
        return {p: None for p in pairs}
    mean, sd = head[1].toArray(), np.sqrt(head[2].toArray())
    corr = np.nan_to_num(np.array(Correlation.corr(vectors, "v").first()[0].toArray()))
    gram = (n - 1) * corr * np.outer(sd, sd) + n * np.outer(mean, mean)
    np.fill_diagonal(gram, (n - 1) * sd**2 + n * mean**2)
    at = {c: i for i, c in enumerate(columns)}
    out = {}
    for a, b in pairs:
        i, j = at[a], at[b]
        both = gram[i, j]
        sx, sy = gram[k + i, j], gram[k + j, i]
        sxx, syy, sxy = gram[2 * k + i, j], gram[2 * k + j, i], gram[k + i, k + j]
        vx, vy = both * sxx - sx * sx, both * syy - sy * sy
        varies = both > 1.5 and vx > 1e-9 * both * both and vy > 1e-9 * both * both and fit[i]["s"] and fit[j]["s"]
        out[(a, b)] = float(np.clip((both * sxy - sx * sy) / np.sqrt(vx * vy), -1.0, 1.0)) if varies else None
    return out
