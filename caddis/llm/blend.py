"""One ranking from several differently scaled scores: the first principal component of rank-transformed scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caddis.operators.ranks import positions, value_ranks
from caddis.session import cut


def first_component(correlation: np.ndarray) -> np.ndarray:
    """Unit loadings of the first principal component, oriented so that their sum is positive."""
    _, vectors = np.linalg.eigh(correlation)
    loadings = vectors[:, -1]
    return loadings if loadings.sum() >= 0 else -loadings


def blended_ranking(df: DataFrame, key: str, scores: dict[str, int]) -> tuple[DataFrame, dict[str, float]]:
    """(df[key, *scores] with projection and position, loadings by score).

    ``scores`` names each score column and its direction: 1 where more is better, -1 where less is. Each score is
    replaced by its average rank over all rows that have it, as a fraction, centred and scaled to unit variance, so only
    its order counts and no score weighs by its range or its tail. The correlation matrix is one aggregate over all
    rows, each entry from the rows that have both scores; only this small matrix reaches the driver. Its first
    principal component, after each score is turned to its declared direction and the component's sign is chosen so
    that the loadings sum to a positive number, projects the rows; position 1 is the greatest projection, ties in order
    of the key. A missing score (null or NaN) counts as the average of its ranks (0), so it neither lifts nor sinks a
    row; a row without any score has a null projection and comes last. A score that is constant or wholly missing gets
    a correlation of 0 with the others and contributes nothing. Rows with a repeated or null key are ranked row by row.
    An empty table gives no rows. Other columns are ignored.
    """
    names = list(scores)
    columns = [f"_s{i}" for i in range(len(names))]
    rows = cut(df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(s) for s, c in zip(columns, names)]))
    ranks = cut(value_ranks(rows, columns))
    sums = {r[0]: r[1:] for r in ranks.groupBy("column").agg(F.sum("count"), F.sum(F.col("count") * F.col("rank")), F.sum(F.col("count") * F.col("rank") * F.col("rank"))).collect()}
    moments = []
    for i, s in enumerate(columns):
        n, first, second = sums.get(s, (0, 0.0, 0.0))
        mean = first / n if n else 0.0
        spread = max(second / n - mean * mean, 0.0) ** 0.5 if n else 0.0
        moments.append(spread)
        z = ((F.col("rank") - F.lit(mean)) / F.lit(spread) * F.lit(float(scores[names[i]]))) if spread > 0 else F.lit(0.0)
        rows = rows.join(ranks.where(F.col("column") == s).select(F.col("value").alias(s), z.alias(f"_z{i}")), s, "left")
    rows = cut(rows)
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    sums = []
    for i, j in pairs:
        x, y = (F.when(F.col(f"_z{i}").isNotNull() & F.col(f"_z{j}").isNotNull(), F.col(f"_z{k}")) for k in (i, j))
        sums += [F.count(x), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)]
    entries = [v or 0 for v in rows.agg(*sums).head()] if pairs else []
    correlation = np.diag([1.0 if moments[i] > 0 else 0.0 for i in range(len(names))])
    for at, (i, j) in enumerate(pairs):
        n, sx, sy, xx, yy, xy = entries[6 * at : 6 * at + 6]
        spread = (max(n * xx - sx * sx, 0.0) * max(n * yy - sy * sy, 0.0)) ** 0.5
        correlation[i, j] = correlation[j, i] = (n * xy - sx * sy) / spread if spread > 1e-9 else 0.0
    loadings = first_component(correlation)
    some = F.coalesce(*[F.col(f"_z{i}") for i in range(len(names))]).isNotNull()
    projection = sum((F.coalesce(F.col(f"_z{i}"), F.lit(0.0)) * F.lit(float(w)) for i, w in enumerate(loadings)), F.lit(0.0))
    ranked = positions(rows.withColumn("projection", F.when(some, projection)), "projection", "_key")
    out = ranked.select(F.col("_key").alias(key), *[F.col(f"_s{i}").alias(c) for i, c in enumerate(names)], "projection", "position")
    return out, {c: float(w) * scores[c] for c, w in zip(names, loadings)}
