"""Mahalanobis score, projection, measures of a ranking."""

from __future__ import annotations

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodloom.session import settle


def shrunk_covariances(rows: DataFrame, features: list[str]) -> DataFrame:
    """(playlist_id, n, mean, scale, cov, shrinkage): covariance of the standardised
    features of each playlist, drawn towards the mean variance.

    ``cov`` is the upper triangle of ``(1 - s) S + s m I``: S the covariance, m its mean
    diagonal, s the intensity of Ledoit and Wolf, which follows from the second moments
    and the mean fourth power of a row's length. All moments combine before the shuffle.
    A constant feature has scale 1, so it is zero in S. Rows with a null are left out.
    """
    d = len(features)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    clean = rows.select("playlist_id", *features).na.drop(subset=features)
    center = clean.groupBy("playlist_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(f) for f in features]).alias("mean"),
        F.array(*[F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0)) for f in features]).alias("scale"),
    )
    z = clean.join(center, "playlist_id").select(
        "playlist_id", "n", "mean", "scale", *[((F.col(f) - F.col("mean")[i]) / F.col("scale")[i]).alias(f"z{i}") for i, f in enumerate(features)]
    )
    length = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, d)), F.col("z0") * F.col("z0"))
    moments = z.groupBy("playlist_id").agg(
        F.first("n").alias("n"),
        F.first("mean").alias("mean"),
        F.first("scale").alias("scale"),
        F.array(*[F.avg(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in upper]).alias("s"),
        F.avg(length * length).alias("fourth"),
    )
    diagonal = [upper.index((i, i)) for i in range(d)]
    m = sum((F.col("s")[p] for p in diagonal[1:]), F.col("s")[0]) / d
    squares = sum(((1 if i == j else 2) * F.col("s")[p] * F.col("s")[p] for p, (i, j) in enumerate(upper)), F.lit(0.0))
    moments = moments.withColumns({"m": m, "squares": squares})
    noise = (F.col("fourth") - F.col("squares")) / (F.col("n") * d)
    spread = F.col("squares") / d - F.col("m") * F.col("m")
    moments = moments.withColumn(
        "shrinkage", F.when(spread > 0, F.least(F.greatest(noise, F.lit(0.0)) / spread, F.lit(1.0))).otherwise(F.lit(0.0))
    )
    shrunk = F.transform(
        "s",
        lambda x, p: (1 - F.col("shrinkage")) * x
        + F.when(F.array_contains(F.array(*[F.lit(p_) for p_ in diagonal]), p), F.col("shrinkage") * F.col("m")).otherwise(0.0),
    )
    return moments.select("playlist_id", "n", "mean", "scale", shrunk.alias("cov"), "shrinkage")


def mahalanobis(rows: DataFrame, features: list[str], cutoff: float) -> DataFrame:
    """Distance of each row to the centre of its playlist under the playlist's shrunk
    covariance, and whether its square exceeds ``cutoff`` (a chi-square quantile). Rows
    with a null are left out.

    The inverse of a playlist is made once, by a Cholesky factor of its matrix (a
    pseudo-inverse where it has none, as in a playlist of equal rows); the rows then
    meet one bounded row a playlist.
    """
    d = len(features)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    clean = rows.select("playlist_id", "track_id", *features).na.drop(subset=features)
    pid = rows.schema["playlist_id"].dataType.simpleString()

    def invert(batches):
        for pdf in batches:
            out = []
            for cov in pdf["cov"]:
                full = np.zeros((d, d))
                for (i, j), v in zip(upper, cov):
                    full[i, j] = full[j, i] = v
                try:
                    low = np.linalg.inv(np.linalg.cholesky(full))
                    out.append((low.T @ low).ravel())
                except np.linalg.LinAlgError:
                    out.append(np.linalg.pinv(full, hermitian=True).ravel())
            yield pdf[["playlist_id", "mean", "scale"]].assign(inv=out)

    inverse = shrunk_covariances(rows, features).select("playlist_id", "mean", "scale", "cov").mapInPandas(
        invert, f"playlist_id {pid}, mean array<double>, scale array<double>, inv array<double>"
    )
    diff = F.transform(
        F.array(*[F.col(f) for f in features]), lambda x, i: (x - F.get(F.col("mean"), i)) / F.get(F.col("scale"), i)
    )
    row = clean.join(inverse, "playlist_id").withColumn("_d", diff)
    # Sum over all (i, j) of d_i * inv_ij * d_j.
    square = F.aggregate(
        F.transform(
            F.col("inv"),
            lambda w, p: w
            * F.get(F.col("_d"), F.floor(p / d).cast("int"))
            * F.get(F.col("_d"), (p % d).cast("int")),
        ),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    return row.select(
        "playlist_id", "track_id", F.sqrt(F.greatest(square, F.lit(0.0))).alias("score")
    ).withColumn("flagged", F.col("score") * F.col("score") > cutoff)


def project(rows: DataFrame, features: list[str]) -> DataFrame:
    """(.., x, y): the first two principal components of standardised
    features over the whole corpus, for a map of moods.

    The largest loading of a component is positive, so the map has one orientation.
    """
    from pyspark.ml.feature import StandardScaler

    data = settle(
        rows.select("track_id", *features)
        .na.drop(subset=features)
        .withColumn("_v", array_to_vector(F.array(*[F.col(f) for f in features])))
    )
    scaled = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(data).transform(data)
    model = PCA(k=2, inputCol="_s", outputCol="_p").fit(scaled)
    pc = model.pc.toArray()
    sign = np.sign(pc[np.abs(pc).argmax(0), [0, 1]])
    xy = vector_to_array("_p")
    return model.transform(scaled).select(
        "track_id", (xy[0] * float(sign[0])).alias("x"), (xy[1] * float(sign[1])).alias("y")
    )


def precision_at(ranked: DataFrame, k: int) -> DataFrame:
    """Share of positives (``label`` 1) among the first ``k`` of a playlist.
    ``ranked`` holds ``rn``, the rank in the playlist."""
    return ranked.filter(F.col("rn") <= k).groupBy("playlist_id").agg(
        F.avg(F.col("label").cast("double")).alias("precision")
    )


def roc_auc(ranked: DataFrame) -> float:
    """Area under the ROC curve of ``anomaly_score`` against ``label``."""
    return BinaryClassificationEvaluator(
        rawPredictionCol="anomaly_score", labelCol="label", numBins=0
    ).evaluate(ranked.select("anomaly_score", F.col("label").cast("double").alias("label")))


def roc_auc_by_playlist(ranked: DataFrame) -> DataFrame:
    """The same per playlist from ranks (Mann-Whitney). ``ranked`` holds
    ``low``, the mean rank of the score among the playlist, smallest first."""
    pos = F.col("label") == 1
    agg = ranked.groupBy("playlist_id").agg(
        F.sum(F.when(pos, F.col("low"))).alias("r"),
        F.count_if(pos).alias("p"),
        F.count_if(~pos).alias("q"),
    )
    return agg.select(
        "playlist_id",
        ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("auc"),
    )
