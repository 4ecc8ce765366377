"""Queries: learned clusters, silhouette, mixtures, scores against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodloom.checks.ctes import with_ctes as sql
from moodloom.checks.registry import query, r6
from moodloom.operators import analysis, features, kmeans, mixture, models
from moodloom.plans.pipeline import analyze
from moodloom.schema import FEATURES
from moodloom.sources import tables

ROUNDS = 3


def _lloyd_sql(points: str, ks: str) -> dict[str, str]:
    """Unrolled rounds for every k in the list ``ks`` (one start per k)."""
    out = {
        "pts": points,
        "start": """SELECT playlist_id, arg_min(vec, md5('42:0:' || track_id)) AS vec,
            row_number() OVER (PARTITION BY playlist_id ORDER BY min(md5('42:0:' || track_id))) AS r
            FROM pts GROUP BY playlist_id, list_transform(vec, lambda x: floor(x * 1e9 + 5e-1))""",
        "c0": f"""SELECT playlist_id, k, CAST(r - 1 AS INT) AS cid, vec FROM start, (SELECT unnest({ks}) AS k) WHERE r <= k""",
    }
    for i in range(ROUNDS + 1):
        out[f"a{i}"] = f"""SELECT p.playlist_id, k, track_id, arg_min(cid, (round(list_distance(p.vec, c.vec) ** 2, 9), cid)) AS cid
            FROM pts p JOIN c{i} c ON c.playlist_id = p.playlist_id GROUP BY 1, 2, 3"""
        if i < ROUNDS:
            out[f"c{i + 1}"] = f"""SELECT o.playlist_id, o.k, o.cid, coalesce(n.vec, o.vec) AS vec FROM c{i} o LEFT JOIN (
                SELECT playlist_id, k, cid, list(v ORDER BY j) AS vec FROM (
                  SELECT a.playlist_id, k, cid, j, avg(v) AS v FROM a{i} a JOIN (
                    SELECT playlist_id, track_id, generate_subscripts(vec, 1) AS j, unnest(vec) AS v FROM pts) x
                    ON x.playlist_id = a.playlist_id AND x.track_id = a.track_id GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) n
                ON n.playlist_id = o.playlist_id AND n.k = o.k AND n.cid = o.cid"""
    return out


_PTS = "SELECT playlist_id, track_id, list(v ORDER BY j) AS vec FROM dense GROUP BY 1, 2"
_LIB = "SELECT 'library' AS playlist_id, vec_id AS track_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings"


def _silhouette_sql(labels: str, power: int = 1) -> dict[str, str]:
    """Scores per (playlist, k) from ``labels`` (playlist_id, k, track_id, cid)."""
    d = "list_distance(a.vec, b.vec)" + (" * list_distance(a.vec, b.vec)" if power == 2 else "")
    return {
        "lab": labels,
        "pair": f"""SELECT a.playlist_id, a.track_id AS ta, b.track_id AS tb,
            CASE WHEN a.track_id = b.track_id THEN 0e0 ELSE {d} END AS d FROM pts a JOIN pts b ON a.playlist_id = b.playlist_id""",
        "sizes": "SELECT playlist_id, k, cid, count(*) AS m FROM lab GROUP BY 1, 2, 3",
        "sums": """SELECT p.playlist_id, l.k, ta, l.cid, sum(d) AS s FROM pair p JOIN lab l
            ON l.playlist_id = p.playlist_id AND l.track_id = p.tb GROUP BY 1, 2, 3, 4""",
        "ab": """SELECT s.playlist_id, s.k, ta, any_value(z.m) FILTER (s.cid = o.cid) AS own,
            max(CASE WHEN s.cid = o.cid THEN s.s / greatest(z.m - 1, 1) END) AS a,
            min(CASE WHEN s.cid <> o.cid THEN s.s / z.m END) AS b
            FROM sums s JOIN sizes z ON z.playlist_id = s.playlist_id AND z.k = s.k AND z.cid = s.cid
            JOIN lab o ON o.playlist_id = s.playlist_id AND o.k = s.k AND o.track_id = s.ta GROUP BY 1, 2, 3""",
        "score": """SELECT playlist_id, k, avg(CASE WHEN own = 1 OR greatest(a, b) = 0 THEN 0e0 ELSE (b - a) / greatest(a, b) END) AS score
            FROM ab WHERE b IS NOT NULL GROUP BY 1, 2""",
    }


_K4 = _lloyd_sql(_PTS, "[4]")


@query(
    "K1_kmeans",
    sql(f"SELECT playlist_id, track_id, cid AS cluster_id FROM a{ROUNDS}", _K4),
)
def k1(s):
    labelled, _ = kmeans.search(_vectors(s), 4, 4, restarts=1, max_iter=ROUNDS, tol=0.0, init="hash")
    return labelled.select("playlist_id", "track_id", F.col("labels")[0]["cluster_id"].alias("cluster_id"))


def _vectors(s):
    return s.vectors.select("playlist_id", "track_id", "pos", "n", "vec")


@query(
    "K1_kmeans_library",
    sql(f"SELECT track_id, cid AS cluster_id FROM a{ROUNDS}", _lloyd_sql(_LIB, "[10]")),
)
def k1b(s):
    lib = tables.vector_library(s.spark, s.sf_dir).drop("cluster_id")
    labelled, _ = kmeans.search(lib, 10, 10, restarts=1, max_iter=ROUNDS, tol=0.0, init="hash")
    return labelled.select("track_id", F.col("labels")[0]["cluster_id"].alias("cluster_id"))


_SEARCH = {**_lloyd_sql(_PTS, "[3, 4, 5, 6, 7, 8]"), **_silhouette_sql(f"SELECT * FROM a{ROUNDS}", 2)}
_BEST = """SELECT playlist_id, k FROM score QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY round(score, 9) DESC, k) = 1"""


def _searched(s):
    blocks, best, cand = kmeans.fit(_vectors(s), restarts=1, max_iter=ROUNDS, tol=0.0, init="hash")
    return kmeans.block_silhouette(blocks, best), cand


@query("K2_silhouette_by_k", sql("SELECT playlist_id, CAST(k AS INT) AS k, round(score, 6) AS score FROM score", _SEARCH))
def k2(s):
    scores, _ = _searched(s)
    return scores.select("playlist_id", "k", r6("score").alias("score"))


@query("K2_chosen_k", sql("SELECT playlist_id, CAST(k AS INT) AS k FROM best", {**_SEARCH, "best": _BEST}))
def k2b(s):
    scores, cand = _searched(s)
    return kmeans.choose_k(cand, scores)


_GIVEN = "SELECT playlist_id, 9 AS k, track_id, cluster_id AS cid FROM assign"


def _given(s):
    """Vectors with the given clusters, made where the entries of a playlist lie."""
    return features.transform(s.assigned, s.model, s.hot, ["_salt", "cluster_id"]).select(
        "playlist_id",
        "_salt",
        "track_id",
        "pos",
        "vec",
        F.array(F.struct(F.lit(9).alias("k"), "cluster_id")).alias("labels"),
    )


@query(
    "K3_silhouette",
    sql("SELECT playlist_id, round(score, 6) AS score FROM score", {"pts": _PTS, **_silhouette_sql(_GIVEN)}),
)
def k3(s):
    scores = kmeans.silhouette(_given(s), s.model.select("playlist_id", "n"), "euclidean")
    return scores.select("playlist_id", r6("score").alias("score"))


@query(
    "K3_silhouette_squared",
    sql("SELECT playlist_id, round(score, 6) AS score FROM score", {"pts": _PTS, **_silhouette_sql(_GIVEN, 2)}),
)
def k3b(s):
    scores = kmeans.silhouette(_given(s).drop("_salt"), s.model.select("playlist_id", "n"), "squared")
    return scores.select("playlist_id", r6("score").alias("score"))


_LIBSIL = {
    "pts": _LIB,
    **_silhouette_sql("SELECT 'library' AS playlist_id, 10 AS k, vec_id AS track_id, label AS cid FROM embeddings", 2),
}


@query("K3_silhouette_library", sql("SELECT round(score, 6) AS score FROM score", _LIBSIL))
def k3c(s):
    lib = tables.vector_library(s.spark, s.sf_dir)
    points = lib.select("playlist_id", "track_id", F.lit(10).alias("k"), "cluster_id", "vec")
    return kmeans.silhouette_moments(points).select(r6("score").alias("score"))


def _mixture(s):
    """The mixture with the lowest BIC over all tracks, all k from the same rounds."""
    audio = features.audio_columns(s.source_tracks).withColumn("playlist_id", F.lit("catalog"))
    scaled = features.robust_scale(audio)
    return mixture.gaussian_mixture(scaled, list(FEATURES), restarts=3, max_iter=40)


@query("K4_gaussian_mixture")
def k4(s):
    """Sizes of the chosen mixture and the BIC of every k."""
    _, sizes, found = _mixture(s)
    n = sizes.agg(F.sum("size")).first()[0]
    table = s.spark.createDataFrame([(k, m.bic(n)) for k, m in found.items()], "k int, bic double")
    return sizes.select(F.lit("size").alias("fact"), F.col("prediction").alias("k"), F.col("size").cast("double").alias("value")).unionByName(
        table.select(F.lit("bic").alias("fact"), "k", F.col("bic").alias("value"))
    )


def _swept(name: str, source: str, keys: str, d: int) -> dict[str, str]:
    """CTEs that sweep every pivot of the symmetric matrix a0_0..a8_8 (upper triangle) in
    ``source``: afterwards the entries are those of minus the inverse, ``logdet`` is the
    log of the determinant."""
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    at = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    out = {f"{name}0": f"SELECT {keys}, 0e0 AS logdet, {', '.join(at(i, j) for i, j in upper)} FROM {source}"}
    for k in range(d):
        p = at(k, k)
        entry = []
        for i, j in upper:
            if i == k and j == k:
                e = f"-1 / {p}"
            elif k in (i, j):
                e = f"{at(i, j)} / {p}"
            else:
                e = f"{at(i, j)} - {at(i, k)} * {at(j, k)} / {p}"
            entry.append(f"{e} AS {at(i, j)}")
        out[f"{name}{k + 1}"] = f"SELECT {keys}, logdet + ln({p}) AS logdet, {', '.join(entry)} FROM {name}{k}"
    return out


_D = len(FEATURES)
_UPPER = [(i, j) for i in range(_D) for j in range(i, _D)]
_ROBUST = {
    # Median and quartiles of each feature over the tracks with all features.
    "rr": f"SELECT track_id, {', '.join(FEATURES)} FROM tracks WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)}",
    "rq": "SELECT "
    + ", ".join(
        f"quantile_cont({f}, 5e-1) AS m{i}, quantile_cont({f}, 75e-2) - quantile_cont({f}, 25e-2) AS s{i}" for i, f in enumerate(FEATURES)
    )
    + " FROM rr",
    "rx": "SELECT track_id, "
    + ", ".join(f"CASE WHEN s{i} = 0 THEN 0e0 ELSE ({f} - m{i}) / s{i} END AS z{i}" for i, f in enumerate(FEATURES))
    + " FROM rr, rq",
    "rc": "SELECT count(*) AS n, "
    + ", ".join(f"covar_pop(z{i}, z{j}){' + 1e-4' if i == j else ''} AS a{i}_{j}" for i, j in _UPPER)
    + " FROM rx",
    **_swept("rw", "rc", "n", _D),
}


@query(
    "K4_single_gaussian",
    sql(
        f"""SELECT n, round(({_D} + {_D * (_D + 1) // 2}) * ln(n)
          + n * ({_D} * ln(2 * pi()) + logdet + {_D} + 1e-4 * ({' + '.join(f'a{i}_{i}' for i in range(_D))})), 4) AS bic,
          true AS never_falls FROM rw{_D}""",
        _ROBUST,
    ),
)
def k4b(s):
    """Rows of all clusters together, BIC of one component, and whether any mixture lost likelihood."""
    _, sizes, found = _mixture(s)
    never = all(b >= a - 1e-6 * abs(a) for m in found.values() for a, b in zip(m.steps, m.steps[1:]))
    n = sizes.agg(F.sum("size")).first()[0]
    return sizes.agg(F.sum("size").alias("n")).select(
        "n", F.round(F.lit(found[1].bic(n)), 4).alias("bic"), F.lit(never).alias("never_falls")
    )


_END = {
    **_SEARCH,
    "best": _BEST,
    "assign": f"""SELECT e.playlist_id, e.track_id, e.pos, a.cid AS cluster_id FROM elig e
      JOIN a{ROUNDS} a ON a.playlist_id = e.playlist_id AND a.track_id = e.track_id
      JOIN best b ON b.playlist_id = a.playlist_id AND b.k = a.k""",
}


def learned(s):
    return analyze(s.playlists, s.items, s.source_tracks, restarts=1, max_iter=ROUNDS, tol=0.0, init="hash")


@query(
    "analyze_summary",
    sql("SELECT * REPLACE (round(anomaly_score_cutoff, 6) AS anomaly_score_cutoff) FROM summary", _END),
)
def whole(s):
    """The full analysis with learned clusters, end to end."""
    return learned(s).summary.withColumn("anomaly_score_cutoff", r6("anomaly_score_cutoff"))


# --- described only ----------------------------------------------------------

# Fixed value: 0.99 quantile of the chi-square distribution, 9 degrees.
CHI2_9_99 = 21.666


_SHRUNK = {
    "mr": f"SELECT playlist_id, track_id, {', '.join(FEATURES)} FROM lib WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)}",
    "mm": "SELECT playlist_id, count(*) AS n, "
    + ", ".join(f"avg({f}) AS m{i}, coalesce(nullif(stddev_pop({f}), 0), 1) AS s{i}" for i, f in enumerate(FEATURES))
    + " FROM mr GROUP BY playlist_id",
    "mz": "SELECT playlist_id, track_id, n, " + ", ".join(f"({f} - m{i}) / s{i} AS z{i}" for i, f in enumerate(FEATURES)) + " FROM mr JOIN mm USING (playlist_id)",
    "mc": "SELECT playlist_id, any_value(n) AS n, "
    + ", ".join(f"avg(z{i} * z{j}) AS a{i}_{j}" for i, j in _UPPER)
    + f", avg(({' + '.join(f'z{i} * z{i}' for i in range(_D))}) ** 2) AS fourth FROM mz GROUP BY playlist_id",
    "md": f"""SELECT *, ({' + '.join(f'a{i}_{i}' for i in range(_D))}) / {_D} AS m,
      {' + '.join(f'{1 if i == j else 2} * a{i}_{j} * a{i}_{j}' for i, j in _UPPER)} AS squares FROM mc""",
    "ms": f"""SELECT *, CASE WHEN squares / {_D} - m * m > 0
      THEN least(greatest((fourth - squares) / (n * {_D}), 0) / (squares / {_D} - m * m), 1) ELSE 0 END AS shrinkage FROM md""",
    "mt": "SELECT playlist_id, "
    + ", ".join(f"(1 - shrinkage) * a{i}_{j}{' + shrinkage * m' if i == j else ''} AS a{i}_{j}" for i, j in _UPPER)
    + " FROM ms",
    **_swept("mw", "mt", "playlist_id", _D),
}


@query("D9_shrinkage", sql("SELECT playlist_id, n, round(shrinkage, 6) AS shrinkage FROM ms", _SHRUNK))
def d9b(s):
    found = models.shrunk_covariances(s.library, list(FEATURES))
    return found.select("playlist_id", "n", r6("shrinkage").alias("shrinkage"))


@query(
    "D9_mahalanobis",
    sql(
        f"""SELECT playlist_id, track_id, round(sqrt(q), 6) AS score, q > {CHI2_9_99} AS flagged FROM (
          SELECT playlist_id, track_id, {' + '.join(f'{-1 if i == j else -2} * a{i}_{j} * z{i} * z{j}' for i, j in _UPPER)} AS q
          FROM mz JOIN mw{_D} USING (playlist_id))""",
        _SHRUNK,
    ),
)
def d9(s):
    return models.mahalanobis(s.library, list(FEATURES), CHI2_9_99).withColumn("score", r6("score"))


_UNIT = "list_transform(v, lambda c: c / sqrt(list_dot_product(v, v)) * sign(list_extract(v, list_position(list_transform(v, lambda a: abs(a)), list_max(list_transform(v, lambda a: abs(a)))))))"


def _first_axis(name: str, matrix: str) -> dict[str, str]:
    """CTEs of the first eigenvector of a symmetric matrix ``m`` (list of rows), by repeated squaring."""
    return {
        f"{name}p": f"""SELECT 0 AS i, m FROM {matrix} UNION ALL
          SELECT i + 1, list_transform(q, lambda r: list_transform(r, lambda c: c / list_max(list_transform(q, lambda w: list_max(list_transform(w, lambda b: abs(b)))))))
          FROM (SELECT i, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) AS q FROM {name}p WHERE i < 30)""",
        f"{name}v": f"SELECT {_UNIT} AS v FROM (SELECT list_extract(m, 1) AS v FROM {name}p WHERE i = 30)",
    }


_PCA = {
    "pr": f"SELECT track_id, {', '.join(FEATURES)} FROM tracks WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)}",
    "pz": f"SELECT track_id, [{', '.join(f'({f} - m{i}) / s{i}' for i, f in enumerate(FEATURES))}] AS z FROM pr, (SELECT "
    + ", ".join(f"avg({f}) AS m{i}, stddev_samp({f}) AS s{i}" for i, f in enumerate(FEATURES))
    + " FROM pr)",
    "pm": "SELECT [" + ", ".join("[" + ", ".join(f"avg(z[{i + 1}] * z[{j + 1}])" for j in range(_D)) + "]" for i in range(_D)) + "] AS m FROM pz",
    **_first_axis("pa", "pm"),
    # The matrix without its first axis.
    "pn": """SELECT list_transform(m, lambda r, i: list_transform(r, lambda c, j: c - e * v[i] * v[j])) AS m FROM (
      SELECT m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS e FROM pm, pav)""",
    **_first_axis("pb", "pn"),
}


@query(
    "D10_projection",
    sql(
        """SELECT track_id, round(list_dot_product(z, pav.v), 6) AS x, round(list_dot_product(z, pbv.v), 6) AS y FROM pz, pav, pbv""",
        _PCA,
    ),
)
def d10(s):
    found = models.project(features.audio_columns(s.source_tracks), list(FEATURES))
    return found.select("track_id", r6("x").alias("x"), r6("y").alias("y"))


_REMOVED = {
    "removed": """SELECT l_suppkey AS playlist_id, l_partkey AS track_id, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label
        FROM lineitem GROUP BY 1, 2""",
    "lab": "SELECT s.*, r.label FROM scored s JOIN removed r USING (playlist_id, track_id)",
    "low": """SELECT *, avg(up) OVER (PARTITION BY playlist_id, anomaly_score) AS low FROM (
        SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY anomaly_score, pos DESC, track_id DESC) AS up,
          row_number() OVER (PARTITION BY playlist_id ORDER BY anomaly_score DESC, pos, track_id) AS rn FROM lab)""",
}


def _labelled(s):
    removed = s.read("lineitem").groupBy(
        F.col("l_suppkey").alias("playlist_id"), F.col("l_partkey").alias("track_id")
    ).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))
    return analysis.average_ranks(s.scored.join(removed, ["playlist_id", "track_id"]))


@query(
    "D11_precision_at_k",
    sql("SELECT playlist_id, round(avg(label), 6) AS precision FROM low WHERE rn <= 20 GROUP BY 1", _REMOVED),
)
def d11(s):
    return models.precision_at(_labelled(s), 20).withColumn("precision", r6("precision"))


@query(
    "D11_roc_auc",
    sql("""SELECT playlist_id, round((sum(low) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2e0)
      / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0), 6) AS auc FROM low GROUP BY 1""", _REMOVED),
)
def d11b(s):
    return models.roc_auc_by_playlist(_labelled(s)).withColumn("auc", r6("auc"))
