"""Gaussian mixtures by expectation maximisation, all candidates in one pass a round.

Rows lie in the stationary blocks of ``kmeans.pack``. The start of every (k, restart) is
a short KMeans from its own k-means|| seeds. A round sends the parameters of all mixtures
that still move to the blocks; a task sends back one row of sufficient statistics a
mixture (members, sums and products around the present means, log likelihood), which
Spark adds up. ``reg_covar`` on the diagonal keeps every covariance regular, so no start
is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodloom.operators import kmeans
from moodloom.session import cut

#: KMeans rounds before the first mixture.
START_ROUNDS = 5


@dataclass
class Mixture:
    """Parameters of one candidate, and how its log likelihood went."""

    k: int
    restart: int
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    steps: list[float] = field(default_factory=list)

    @property
    def log_likelihood(self) -> float:
        return self.steps[-1]

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of every row under every component."""
        out = np.empty((len(x), self.k))
        for j in range(self.k):
            low = np.linalg.cholesky(self.covariances[j])
            z = np.linalg.solve(low, (x - self.means[j]).T)
            out[:, j] = -0.5 * ((z * z).sum(0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()
        return out + np.log(np.maximum(self.weights, 1e-300))

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of every component in every row, and the rows' log likelihoods."""
        joint = self.log_joint(x)
        top = joint.max(1)
        total = top + np.log(np.exp(joint - top[:, None]).sum(1))
        return np.exp(joint - total[:, None]), total

    def statistics(self, x: np.ndarray) -> np.ndarray:
        """log likelihood; members, sums and products around the mean, for each component."""
        share, total = self.responsibilities(x)
        return self._sums(x, share, total.sum())

    def hard_statistics(self, x: np.ndarray) -> np.ndarray:
        """The same with every row given to its nearest mean."""
        d2 = ((x[:, None, :] - self.means[None]) ** 2).sum(2)
        return self._sums(x, (d2.argmin(1)[:, None] == np.arange(self.k)[None, :]).astype(float), 0.0)

    def _sums(self, x: np.ndarray, share: np.ndarray, total: float) -> np.ndarray:
        out = [np.array([total])]
        for j in range(self.k):
            far = x - self.means[j]
            mine = far * share[:, j : j + 1]
            out += [np.array([share[:, j].sum()]), mine.sum(0), (mine.T @ far).ravel()]
        return np.concatenate(out)

    def moved(self, sums: np.ndarray, n: int, reg: float) -> Mixture:
        """The parameters that the statistics ask for."""
        d = self.means.shape[1]
        per = sums[1:].reshape(self.k, 1 + d + d * d)
        size = per[:, 0] + 10 * np.finfo(float).eps
        shift = per[:, 1 : 1 + d] / size[:, None]
        cov = per[:, 1 + d :].reshape(self.k, d, d) / size[:, None, None]
        cov = cov - shift[:, :, None] * shift[:, None, :] + reg * np.eye(d)
        return Mixture(self.k, self.restart, size / n, self.means + shift, cov, list(self.steps))

    def bic(self, n: int) -> float:
        """Bayesian information criterion with full covariances."""
        d = self.means.shape[1]
        free = self.k * d + self.k * d * (d + 1) / 2 + self.k - 1
        return float(free * np.log(n) - 2.0 * self.log_likelihood)


def starts(blocks: DataFrame, ks: list[int], restarts: int, seed: int) -> list[Mixture]:
    """A mixture without weights for each (k, restart), at the means of a short KMeans."""
    size = blocks.groupBy("playlist_id").agg(F.first("n").alias("n"), F.first("blocks").alias("blocks"))
    cand = size.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    first = cut(kmeans.gather(kmeans.parallel_seeds(blocks, cand, restarts, max(ks), seed)))
    state = kmeans.lloyd(blocks, first, first.select("playlist_id", "blocks"), START_ROUNDS)
    found: dict[tuple[int, int], list] = {}
    # One playlist: at most restarts x (1 + ... + k_max) centres.
    for c in state.select(F.explode("cents").alias("c")).select("c.*").orderBy("k", "restart", "cid").collect():
        found.setdefault((c.k, c.restart), []).append(c.center)
    out = []
    for (_, restart), centers in found.items():
        x = np.array(centers)
        d, k = x.shape[1], len(x)
        out.append(Mixture(k, restart, np.full(k, 1 / k), x, np.tile(np.eye(d), (k, 1, 1))))
    return out


def _totals(blocks: DataFrame, mixtures: list[Mixture], hard: bool = False) -> list[np.ndarray]:
    """Statistics of all mixtures over all blocks."""

    def fold(batches):
        sums = None
        for b in batches:
            for i in range(b.num_rows):
                x = b.column("vec")[i].values.flatten().to_numpy(zero_copy_only=False).reshape(len(b.column("vec")[i]), -1)
                one = [m.hard_statistics(x) if hard else m.statistics(x) for m in mixtures]
                sums = one if sums is None else [s + o for s, o in zip(sums, one)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.list_(pa.float64()))], names=["place", "sums"]
            )

    parts = blocks.select(F.col("rows.vec").alias("vec")).mapInArrow(fold, "place int, sums array<double>")
    total = parts.groupBy("place").agg(Summarizer.sum(array_to_vector("sums")).alias("s"))
    got = {r.place: np.array(r.s) for r in total.select("place", vector_to_array("s").alias("s")).collect()}
    return [got[i] for i in range(len(mixtures))]


def fit(
    blocks: DataFrame, n: int, ks: list[int], restarts: int = 10, max_iter: int = 100, tol: float = 1e-3,
    reg_covar: float = 1e-4, seed: int = 42,
) -> list[Mixture]:
    """The mixture of the largest log likelihood for each k.

    A mixture leaves the rounds when its mean log likelihood gains less than ``tol``.
    """
    active = starts(blocks, ks, restarts, seed)
    active = [m.moved(s, n, reg_covar) for m, s in zip(active, _totals(blocks, active, hard=True))]
    done: list[Mixture] = []
    for turn in range(max_iter):
        sums = _totals(blocks, active)
        still = []
        for m, s in zip(active, sums):
            m.steps.append(float(s[0]))
            settled = len(m.steps) > 1 and abs(m.steps[-1] - m.steps[-2]) / n < tol
            if settled or turn + 1 == max_iter:
                done.append(m)
            else:
                still.append(m.moved(s, n, reg_covar))
        active = still
        if not active:
            break
    best: dict[int, Mixture] = {}
    for m in done:
        if m.k not in best or m.log_likelihood > best[m.k].log_likelihood:
            best[m.k] = m
    return [best[k] for k in sorted(best)]


def gaussian_mixture(
    rows: DataFrame, features: list[str], k_max: int = 7, restarts: int = 10, max_iter: int = 100, seed: int = 42,
    reg_covar: float = 1e-4, tol: float = 1e-3,
) -> tuple[DataFrame, DataFrame, dict[int, Mixture]]:
    """(labelled rows, sizes, mixtures by k): the mixture with the lowest BIC, k in
    1..min(k_max, n), best of ``restarts`` starts each.

    ``rows`` has track_id and the features; rows with a null are left out. An empty
    table has no mixture and no labels.
    """
    data = rows.na.drop(subset=features).withColumn("_v", F.array(*[F.col(f).cast("double") for f in features]))
    vectors = data.select(F.lit(0).alias("playlist_id"), "track_id", F.lit(0).alias("pos"), F.col("_v").alias("vec"))
    blocks = kmeans.pack(vectors)
    n = int(blocks.agg(F.sum(F.size("rows"))).first()[0] or 0)
    kind = "struct<prediction: int, probability: array<double>>"
    if not n:
        none = data.limit(0).withColumn("m", F.lit(None).cast(kind)).select(*rows.columns, "m.*")
        return none, none.groupBy("prediction").agg(F.count(F.lit(1)).alias("size")), {}
    found = {m.k: m for m in fit(blocks, n, list(range(1, min(k_max, n) + 1)), restarts, max_iter, tol, reg_covar, seed)}
    best = min(found.values(), key=lambda m: (m.bic(n), m.k))

    @F.arrow_udf(kind)
    def labels(v: pa.Array) -> pa.Array:
        share, _ = best.responsibilities(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1))
        cuts = pa.array(np.arange(0, share.size + 1, best.k, dtype=np.int32))
        lists = pa.ListArray.from_arrays(cuts, pa.array(share.ravel()))
        return pa.StructArray.from_arrays([pa.array(share.argmax(1).astype(np.int32)), lists], ["prediction", "probability"])

    labelled = data.withColumn("m", labels("_v")).select(*rows.columns, "m.*")
    sizes = labelled.groupBy("prediction").agg(F.count(F.lit(1)).alias("size"))
    return labelled, sizes, found
