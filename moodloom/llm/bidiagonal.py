"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers (``floor(64 c) + 1000000``), each distinct one once: the
fit list, kept as a table of blocks, flat arrays of at most ``BLOCK`` vectors. Its rows,
centred, are the matrix X. Starting from a random unit vector v1, every step makes
``p = X (v - beta w')``, takes out its parts along all left vectors before it, and has
``alpha u = p``; then ``X^T u`` without its parts along all right vectors is ``beta v`` of
the next step. X never leaves its blocks: a step is one pass in which every block makes
its part of Xv and, with it, of X^T u. A left vector has as many entries as the fit list
has rows, so it is kept as ``u = X w`` and made anew inside each block from its short w;
what comes back of a block are two short vectors and a number. The small bidiagonal
matrix of all alphas and betas has the singular values and, turned by the right vectors,
the components of X. A vanishing beta goes on from a fresh direction, so that repeated
eigenvalues are all found.

Steps end when every wanted component's residual is at rounding level and what is left of
the squared norm of X outside the steps is less than the smallest wanted squared singular
value, so no larger one can hide; at the latest after as many steps as there are
dimensions.

Defined cases: rows whose vector is null or holds null or non-finite entries are left
out; vectors of different lengths are whitened apart, each length with its own fit list;
repeated rows and repeated ids stay rows; other columns do not matter; directions
without any spread (below 1e-6 of the largest deviation) have no component, so one
vector alone, an empty vector and an empty table give no rows. Whole numbers stop at
2^61 in size; a deviation that no long can hold is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodloom.llm.common import bound_batches, settle

COMPONENTS = 16
#: Bytes of vectors in a block.
BLOCK_BYTES = 1 << 20
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 61
#: Residual of a component, and singular values that count as zero, of the largest one.
RESIDUAL, RANK = 1e-14, 1e-6
#: Sums of tasks that go to the driver as they are; more are added up in groups first.
FAN = 256


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, dim): x is the vector of whole numbers as bytes, 8 for each entry."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is NaN
        sizes = np.diff(np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        ends = np.cumsum(sizes)
        odd = np.r_[0, np.cumsum(~np.isfinite(flat))]
        good = (odd[ends] == odd[ends - sizes]) & lists.is_valid().to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            x = np.floor(SCALE * np.nan_to_num(flat)) + SHIFT
        x = np.clip(x, -float(LARGEST), float(LARGEST)).astype("<i8").tobytes()
        cut = zip((8 * (ends - sizes)).tolist(), (8 * ends).tolist(), good.tolist())
        return pa.array([x[a:b] if g else None for a, b, g in cut], pa.binary())

    rows = vectors.select("vec_id", pack(F.col("embedding").cast("array<double>")).alias("x"))
    return rows.where("x IS NOT NULL").withColumn("dim", (F.length("x") / 8).cast("int"))


def _numbers(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a column of packed vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def blocks(rows: DataFrame) -> DataFrame:
    """(dim, n, x): the distinct vectors of ``rows``, many in a row, in a settled table."""

    def pack(batches):
        held: dict[int, list[bytes]] = {}

        def row(dim):
            xs = held.pop(dim)
            return {"dim": dim, "n": len(xs), "x": b"".join(xs)}

        for batch in batches:
            for dim, x in zip(batch.column("dim").to_pylist(), batch.column("x").to_pylist()):
                held.setdefault(dim, []).append(x)
                if len(held[dim]) * dim * 8 >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([row(dim)], kind)
        for dim in list(held):
            yield pa.RecordBatch.from_pylist([row(dim)], kind)

    kind = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("x", pa.binary())])
    fit = rows.where("dim > 0").select("dim", "x").distinct()
    return settle(fit.mapInArrow(pack, "dim int, n bigint, x binary"))


@dataclass
class Centre:
    """n vectors with sums S: every mean is ``low + rest / n`` in whole numbers."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.low = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low).astype(float) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row."""
        rough = ((self.n * self.centred(x)) ** 2).sum(1)
        with np.errstate(over="ignore"):
            exact = ((self.n * (x - self.low) - self.rest) ** 2).sum(1)
        border = 2.0**63
        out = exact.tolist()
        for k in np.flatnonzero(rough > 0.999 * border):
            true = sum((self.n * (int(a) - int(b)) - int(r)) ** 2 for a, b, r in zip(x[k], self.low, self.rest))
            out[k] = true if true < 1 << 63 else None
        return out


def _folded(fit: DataFrame, dim: int, part) -> list[bytes]:
    """``part(x)``, a NumPy array, of every block, as few sums in the order of the tasks."""

    def fold(batches):
        total = None
        for batch in batches:
            for x in batch.column("x").to_pylist():
                one = part(np.frombuffer(x, "<i8").reshape(-1, dim))
                total = one if total is None else total + one
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"task": task, "kind": total.dtype.str, "sum": total.tobytes()}], schema)

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["task"])
        total = np.sum([np.frombuffer(r["sum"], r["kind"]) for r in rows], axis=0)
        return pa.Table.from_pylist([rows[0] | {"sum": total.tobytes()}], schema)

    schema = pa.schema([("task", pa.int32()), ("kind", pa.string()), ("sum", pa.binary())])
    sums = fit.select("x").mapInArrow(fold, "task int, kind string, sum binary")
    if fit.rdd.getNumPartitions() > FAN:
        sums = sums.groupBy(F.pmod("task", F.lit(FAN))).applyInArrow(add, sums.schema)
    return [r["sum"] for r in sorted(sums.collect(), key=lambda r: r["task"])]


def _sum(fit: DataFrame, dim: int, part) -> np.ndarray:
    parts = [np.frombuffer(b) for b in _folded(fit, dim, part)]
    return np.array(np.sum(parts, axis=0)) if parts else np.zeros(0)


def centre_of(fit: DataFrame, dim: int) -> Centre:
    """Exact sums: high and low halves of the numbers are added apart."""

    def halves(x):
        return np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]).astype(np.int64)

    parts = [np.frombuffer(b, np.int64).tolist() for b in _folded(fit, dim, halves)]
    total = [sum(p) for p in zip(*parts)]
    return Centre(total[0], [(h << 32) + low for h, low in zip(total[1 : 1 + dim], total[1 + dim :])])


@dataclass
class Components:
    centre: Centre
    vectors: np.ndarray  # unit components as columns
    variances: np.ndarray
    total: float
    steps: int


def bidiagonalise(fit: DataFrame, dim: int, centre: Centre, wanted: int = COMPONENTS, seed: int = 7) -> Components:
    """The components of largest variance of the fit list."""
    rng = np.random.default_rng(seed)

    def fresh(basis):
        v = rng.standard_normal(dim)
        for _ in range(2):
            v -= basis @ (basis.T @ v)
        return v / np.linalg.norm(v)

    total = float(_sum(fit, dim, lambda x: np.array([(centre.centred(x) ** 2).sum()]))[0])
    v_all, w_all, z_all = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))  # z is X^T u
    alphas: list[float] = []
    betas: list[float] = []
    v, beta, scale = fresh(v_all), 0.0, np.sqrt(total)
    values = np.zeros(0)
    while total:
        q = v - beta * w_all[:, -1] if beta else v

        def step(x, q=q, w=w_all):
            c = centre.centred(x)
            p = c @ q
            return np.concatenate([[p @ p], c.T @ p, (c @ w).T @ p])

        back = _sum(fit, dim, step)
        along = back[1 + dim :]  # parts along the left vectors before
        # The cut of p along them; both short forms of it are turned alike.
        w, z = q - w_all @ along, back[1 : 1 + dim] - z_all @ along
        alpha = np.sqrt(max(back[0] - along @ along, 0.0))
        v_all = np.c_[v_all, v]
        if alpha <= RANK * 1e-3 * scale:  # nothing of X in this direction
            alpha, w, z = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            w, z = w / alpha, z / alpha
        alphas.append(float(alpha))
        w_all, z_all = np.c_[w_all, w], np.c_[z_all, z]
        k = len(alphas)
        r = z - alpha * v
        for _ in range(2):
            r = r - v_all @ (v_all.T @ r)
        beta = float(np.linalg.norm(r))
        if k == dim or k <= 64 or k % 8 == 0:
            left, values, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
            n = min(wanted, k)
            rest = total - (values**2).sum()  # of the squared norm of X
            exact = (beta * np.abs(left[-1, :n]) <= RESIDUAL * values[0]).all()
            least = values[n - 1] ** 2 if k >= wanted else 0.0
            if k == dim or (exact and rest < max(least, RANK**2 * total)):
                break
        if beta <= 1e-13 * scale:
            v, beta = fresh(v_all), 0.0
        else:
            v = r / beta
        betas.append(beta)
    if not total:
        return Components(centre, np.zeros((dim, 0)), np.zeros(0), 0.0, 0)
    keep = int((values[:wanted] > RANK * values[0]).sum())
    vectors = v_all @ right[:keep].T
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(keep)])
    return Components(centre, vectors, values[:keep] ** 2 / centre.n, total / centre.n, len(alphas))


def identity_error(fit: DataFrame, dim: int, found: Components) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity)."""
    k = len(found.variances)
    turn = found.vectors / np.sqrt(found.variances)

    def part(x):
        y = found.centre.centred(x) @ turn
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    back = _sum(fit, dim, part) / found.centre.n
    mean, second = back[:k], back[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


ROW = "n bigint, deviation bigint, whitened array<double>"


def whiten(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    bound_batches(vectors.sparkSession)
    rows = settle(whole_numbers(vectors))
    fit = blocks(rows)
    dims = sorted(r[0] for r in fit.select("dim").distinct().collect())
    out = None
    for dim in dims:
        mine = fit.where(F.col("dim") == dim)
        found = bidiagonalise(mine, dim, centre_of(mine, dim), wanted)
        if not len(found.variances):
            continue
        error = identity_error(mine, dim, found)
        one = _whitened(rows.where(F.col("dim") == dim), dim, found, error)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = rows.select(
            "vec_id",
            F.lit(0).alias("component"),
            *[F.lit(0).cast("bigint").alias(c) for c in ("n", "deviation")],
            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")],
        ).limit(0)
    return out


def _whitened(rows: DataFrame, dim: int, found: Components, error: float) -> DataFrame:
    turn = found.vectors / np.sqrt(found.variances)
    centre, share = found.centre, (found.variances / found.total).tolist()

    @F.arrow_udf("struct<deviation: bigint, whitened: array<double>>")
    def project(xs: pa.Array) -> pa.Array:
        x = _numbers(xs, dim)
        y = centre.centred(x) @ turn
        cuts = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
        lists = pa.ListArray.from_arrays(cuts, pa.array(y.ravel()))
        return pa.StructArray.from_arrays([pa.array(centre.deviation(x), pa.int64()), lists], ["deviation", "whitened"])

    shares = F.array(*[F.lit(s) for s in share])
    return (
        rows.select("vec_id", project("x").alias("p"))
        .select("vec_id", "p.deviation", F.posexplode("p.whitened").alias("pos", "whitened"))
        .select(
            "vec_id",
            (F.col("pos") + 1).cast("int").alias("component"),
            F.lit(centre.n).cast("bigint").alias("n"),
            "deviation",
            "whitened",
            shares[F.col("pos")].alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
