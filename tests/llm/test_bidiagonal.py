"""Whitening against a dense eigendecomposition of the same fit list."""

import numpy as np
import pytest
from moodloom.llm import bidiagonal

KIND = "vec_id bigint, embedding array<double>, label int, x int, dim string, component int"


def brute(rows, wanted=16):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of rows of one length."""
    ids = [d for d, _ in rows]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in e] for _, e in rows], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(fit), fit.sum(0)
    centred = lambda m: ((n * m - s).astype(float)) / n
    v = centred(fit).T @ centred(fit) / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1], c[:, ::-1]
    out = {}
    for d, r in zip(ids, x):
        dev = int(((n * r - s) ** 2).sum())
        y = centred(r) @ c
        for k in range(min(wanted, len(e))):
            if e[k] > 1e-12 * e[0]:
                out.setdefault((d, k + 1), []).append((n, dev, y[k] / np.sqrt(e[k]), e[k] / e.sum()))
    return out


def compare(got, want):
    found = {}
    for r in got:
        found.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert found.keys() == want.keys()
    ks = {k for _, k in want}
    # One sign a component for all rows.
    sign = {}
    for (_, k), w in want.items():
        sign.setdefault(k, []).append((w[0][2], found[_, k][0]["whitened"]))
    sign = {k: np.sign(sum(a * b for a, b in sign[k])) for k in ks}
    for key, w in want.items():
        g = sorted((r["n"], r["deviation"], sign[key[1]] * r["whitened"], r["explained"]) for r in found[key])
        assert len(g) == len(w)
        for a, b in zip(g, sorted(w)):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-8) and a[3] == pytest.approx(b[3], rel=1e-9)
    assert len({r["identity_error"] for r in got}) <= 1 and all(r["identity_error"] <= 1e-8 for r in got)


def frame(spark, rows):
    return spark.createDataFrame([(d, e, 1, 2, "d", 3) for d, e in rows], KIND).repartition(4)


@pytest.mark.parametrize("spread", ["wide", "flat"])
def test_against_eigh(spark, monkeypatch, spread):
    monkeypatch.setattr(bidiagonal, "BLOCK_BYTES", 20_000)
    rng = np.random.default_rng(3)
    scale = np.geomspace(30, 0.05, 24) if spread == "wide" else np.linspace(1, 1.3, 24)
    turn = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    x = (rng.standard_normal((700, 24)) * scale) @ turn + 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [1.0] * 23 + [None]), (902, [1.0] * 23 + [float("nan")]), (903, [float("inf")] * 24), (904, [])]
    again = [rows[0], (905, rows[1][1]), (None, rows[2][1])]
    got = bidiagonal.whiten(frame(spark, rows + odd + again)).collect()
    assert len(got) == 703 * 16
    compare([r for r in got if r["vec_id"] is not None], {k: v for k, v in brute(rows + again).items() if k[0] is not None})


def test_lengths_apart_low_rank_and_repeated_eigenvalues(spark):
    rng = np.random.default_rng(4)
    thin = rng.integers(-9, 9, (40, 2)) @ rng.integers(-3, 3, (2, 6))
    rows = [(i, (v / 64).tolist()) for i, v in enumerate(thin)]
    corners = [(100 + i, e.tolist()) for i, e in enumerate(np.r_[np.eye(5), -np.eye(5)])]
    lone = [(200, [1.0] * 7), (201, [1.0] * 7)]
    got = bidiagonal.whiten(frame(spark, rows + corners + lone)).collect()
    compare([r for r in got if r["vec_id"] < 100], brute(rows))
    fives = [r for r in got if 100 <= r["vec_id"] < 200]
    assert len(fives) == 50 and all(r["explained"] == pytest.approx(0.2) for r in fives)
    y = np.zeros((10, 5))
    for r in fives:
        y[r["vec_id"] - 100, r["component"] - 1] = r["whitened"]
    assert np.abs(y.T @ y / 10 - np.eye(5)).max() < 1e-9 and not [r for r in got if r["vec_id"] >= 200]


def test_large_numbers_and_empty_table(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])]
    got = bidiagonal.whiten(frame(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and all(r["deviation"] is None for r in got if r["vec_id"] < 3)
    assert bidiagonal.whiten(frame(spark, rows).limit(0)).count() == 0


def test_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(bidiagonal, "BLOCK_BYTES", 200)
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((120, 4)))]
    first = bidiagonal.whiten(frame(spark, rows)).collect()
    monkeypatch.setattr(bidiagonal, "FAN", 1)
    compare(bidiagonal.whiten(frame(spark, rows)).collect(), brute(rows))
    compare(first, brute(rows))
