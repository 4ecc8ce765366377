import numpy as np
import pytest
from pyspark.sql import functions as F
from small import audio, items, names, tracks

from moodloom.operators import kmeans, knn, mixture, models
from moodloom.operators.knn import knn_join
from moodloom.plans.pipeline import analyze


def points(spark, data):
    """data: {playlist: matrix}"""
    rows = [(p, i, i, [float(v) for v in x]) for p, m in data.items() for i, x in enumerate(m)]
    return spark.createDataFrame(rows, "playlist_id string, track_id bigint, pos bigint, vec array<double>")


def blobs(seed, k, each, d=4, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, d)) * 3
    return np.concatenate([c + rng.normal(size=(each, d)) * spread for c in centers])


def test_finds_the_planted_clusters(spark):
    data = {"four": blobs(1, 4, 30), "six": blobs(2, 6, 25)}
    got = kmeans.cluster(points(spark, data), restarts=6).toPandas()
    for name, k, each in (("four", 4, 30), ("six", 6, 25)):
        part = got[got.playlist_id == name].sort_values("track_id")
        assert part.cluster_id.nunique() == k
        assert all(len(set(part.cluster_id[i * each : (i + 1) * each])) == 1 for i in range(k))


@pytest.mark.parametrize("n, k", [(1, 1), (2, 2), (3, 3)])
def test_tiny_playlists(spark, n, k):
    got = kmeans.cluster(points(spark, {"p": np.eye(4)[:n]})).toPandas()
    assert got.cluster_id.nunique() == k


def test_identical_vectors(spark):
    got = kmeans.cluster(points(spark, {"p": np.ones((6, 3))})).toPandas()
    assert len(got) == 6 and got.cluster_id.nunique() == 1


def test_many_blocks_give_the_same_as_one(spark, monkeypatch):
    v = points(spark, {"p": blobs(5, 3, 200)})
    seed_free = lambda: kmeans.search(v, 3, 3, restarts=1, max_iter=10)[0]
    one = {r.track_id: r.labels[0].cluster_id for r in seed_free().collect()}
    monkeypatch.setattr(kmeans.pack, "__defaults__", (37,))
    many = {r.track_id: r.labels[0].cluster_id for r in seed_free().collect()}
    assert one == many


def plain_kmeans(x, k, rng, rounds=10):
    """Inertia after plain k-means++ and Lloyd rounds."""
    c = [x[rng.integers(len(x))]]
    while len(c) < k:
        d = ((x[:, None] - np.array(c)[None]) ** 2).sum(2).min(1)
        c.append(x[rng.choice(len(x), p=d / d.sum())])
    c = np.array(c)
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
    return ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_oversampled_seeds_are_as_good_as_plain_ones(spark, monkeypatch):
    """k-means|| from many blocks: no worse than plain k-means++, and the same in every run."""
    monkeypatch.setattr(kmeans.pack, "__defaults__", (64,))
    rng = np.random.default_rng(21)
    sizes = [400, 200, 100, 60, 30, 20, 10, 5]  # small far groups are what random starts miss
    data = {
        name: np.concatenate([rng.normal(size=5) * 20 + rng.normal(size=(n, 5)) for n in sizes]) for name in ("p", "q")
    }
    v = points(spark, data)

    def run(init):
        _, best, _ = kmeans.fit(v, 8, 8, restarts=2, max_iter=10, init=init)
        return {r.playlist_id: np.array([c.center for c in r.cents]) for r in best.collect()}

    got, again, hashed = run("parallel"), run("parallel"), run("hash")
    inertia = lambda x, c: ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    for name, x in data.items():
        assert np.array_equal(got[name], again[name]) and len(got[name]) == 8
        plain = np.mean([plain_kmeans(x, 8, np.random.default_rng(i)) for i in range(12)])
        assert inertia(x, got[name]) <= plain and inertia(x, got[name]) <= inertia(x, hashed[name]) * 1.001


def test_drawn_rows_follow_the_distance(spark):
    """Every far group is drawn from; copies of a vector are one centre."""
    x = np.concatenate([np.zeros((500, 2)), [[10.0, 0]] * 3, [[0, 10.0]] * 3, [[-10.0, -10.0]]])
    blocks = kmeans.pack(points(spark, {"p": x}))
    cand = kmeans.candidates(blocks, 4, 8)
    got = kmeans.parallel_seeds(blocks, cand, 3).where("k = 8").collect()
    for turn in range(3):
        assert {tuple(r.center) for r in got if r.restart == turn} == {(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (-10.0, -10.0)}


def test_block_silhouette_is_the_silhouette_of_its_labels(spark, monkeypatch):
    monkeypatch.setattr(kmeans.pack, "__defaults__", (16,))
    v = points(spark, {"p": blobs(7, 3, 40, spread=1.5), "q": blobs(8, 5, 20, spread=1.0), "r": np.eye(2)})
    blocks, best, cand = kmeans.fit(v, 3, 6, restarts=1, max_iter=5)
    labelled = kmeans.label(blocks, best, keep_vec=True)
    rows = {(r.playlist_id, r.k): r.score for r in kmeans.silhouette(labelled, cand).collect()}
    assert {(r.playlist_id, r.k): pytest.approx(r.score) for r in kmeans.block_silhouette(blocks, best).collect()} == rows


def brute_silhouette(x, labels, power=1):
    d = np.linalg.norm(x[:, None] - x[None], axis=2) ** power
    out = []
    for i in range(len(x)):
        same = labels == labels[i]
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_both_ways(spark):
    x = blobs(7, 3, 12, spread=1.0)
    labels = np.array([0] * 10 + [1] * 15 + [2] * 10 + [3])
    rows = [("p", i, i, [float(v) for v in x[i]], [(4, int(labels[i]))]) for i in range(len(x))]
    frame = spark.createDataFrame(
        rows, "playlist_id string, track_id int, pos int, vec array<double>, labels array<struct<k: int, cluster_id: int>>"
    )
    sizes = spark.createDataFrame([("p", len(x))], "playlist_id string, n bigint")
    exact = kmeans.silhouette(frame, sizes, "euclidean").first().score
    squared = kmeans.silhouette(frame, sizes, "squared").first().score
    default = kmeans.silhouette(frame, sizes).first().score
    assert exact == pytest.approx(brute_silhouette(x, labels))
    assert squared == pytest.approx(brute_silhouette(x, labels, 2))
    assert default == pytest.approx(squared)


def test_silhouette_in_blocks(spark):
    """A playlist of many blocks scores as in one group, for every k, and no row holds more than two blocks."""
    x = blobs(5, 3, 40, spread=1.0)
    labels = np.array([0] * 50 + [1] * 49 + [2] * 20 + [3])
    pairs = [[(2, int(i % 2)), (4, int(labels[i]))] for i in range(120)]
    rows = [(p, i, i, [float(v) for v in x[i]], pairs[i]) for i in range(120) for p in ("p", "q")]
    rows += [("one", i, i, [float(i), 0.0, 1.0], [(2, 0), (4, i)]) for i in range(4)]
    frame = spark.createDataFrame(
        rows, "playlist_id string, track_id int, pos int, vec array<double>, labels array<struct<k: int, cluster_id: int>>"
    )
    met = kmeans.block_pairs(frame, 16).select(F.size("rows").alias("n"), F.size("refs").alias("m")).toPandas()
    assert met.n.max() < 60 and met.m.max() < 60 and (met.n * met.m).sum() == 2 * 120 * 120
    got = {(r.playlist_id, r.k): r.score for r in kmeans.silhouette_exact(frame, 16).collect()}
    want = {2: brute_silhouette(x, np.arange(120) % 2), 4: brute_silhouette(x, labels)}
    assert got == {(p, k): pytest.approx(want[k]) for p in ("p", "q") for k in (2, 4)}


def test_duplicate_playlist_has_equal_moods(spark):
    rng = np.random.default_rng(4)
    rows = [
        (f"t{i:02d}", audio(energy=float(rng.random()), valence=float(rng.random()), tempo=float(60 + 100 * rng.random())), [("tag%d" % (i % 4), 60)])
        for i in range(30)
    ]
    ids = [r[0] for r in rows]
    a = analyze(names(spark, ["p", "q"]), items(spark, {"p": ids, "q": ids}), tracks(spark, rows))
    got = a.distribution.toPandas()
    p, q = (got[got.playlist_id == n].drop(columns="playlist_id").sort_values("rank").values.tolist() for n in "pq")
    assert p == q
    total = a.distribution.groupBy("playlist_id").agg(F.sum("proportion").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in total)


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    cat = np.round(rng.normal(size=(3000, 9)), 1)
    cat[100:200] = cat[:100]
    ask = rng.normal(size=(60, 9))
    part = np.arange(60) % 3
    member = {(p, t) for p in range(3) for t in rng.choice(3000, 400, replace=False).tolist()}
    catalog = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cat)], "track_id bigint, vec array<double>")
    queries = spark.createDataFrame(
        [("p", int(part[i]), i, ask[i].tolist()) for i in range(60)], "playlist_id string, part int, qid int, vec array<double>"
    )
    members = spark.createDataFrame([("p", p, t) for p, t in member], "playlist_id string, part int, track_id bigint")
    got = {}
    for r in knn_join(queries, catalog, members, 7).collect():
        got.setdefault(r.qid, {})[r.rn] = r.track_id
    for i in range(60):
        d = np.round(np.sqrt(((cat - ask[i]) ** 2).sum(1)), 9)
        order = [t for t in np.lexsort((np.arange(3000), d)) if (int(part[i]), int(t)) not in member][:7]
        assert [got[i][j + 1] for j in range(7)] == order


def test_second_pass_visits_few_cells(spark):
    """On clustered data the second pass looks at a small part of the catalog, and misses nothing."""
    rng = np.random.default_rng(12)
    centers = rng.normal(size=(40, 9)) * 6
    cat = centers[rng.integers(0, 40, 12_000)] + rng.normal(size=(12_000, 9)) * 0.4
    cat[:1500] = cat[0]  # one vector many times: more than a block
    ask = centers[rng.integers(0, 40, 200)] + rng.normal(size=(200, 9)) * 0.4
    ask[0] = cat[0]
    catalog = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cat)], "track_id bigint, vec array<double>")
    queries = spark.createDataFrame(
        [("p", 0, i, v.tolist()) for i, v in enumerate(ask)], "playlist_id string, part int, qid int, vec array<double>"
    )
    members = spark.createDataFrame([("p", 0, t) for t in range(5)], "playlist_id string, part int, track_id bigint")
    index = knn.Index(catalog)
    got = {}
    for r in index.nearest(queries, members, 10).collect():
        got.setdefault(r.qid, {})[r.rn] = r.track_id
    for i in range(200):
        d = np.round(np.sqrt(((cat - ask[i]) ** 2).sum(1)), 9)
        order = [t for t in np.lexsort((np.arange(12_000), d)) if t >= 5][:10]
        assert [got[i][j + 1] for j in range(10)] == order
    assert index.visited_share() < 1 / 3
    assert index.fines.selectExpr("sum(size(cells))").first()[0] > len(index.pivots)


def shrunk(x):
    """Ledoit and Wolf's covariance of standardised rows, by its definition, and the intensity."""
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    n, d = z.shape
    s = z.T @ z / n
    m = np.trace(s) / d
    spread = ((s - m * np.eye(d)) ** 2).sum() / d
    noise = sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / n**2 / d
    share = min(noise, spread) / spread if spread > 0 else 0.0
    return z, (1 - share) * s + share * m * np.eye(d), share


def test_mahalanobis(spark):
    rng = np.random.default_rng(9)
    data = {
        "p": rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)) * [1, 50, 0.01] + 7,
        "few": rng.normal(size=(3, 3)),
        "flat": np.c_[rng.normal(size=(40, 2)), np.full(40, 5.0)],
        "equal": np.full((6, 3), 2.5),
    }
    rows = [(p, i, *map(float, v)) for p, x in data.items() for i, v in enumerate(x)] + [("p", 999, 1.0, None, 2.0)]
    frame = spark.createDataFrame(rows, "playlist_id string, track_id int, a double, b double, c double")
    got = {(r.playlist_id, r.track_id): r for r in models.mahalanobis(frame, ["a", "b", "c"], 11.345).collect()}
    shares = {r.playlist_id: r.shrinkage for r in models.shrunk_covariances(frame, ["a", "b", "c"]).collect()}
    assert len(got) == len(rows) - 1
    for p, x in data.items():
        z, cov, share = shrunk(x)
        assert shares[p] == pytest.approx(share, abs=1e-9)
        want = np.sqrt(np.einsum("ij,jk,ik->i", z, np.linalg.pinv(cov), z))
        assert [got[p, i].score for i in range(len(x))] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-9)
        assert all(got[p, i].flagged == (got[p, i].score ** 2 > 11.345) for i in range(len(x)))


def test_projection_keeps_the_variance(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 4)) @ rng.normal(size=(4, 4))
    cols = list("abcd")
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "track_id int, " + ", ".join(f"{c} double" for c in cols))
    got = models.project(frame, cols).toPandas()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    top = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1][:2]
    assert [got.x.var(), got.y.var()] == pytest.approx(top.tolist(), rel=1e-6)


def test_mixture_prefers_two_components(spark, monkeypatch):
    monkeypatch.setattr(kmeans.pack, "__defaults__", (64,))
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(8, 1, (150, 2)) * [1, 2]])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(999, 1.0, None)]
    frame = spark.createDataFrame(rows, "track_id int, a double, b double")
    labelled, sizes, found = mixture.gaussian_mixture(frame, ["a", "b"], k_max=3, restarts=2, max_iter=30)
    bics = {k: m.bic(300) for k, m in found.items()}
    assert min(bics, key=bics.get) == 2
    assert sorted(r["size"] for r in sizes.collect()) == [150, 150]
    cov = np.cov(x.T, bias=True) + 1e-4 * np.eye(2)
    mid = x - x.mean(0)
    ll = -0.5 * (300 * (2 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1]) + np.einsum("ij,jk,ik->", mid, np.linalg.inv(cov), mid))
    assert bics[1] == pytest.approx(5 * np.log(300) - 2 * ll)
    for m in found.values():  # never falls
        assert all(b >= a - 1e-6 * abs(a) for a, b in zip(m.steps, m.steps[1:]))
    # The covariances are those of the groups, and every row belongs somewhere.
    best = found[2]
    near = best.means[:, 0].argsort()
    assert best.covariances[near[0]] == pytest.approx(np.cov(x[:150].T, bias=True) + 1e-4 * np.eye(2), abs=1e-3)
    got = labelled.collect()
    assert len(got) == 300 and all(sum(r.probability) == pytest.approx(1.0) for r in got)


def test_mixture_of_equal_rows_and_of_none(spark):
    """What has no regular covariance has one with the amount on its diagonal."""
    frame = spark.createDataFrame([(i, 1.0, 2.0) for i in range(5)], "track_id int, a double, b double")
    labelled, sizes, found = mixture.gaussian_mixture(frame, ["a", "b"], k_max=3, restarts=1)
    assert sizes.agg(F.sum("size")).first()[0] == 5 and found[1].covariances[0] == pytest.approx(1e-4 * np.eye(2))
    labelled, sizes, found = mixture.gaussian_mixture(frame.limit(0), ["a", "b"])
    assert labelled.count() == 0 and sizes.count() == 0 and not found


def test_roc_auc_two_ways(spark):
    rng = np.random.default_rng(2)
    rows = [("p", f"t{i}", i, float(np.round(rng.random(), 1)), int(rng.random() < 0.4)) for i in range(80)]
    frame = spark.createDataFrame(rows, "playlist_id string, track_id string, pos int, anomaly_score double, label int")
    from moodloom.operators.analysis import average_ranks

    ranked = average_ranks(frame)
    pos = [r[3] for r in rows if r[4]]
    neg = [r[3] for r in rows if not r[4]]
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert models.roc_auc_by_playlist(ranked).first().auc == pytest.approx(want)
    assert models.roc_auc(ranked) == pytest.approx(want)


def test_silhouette_of_dealt_rows_equals_the_one_of_all_pairs(spark):
    """Playlists that lie together are scored there; long, hot, odd ones as before."""
    rng = np.random.default_rng(5)
    rows = []
    for p, n, salt in [("a", 30, 0), ("long", 90, 0), ("hot", 40, 1), ("one", 12, 0), ("each", 6, 0), ("odd", 20, 0)]:
        for t in range(n):
            c = {"one": 0, "each": t}.get(p, t % 4)
            c = None if p == "odd" and t % 5 == 0 else 7 if p == "a" and t == 0 else c
            place = 0 if not salt else 1 + t % 3
            rows.append((p, place, t, rng.normal(size=3).tolist(), [(3, c), (4, t % 2)]))
    kind = "playlist_id string, _salt long, track_id long, vec array<double>, labels array<struct<k: int, cluster_id: int>>"
    frame = spark.createDataFrame(rows, kind)
    want = {(r[0], r[1]): r[2] for r in kmeans.silhouette_exact(frame.drop("_salt"), 50).collect()}
    got = {(r[0], r[1]): r[2] for r in kmeans.silhouette_exact(frame, 50).collect()}
    assert set(got) == set(want) and ("one", 3) not in want and ("each", 3) not in want
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    scores, rest = kmeans.silhouette_together(frame, 50)
    assert {r.playlist_id for r in scores.collect()} == {"a", "one", "each", "odd"}
    assert {r.playlist_id for r in rest.select("playlist_id").distinct().collect()} == {"long", "hot"}


def test_equal_vectors_beyond_the_kth_do_not_travel(spark):
    rng = np.random.default_rng(5)
    vectors = np.repeat(rng.normal(size=(4, 3)), 600, axis=0)
    catalog = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(vectors)], "track_id bigint, vec array<double>")
    queries = spark.createDataFrame(
        [("p", 0, q, [float(v) for v in vectors[q * 600]]) for q in range(4)], "playlist_id string, part int, qid int, vec array<double>"
    )
    # A tenth of all tracks, spread over all vectors.
    members = spark.createDataFrame([("p", 0, i) for i in range(0, 2400, 10)], "playlist_id string, part int, track_id bigint")
    index = knn.Index(catalog)
    got = {(r.qid, r.rn): r.track_id for r in index.nearest(queries, members, 3).collect()}
    assert got == {(q, n): q * 600 + n for q in range(4) for n in (1, 2, 3)}
    # The member 0 and the three nearest of each query; 240 and more before.
    assert index._meet(index.routed).count() <= 4 * 4


def test_boxes_leave_out_cells_that_balls_reach(spark):
    rng = np.random.default_rng(6)
    # Long thin cells: far from round.
    vectors = rng.normal(size=(6000, 4)) * [20, 0.1, 0.1, 0.1]
    vectors[:, 1:] += rng.integers(0, 3, size=(6000, 3)) * 5
    catalog = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(vectors)], "track_id bigint, vec array<double>")
    ask = rng.choice(6000, 40, replace=False)
    queries = spark.createDataFrame(
        [("p", 0, int(q), [float(v) for v in vectors[q] + 0.01]) for q in ask], "playlist_id string, part int, qid int, vec array<double>"
    )
    members = spark.createDataFrame([("p", 0, int(q)) for q in ask], "playlist_id string, part int, track_id bigint")
    index = knn.Index(catalog)
    got = {}
    for r in index.nearest(queries, members, 5).orderBy("qid", "rn").collect():
        got.setdefault(r.qid, []).append(r.track_id)
    out = set(ask.tolist())
    for q in ask.tolist():
        d = np.round(np.sqrt(((vectors - vectors[q] - 0.01) ** 2).sum(1)), 9)
        assert got[q] == [int(i) for i in np.lexsort((np.arange(6000), d)) if int(i) not in out][:5]
    assert index.visited_share() < 0.12


def test_places_of_ids_with_nulls():
    import pyarrow as pa

    ids = pa.array([None, "a", "c"], pa.string())
    assert knn._up_to(ids, pa.array([None, "a", "b", "d"], pa.string())).tolist() == [1, 2, 2, 3]


def test_members_are_left_out_by_asking_again(spark, monkeypatch):
    """Short queries ask for more, hot playlists are dealt out, and a small catalog runs out."""
    monkeypatch.setattr(knn, "ASKS", 4)
    rng = np.random.default_rng(21)
    cat = np.round(rng.normal(size=(300, 3)), 1)
    catalog = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cat)], "track_id bigint, vec array<double>")
    ask = rng.normal(size=(40, 3))
    who = ["hot"] * 36 + ["all", "all", "few", "few"]
    near = {int(t) for t in ((cat - ask[38]) ** 2).sum(1).argsort()[:60]}
    member = {("hot", int(t)) for t in rng.choice(300, 40, replace=False)} | {("all", t) for t in range(298)} | {("few", t) for t in near}
    queries = spark.createDataFrame([(who[i], 0, i, ask[i].tolist()) for i in range(40)], "playlist_id string, part int, qid int, vec array<double>")
    members = spark.createDataFrame([(p, 0, t) for p, t in member], "playlist_id string, part int, track_id bigint")
    got = {}
    for r in knn_join(queries, knn.Index(catalog, fine=16), members, 3).collect():
        got.setdefault(r.qid, {})[r.rn] = r.track_id
    for i in range(40):
        d = np.round(np.sqrt(((cat - ask[i]) ** 2).sum(1)), 9)
        order = [int(t) for t in np.lexsort((np.arange(300), d)) if (who[i], int(t)) not in member][:3]
        assert [got[i][j + 1] for j in range(len(got[i]))] == order


def test_what_is_found_moves_once(spark):
    """Rows of a search go to their playlists and stay there; queries with their vectors move to cells only."""
    rng = np.random.default_rng(22)
    catalog = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(500, 3)))], "track_id bigint, vec array<double>")
    queries = spark.createDataFrame([(f"p{i % 9}", 0, i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 3)))], "playlist_id string, part int, qid int, vec array<double>")
    members = spark.createDataFrame([(f"p{i % 9}", 0, i) for i in range(90)], "playlist_id string, part int, track_id bigint")
    index = knn.Index(catalog)
    asked, seen = [], knn.Index.search
    index.search = lambda q, n: asked.append(n) or seen(index, q, n)
    got = index.nearest(queries, members, 4)
    assert got.count() == 360 and asked[0] == 5
    assert index._meet(index.routed).count() < 90 * 5 * 3
