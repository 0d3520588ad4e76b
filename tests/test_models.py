"""Grids of models, linkage, silhouettes, stored models, swaps and reconciliation, beside plain versions."""

import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.operators import batch_kmeans as B
from tallywork.operators import cluster_metrics, cube, model_store, reconcile, segments
from tallywork.plans import catalog, extracts
from tallywork.sources.store import Store

NAMES = ("a", "b", "c")


def blobs(n=300, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 4, (4, 3))
    return np.round(middle[rng.integers(0, 4, n)] + rng.normal(0, 1, (n, 3)), 6)


def frame(spark, x, label=None):
    rows = [(f"C{i}", *map(float, r), 0 if label is None else int(label[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "customer_id string, a double, b double, c double, label int").repartition(5)


def plain_lloyd(x, centers, steps):
    for step in range(steps + 1):
        label = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        moved = np.array([x[label == j].mean(0) if (label == j).any() else centers[j] for j in range(len(centers))])
        if step == steps or ((moved - centers) ** 2).sum() <= B.TOLERANCE:
            return label, centers
        centers = moved


def test_batch_fits_equal_plain_ones(spark):
    """Two populations of other sizes and features, several k and starts, all in the same passes."""
    x, y = blobs(), blobs(90, 8)[:, :2]
    points, width = B.stacked([(frame(spark, x), NAMES), (frame(spark, np.c_[y, y[:, :1]]), NAMES[:2])])
    wanted = [(p, k, s, start) for p in (0, 1) for k in (2, 3, 5) for s in (1, 2) for start in (0, 1)]
    models = B.fit(points, width, wanted)
    samples = {p: B._sample(points, p, width) for p in (0, 1)}
    for m in models:
        whole = x if m.population == 0 else np.c_[y, np.zeros(len(y))]
        first = B.first_centers(samples[m.population], m.k, np.random.default_rng([m.seed, m.start, m.k, m.population]))
        label, centers = plain_lloyd(whole, first, B.MAX_STEPS)
        assert np.allclose(m.centers, centers, atol=1e-6)
        assert m.n.tolist() == np.bincount(label, minlength=m.k).tolist()
        assert m.cost == pytest.approx(((whole - centers[label]) ** 2).sum(), rel=1e-6)
        assert m.squares.sum() == pytest.approx((whole ** 2).sum(), rel=1e-6)


def test_labels_of_many_models_add_up_exactly():
    """All models of one k in two products: the same integers as one by one, ties to the first centre, at one core's cost."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 3, (700, 3)))  # on a lattice, so some points are equally near to two centres
    centers = [x[rng.choice(len(x), 4)] for _ in range(9)] + [np.repeat(x[:1], 4, 0)]
    added = np.column_stack([np.ones(len(x)), np.rint((x * x).sum(1) * 2.0 ** 30), np.rint(x * 2.0 ** 30)])
    (_, k, weights), = B._together([B.Model(0, 4, 1, i, c) for i, c in enumerate(centers)])
    totals, costs = np.zeros((len(weights), 5), np.int64), np.zeros(10, np.int64)
    B.adder(2.0 ** 30, 200)(x, added, k, weights, totals, costs)
    for i, own in enumerate(centers):
        assert costs[i] == ((x[:, None] - own[None]) ** 2).sum(2).min(1).sum() * 2 ** 30
        label = ((own * own).sum(1) - 2 * x @ own.T).argmin(1)
        assert totals[i::10].tolist() == [added[label == j].sum(0).astype(int).tolist() for j in range(4)]


def test_grid_measures(spark):
    x = blobs()
    points, width = B.stacked([(frame(spark, x), NAMES)])
    rows = B.grid(points, width, ["all"], (3, 4), 42, (1, 2), 2)
    found = B.best_of(B.fit(points, width, [(0, k, s, t) for k in (3, 4) for s in (42, 1, 2) for t in (0, 1)]))
    for row in rows:
        label = {s: ((x[:, None] - found[0, row["k"], s].centers[None]) ** 2).sum(2).argmin(1) for s in (42, 1, 2)}
        shown = frame(spark, x, label[42])
        one = cluster_metrics.scatter(shown, NAMES).first()
        assert row["calinski_harabasz"] == pytest.approx(one.calinski_harabasz, rel=1e-6)
        assert row["min_cluster_share"] == pytest.approx(one.min_cluster_share)
        mean = cluster_metrics.silhouette(shown, NAMES).agg(F.avg("silhouette")).first()[0]
        assert row["silhouette"] == pytest.approx(mean, abs=1e-6)
        pairs = [spark.createDataFrame(list(zip(label[42].tolist(), label[s].tolist())), "p int, q int") for s in (1, 2)]
        rand = [cluster_metrics.adjusted_rand(df, "p", "q").first()[0] for df in pairs]
        assert row["ari_min"] == pytest.approx(min(rand)) and row["ari_mean"] == pytest.approx(sum(rand) / 2)


def plain_ward(n, sums, k):
    groups = [[i] for i in range(len(n))]
    heights, at_k = [], None

    def growth(a, b):
        na, nb = sum(n[i] for i in a), sum(n[i] for i in b)
        ma, mb = sum(sums[i] for i in a) / na, sum(sums[i] for i in b) / nb
        return na * nb / (na + nb) * ((ma - mb) ** 2).sum()

    while len(groups) > 1:
        if len(groups) == k:
            at_k = [list(g) for g in groups]
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: growth(groups[p[0]], groups[p[1]]))
        heights.append(growth(groups[a], groups[b]))
        groups[a] = groups[a] + groups[b]
        del groups[b]
    return at_k or groups, heights


@pytest.mark.parametrize("k", [1, 4, 9])
def test_ward_equals_plain_linkage(k):
    rng = np.random.default_rng(6)
    n = rng.integers(1, 9, 40)
    sums = rng.normal(0, 3, (40, 3)) * n[:, None]
    group, heights = B.ward(n, sums, k)
    expected, plain = plain_ward(n, sums, k)
    assert heights == pytest.approx(plain)
    assert {frozenset(np.flatnonzero(group == g).tolist()) for g in set(group.tolist())} == {frozenset(g) for g in expected}


def test_linkage_of_single_rows(spark):
    """With a micro-cluster for every row the labels are Ward's on the rows."""
    x = blobs(60)
    scaled = frame(spark, x)
    linkage = B.ward_linkage(scaled, NAMES, 4, 1, micro=60, steps=0)
    assert len(linkage.micro.n) == 60 and linkage.within_micro == pytest.approx(0, abs=1e-4)
    expected, _ = plain_ward(np.ones(60), x, 4)
    got = {}
    for r in B.linked_labels(scaled, NAMES, linkage).collect():
        got.setdefault(r.other, set()).add(int(r.customer_id[1:]))
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in expected}


def plain_silhouettes(x, label):
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, g in enumerate(label):
        own = label == g
        others = [apart[i][label == h].mean() for h in set(label.tolist()) - {g}]
        if own.sum() < 2 or not others:
            out.append(0.0)
            continue
        a, b = apart[i][own].sum() / (own.sum() - 1), min(others)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return out


@pytest.mark.parametrize("landmarks", [5, 40, 1024])
def test_plain_silhouette_is_bounded(spark, landmarks):
    x = np.concatenate([blobs(), [[50.0, 50, 50]], np.repeat([[1.0, 2, 3]], 8, 0)])
    label = np.concatenate([blobs()[:, 0] > 0, [2], [3] * 8]).astype(int)
    expected = plain_silhouettes(x, label)
    got = {int(r.customer_id[1:]): r for r in B.plain_silhouette(frame(spark, x, label), NAMES, landmarks).collect()}
    assert len(got) == len(x)
    for i, e in enumerate(expected):
        assert got[i].low - 1e-6 <= e <= got[i].high + 1e-6 and got[i].low - 1e-9 <= got[i].silhouette <= got[i].high + 1e-9
        if landmarks == 1024:
            assert got[i].silhouette == pytest.approx(e, abs=1e-9) and got[i].low == pytest.approx(got[i].high)
    if landmarks == 40:
        assert np.mean([abs(got[i].silhouette - e) for i, e in enumerate(expected)]) < 0.05


def test_one_cluster_has_no_silhouette(spark):
    assert {r.silhouette for r in B.plain_silhouette(frame(spark, blobs(20)), NAMES).collect()} == {0.0}


@pytest.fixture(scope="module")
def w(spark):
    return catalog.workspace(spark, "/root/testdata/sf0.001")


def test_stored_model_gives_the_same_segments(spark, w, tmp_path):
    config = {**w.segment_config, "design": "layered", "k": {"S": 3, "R": 3}}
    plans = [(w.segment_config, w.customer_segment, w.segment_fits, w.scaled_features)]
    centers = {p: [tuple(c) for c in np.random.default_rng(1).normal(0, 1, (3, 5)).tolist()] for p in "SR"}
    rows, fits, scaled = segments.segment(w.store, w.customer_360, config, w.segment_definition, w.params, centers)
    plans.append((config, rows.df, fits, scaled))
    path = str(tmp_path / "models")
    assert model_store.versions(spark, path) == []
    for version, (config, table, fits, scaled) in zip("12", plans):
        model_store.save(spark, model_store.of_fits(version, config, fits, scaled, table), path)
        model = model_store.load(spark, path)
        assert model.version == version and model == model_store.load(spark, path, version)
        pick = lambda df: Counter(map(tuple, df.select("customer_id", "cluster_key", "segment_id", "segment_name").collect()))
        assert pick(model_store.apply(model, w.customer_360)) == pick(table)
    assert model_store.versions(spark, path) == ["1", "2"] and model_store.load(spark, path, "1").design == "joint"
    with pytest.raises(ValueError):
        model_store.save(spark, model, path)
    with pytest.raises(ValueError):
        model_store.load(spark, path, "3")


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    assert extracts.write_table(spark.range(5), path) == 5
    broken = spark.range(1000).repartition(4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("stop")).cast("bigint")).otherwise(
        F.col("id")).alias("id"))
    with pytest.raises(Exception):
        extracts.write_table(broken, path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["table"]
    old = spark.read.parquet(path)
    assert extracts.write_table(old.selectExpr("id * 2 AS id"), path) == 5  # a table may be written from its own rows
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 4, 6, 8] and os.listdir(tmp_path) == ["table"]


def test_planted_errors_are_found(spark, w):
    right = cube.customer_cells(w.view, w.top_cities)
    rows = [r.asDict() for r in w.cube.collect()]
    statuses = lambda table: Counter(r.status for r in reconcile.compare_cells(
        cube.cube_cells(table), right, cube.CELL_MEASURES).collect())
    assert set(statuses(w.cube)) == {"PASS"}
    at = random.Random(1).randrange(len(rows))
    wrong = [dict(r, value=r["value"] + 1.0) if i == at else r for i, r in enumerate(rows)]
    table = spark.createDataFrame(wrong, w.cube.schema)
    assert statuses(table)["CHECK"] == 2 + len(cube.DIMENSIONS)  # the total, its value of each dimension, its own cell
    assert {r.status for r in reconcile.compare_grains(cube.cube_cells(table), right, cube.CELL_MEASURES).collect()} == {"CHECK"}
    short = spark.createDataFrame(rows[:at] + rows[at + 1:], w.cube.schema)
    assert statuses(short)["MISSING"] >= 1
