"""K-Means fits whose starts share their passes."""

import numpy as np
import pytest

from tallywork.operators import batch_kmeans as B
from tallywork.operators import segments

NAMES = ("a", "b", "c")


def points(n=400, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 4, (4, 3))
    return np.round(middle[rng.integers(0, 4, n)] + rng.normal(0, 1, (n, 3)), 6)


def frame(spark, x, parts=5):
    return spark.createDataFrame([(f"C{i}", *map(float, r)) for i, r in enumerate(x)], "customer_id string, a double, b double, c double").repartition(parts)


def lloyd(x, centers):
    for _ in range(B.MAX_STEPS):
        label = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        moved = np.array([x[label == j].mean(0) if (label == j).any() else centers[j] for j in range(len(centers))])
        if ((moved - centers) ** 2).sum(1).max() <= B.TOLERANCE ** 2:
            break
        centers = moved
    return centers, ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum()


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_fit_is_the_best_plain_one(spark):
    x = points()
    stacked, width = B.stacked([(frame(spark, x), NAMES)])
    first = B.drawn_centers(stacked, width, 4, 42, 3)
    plain = min((lloyd(x, centers) for centers in first), key=lambda f: f[1])
    got = np.array(segments.fit_kmeans(frame(spark, x, 2), NAMES, 4, 42, 3))  # dealt otherwise
    assert np.allclose(got, plain[0], atol=1e-6)
    assert B.best_centers(stacked, width, 4, 42, 3).cost == pytest.approx(plain[1], rel=1e-6)


def test_starts_share_their_passes(spark):
    """Before, every start ran its own jobs over cached rows."""
    rows, width = frame(spark, points(120), 2), 3
    stacked, _ = B.stacked([(rows, NAMES)])
    most = max(jobs_of(spark, f"one {s}", lambda s=s: B._settled(
        stacked, width, [B.Model(0, 3, 7, s, c) for c in [B.drawn_centers(stacked, width, 3, 7, s + 1)[s]]], B.MAX_STEPS,
        lambda moves: moves.max() <= B.TOLERANCE ** 2)) for s in (0, 5))
    together = jobs_of(spark, "six", lambda: segments.fit_kmeans(rows, NAMES, 3, 7, 6))
    assert together < 3 * most
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_all_points_can_be_drawn(spark):
    """Each round draws by squared distance from every point: a point far from the others is drawn next, wherever it lies."""
    x = np.zeros((6000, 3))
    x[5990:, 0] = 1e-3
    x[4321] = (50, 50, 50)
    stacked, width = B.stacked([(frame(spark, x), NAMES)])
    first = B.drawn_centers(stacked, width, 2, 1, 8)
    assert all((50, 50, 50) in {tuple(c) for c in centers.tolist()} for centers in first)
    counts = np.zeros(2)  # of points at distance 1 and 3 from the first centre, the second is drawn nine times as often
    draw, line = B.drawn_by(), np.array([[0.0], [1.0], [3.0]])
    for salt in range(4000):
        ids = np.array([11, 12 + salt, 900000 + salt], np.int64)
        counts[draw(line, ids, salt * 7919, line[:1])[0] - 1] += 1
    assert counts[1] / counts.sum() == pytest.approx(0.9, abs=0.02)


def test_fewer_points_than_clusters(spark):
    got = segments.fit_kmeans(frame(spark, np.array([[0.0, 0, 0], [2.0, 0, 0], [2.0, 0, 0]])), NAMES, 3, 1, 2)
    assert {tuple(c) for c in got} == {(0.0, 0.0, 0.0), (2.0, 0.0, 0.0)}
    labelled = segments.nearest(frame(spark, np.array([[0.0, 0, 0], [2.0, 0, 0]])), NAMES, got)
    assert labelled.select("label").distinct().count() == 2
