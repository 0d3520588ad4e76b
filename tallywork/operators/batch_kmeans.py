"""Many K-Means models in one pass, micro-clusters with Ward linkage, and the silhouette over plain distances.

A pass reads every point once and labels it under all models: a task adds up the rows, sums and squares of every cluster of
every model, so what is shuffled is one row per cluster and task, whatever the data. A Lloyd step of a whole grid (several
populations, k, seeds and starts) is one such job; models that have converged leave it. Models of one population and k are
labelled together: one product gives all distances, one more adds up all clusters. Sums are fixed-point integers, so they do
not depend on the order of rows or tasks.

First centres are drawn by squared distance, for the grid from a bounded sample (``SAMPLE`` points of a population, the least
hashes of their ids), for ``best_centers`` from all points; every step, cost, contingency table and silhouette reads all points.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 2048
MAX_STEPS, TOLERANCE = 300, 1e-4
LANDMARKS = 1024  # of a cluster
POINTS_AT_ONCE = 4096
DISTANCES_AT_ONCE = 1 << 17  # of all models of one population and k; they stay in a core's cache
MICRO = 256


@dataclass
class Model:
    """Centres of one fit, with the rows, sums and squared norms of its clusters and the cost over all points."""

    population: int
    k: int
    seed: int
    start: int
    centers: np.ndarray
    n: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sums: np.ndarray = field(default_factory=lambda: np.zeros(0))
    squares: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cost: float = 0.0  # the sum of squared distances of the points to their centres


def stacked(parts: list[tuple[DataFrame, tuple[str, ...]]]) -> tuple[DataFrame, int]:
    """Populations as one table (population, customer_id, x0, x1, ...); missing features are 0, which no distance sees."""
    width, out = max(len(features) for _, features in parts), None
    for number, (df, features) in enumerate(parts):
        names = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
        rest = [F.lit(0.0).alias(f"x{i}") for i in range(len(features), width)]
        one = df.select(F.lit(number).alias("population"), "customer_id", *names, *rest)
        out = one if out is None else out.unionByName(one)
    return out, width


def _sample(points: DataFrame, population: int, width: int) -> np.ndarray:
    least = points.where(F.col("population") == population).orderBy(F.xxhash64("customer_id"), "customer_id").limit(SAMPLE)
    rows = least.select(*[f"x{i}" for i in range(width)]).collect()
    return np.array([tuple(r) for r in rows], float).reshape(-1, width)


def first_centers(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k points of the sample, each drawn by its squared distance to those before."""
    chosen = [int(rng.integers(len(sample)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = near.sum()
        chosen.append(int(rng.choice(len(sample), p=near / total)) if total > 0 else int(rng.integers(len(sample))))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen].copy()


def _together(models: list[Model]) -> list[tuple[int, int, np.ndarray]]:
    """(population, k, weights) of the models that are labelled together. A row of weights times
    (point, 1) is a squared distance to a centre, less the point's own square; rows go by cluster, then by model."""
    out = []
    for population, k in sorted({(m.population, m.k) for m in models}):
        centers = np.stack([m.centers for m in models if (m.population, m.k) == (population, k)], 1)
        out.append((population, k, np.concatenate([-2 * centers, (centers * centers).sum(2)[:, :, None]], 2).reshape(
            -1, centers.shape[2] + 1)))
    return out


def adder(scale: float, distances: int = DISTANCES_AT_ONCE):
    """The function that labels and adds up; made here, so that it goes to the tasks by value."""

    def add_up(x: np.ndarray, added: np.ndarray, k: int, weights: np.ndarray, totals: np.ndarray, costs: np.ndarray) -> None:
        """Adds the columns of ``added`` to ``totals``, per row of ``weights``: the centre nearest to each point, for every
        model at once. Of equally near centres the first counts. ``costs`` gets each model's squared distances."""
        models = len(weights) // k
        at_once, padded, square = max(16, distances // len(weights)), np.column_stack([x, np.ones(len(x))]), (x * x).sum(1)
        for low in range(0, len(x), at_once):
            apart = (weights @ padded[low:low + at_once].T).reshape(k, models, -1)
            least = apart.min(0)
            nearest = apart == least
            least += square[low:low + at_once]
            costs += np.rint(np.maximum(least, 0, out=least) * scale).sum(1).astype(np.int64)
            if np.count_nonzero(nearest) != nearest[0].size:
                taken = nearest[0].copy()
                for own in nearest[1:]:
                    own &= ~taken
                    taken |= own
            # Integers below 2^53, so the product is exact in any order. The last cluster has what the others leave.
            some = added[low:low + at_once]
            sums = (nearest[:-1].reshape((k - 1) * models, len(some)).astype(float) @ some).astype(np.int64)
            totals[:len(sums)] += sums
            totals[len(sums):] += some.sum(0).astype(np.int64) - sums.reshape(k - 1, models, some.shape[1]).sum(0)

    return add_up


def _pass(points: DataFrame, width: int, models: list[Model]) -> None:
    """Fills ``n``, ``sums``, ``squares`` and ``cost`` of all models for their present centres, in one job."""
    scale = float(1 << 30)
    together = _together(models)
    begin = np.concatenate([[0], np.cumsum([len(weights) for _, _, weights in together])])
    sent = points.sparkSession.sparkContext.broadcast(together)
    columns, slots, add_up = [f"x{i}" for i in range(width)], int(begin[-1]), adder(scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, costs = np.zeros((slots, width + 2), np.int64), np.zeros(slots, np.int64)
        for batch in batches:
            kind = batch.column("population").to_numpy(zero_copy_only=False)
            every = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            for population in np.unique(kind).tolist():
                x = every[kind == population]
                added = np.column_stack([np.ones(len(x)), np.rint((x * x).sum(1) * scale), np.rint(x * scale)])
                for at, (of, k, weights) in enumerate(sent.value):
                    if of == population:
                        first = begin[at]  # a model's cost goes with its first cluster
                        add_up(x, added, k, weights, totals[first:begin[at + 1]], costs[first:first + len(weights) // k])
        held = np.flatnonzero(totals[:, 0] + costs)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(costs[held]), *[pa.array(totals[held, i]) for i in range(width + 2)]],
                                         ["slot", "cost", "n", "square", *columns])

    shape = "slot bigint, cost bigint, n bigint, square bigint, " + ", ".join(f"{c} bigint" for c in columns)
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    added = points.select("population", *columns).mapInArrow(run, shape).groupBy("slot").agg(
        F.sum("n").alias("n"), exact("cost"), exact("square"), *[exact(c) for c in columns])
    n, costs, squares, sums = np.zeros(slots), np.zeros(slots), np.zeros(slots), np.zeros((slots, width))
    for r in added.collect():  # one row per cluster
        n[r.slot], costs[r.slot], squares[r.slot] = r.n, float(r.cost) / scale, float(r.square) / scale
        sums[r.slot] = [float(r[c]) / scale for c in columns]
    sent.destroy()
    for at, (population, k, weights) in enumerate(together):
        for no, m in enumerate(m for m in models if (m.population, m.k) == (population, k)):
            here = slice(begin[at] + no, begin[at + 1], len(weights) // k)
            m.n, m.squares, m.sums, m.cost = n[here], squares[here], sums[here], float(costs[begin[at] + no])


def drawn_by():
    """The function that draws; made here, so that it goes to the tasks by value."""

    def draw(x: np.ndarray, ids: np.ndarray, salt: int, chosen: np.ndarray) -> tuple[int, float]:
        """(row, key) of the least key: an exponential variate that the row's id and the salt decide, by the squared distance
        to the nearest chosen centre. The least of all keys is a draw by squared distance. No row is drawn at distance 0."""
        z = ids.view(np.uint64) + np.uint64(salt)  # the finaliser of SplitMix64; it wraps around
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        keys = -np.log(((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0 ** -53 + 2.0 ** -54)
        if len(chosen):
            near = np.full(len(x), np.inf)
            for center in chosen:
                np.minimum(near, ((x - center) ** 2).sum(1), out=near)
            keys = np.divide(keys, near, out=np.full(len(x), np.inf), where=near > 0)
        least = keys.min()
        tied = np.flatnonzero(keys == least)  # rows of one id: the first point in order counts
        at = tied[0] if len(tied) == 1 else tied[np.lexsort(x[tied].T[::-1])[0]]
        return int(at), float(least)

    return draw


def drawn_centers(points: DataFrame, width: int, k: int, seed: int, starts: int) -> np.ndarray:
    """First centres (start, centre, feature) of every start, from all points: each is drawn by its squared distance to those
    before. A round is one pass that all starts share, and brings one row a start to the driver. Where all points are
    centres already, the first centre is repeated; no point is labelled by the repetition."""
    columns, draw, chosen = [f"x{i}" for i in range(width)], drawn_by(), np.zeros((starts, 0, width))
    named = points.select(F.xxhash64("customer_id").alias("id"), *columns)
    shape = "start int, key double, " + ", ".join(f"{c} double" for c in columns)
    for place in range(k):
        salts = [int(np.random.SeedSequence([seed, start, place]).generate_state(1, np.uint64)[0]) for start in range(starts)]

        def run(batches: Iterator[pa.RecordBatch], salts=salts, chosen=chosen) -> Iterator[pa.RecordBatch]:
            best = {}
            for batch in batches:
                if batch.num_rows:
                    x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
                    ids = batch.column("id").to_numpy(zero_copy_only=False)
                    for start, salt in enumerate(salts):
                        at, key = draw(x, ids, salt, chosen[start])
                        if np.isfinite(key):
                            best[start] = min(best.get(start, (np.inf,)), (key, *x[at].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best), pa.int32()), *[pa.array([row[i] for row in best.values()], pa.float64()) for i in range(width + 1)]],
                ["start", "key", *columns])

        least = named.mapInArrow(run, shape).groupBy("start").agg(F.min(F.struct("key", *columns)).alias("least")).collect()
        found = {r.start: tuple(r.least)[1:] for r in least}
        if not place and not found:
            return chosen
        following = np.array([found[start] if start in found else chosen[start, 0] for start in range(starts)])
        chosen = np.concatenate([chosen, following[:, None]], 1)
    return chosen


def best_centers(points: DataFrame, width: int, k: int, seed: int, starts: int, steps: int = MAX_STEPS,
                 tolerance: float = TOLERANCE) -> Model:
    """The model of lowest cost over several starts, all points read in every draw and step. A start goes on until none of its
    centres moves by more than ``tolerance``."""
    models = [Model(0, k, seed, start, centers) for start, centers in enumerate(drawn_centers(points, width, k, seed, starts))
              if len(centers)]
    return min(_settled(points, width, models, steps, lambda moves: moves.max() <= tolerance * tolerance), key=lambda m: m.cost)


def fit(points: DataFrame, width: int, wanted: list[tuple[int, int, int, int]], steps: int = MAX_STEPS) -> list[Model]:
    """A model for each (population, k, seed, start). After the last step every model's numbers belong to its centres."""
    samples = {p: _sample(points, p, width) for p in {w[0] for w in wanted}}
    models = [Model(p, k, seed, start, first_centers(samples[p], k, np.random.default_rng([seed, start, k, p])))
              for p, k, seed, start in wanted if len(samples[p])]
    return _settled(points, width, models, steps, lambda moves: moves.sum() <= TOLERANCE)


def _settled(points: DataFrame, width: int, models: list[Model], steps: int, still: Callable[[np.ndarray], bool]) -> list[Model]:
    """Lloyd steps of all models together. A model leaves when the squared moves of its centres are ``still``."""
    active = models
    for step in range(steps + 1):
        if not active:
            break
        _pass(points, width, active)
        going = []
        for m in active:
            moved = np.where(m.n[:, None] > 0, m.sums / np.maximum(m.n, 1)[:, None], m.centers)
            if step < steps and not still(((moved - m.centers) ** 2).sum(1)):
                m.centers = moved
                going.append(m)
        active = going
    return models


def best_of(models: list[Model]) -> dict[tuple[int, int, int], Model]:
    """The start of lowest cost for each (population, k, seed)."""
    out: dict[tuple[int, int, int], Model] = {}
    for m in models:
        key = (m.population, m.k, m.seed)
        if key not in out or m.cost < out[key].cost:
            out[key] = m
    return out


def rand_index(table: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table."""
    pairs = lambda x: (x * (x - 1) / 2).sum()
    both, a, b = pairs(table), pairs(table.sum(1)), pairs(table.sum(0))
    chance = a * b / max(table.sum() * (table.sum() - 1) / 2, 1)
    ceiling = (a + b) / 2
    return 1.0 if ceiling == chance else float((both - chance) / (ceiling - chance))


def grid(points: DataFrame, width: int, names: list[str], ks, seed: int, seeds, starts: int) -> list[dict]:
    """One row per (population, k) with at least k points: cost, squared-Euclidean silhouette, Calinski-Harabasz, agreement with the other seeds,
    smallest share. All fits share their passes; afterwards one pass gives all contingency tables and silhouettes."""
    sizes = {r.population: r["count"] for r in points.groupBy("population").count().collect()}
    found = best_of(fit(points, width, [(p, k, s, start) for p in range(len(names)) for k in ks if k <= sizes.get(p, 0)
                                        for s in (seed, *seeds) for start in range(starts)]))
    plans = [(base, [found[p, k, s] for s in seeds]) for (p, k, s), base in sorted(found.items()) if s == seed]
    tables, scores = _agreement(points, width, plans)
    out = []
    for at, (base, others) in enumerate(plans):
        total, within = base.n.sum(), (base.squares - (base.sums ** 2).sum(1) / np.maximum(base.n, 1)).sum()
        between = base.squares.sum() - (base.sums.sum(0) ** 2).sum() / total - within
        rand = [rand_index(tables[at, j]) for j in range(len(others))]
        out.append({"population": names[base.population], "k": base.k, "customers": int(total), "inertia": base.cost,
                    "silhouette": float(scores[at] / total),
                    "calinski_harabasz": (float((between / (base.k - 1)) / (within / (total - base.k)))
                                          if total > base.k and within > 0 else None),
                    "ari_min": min(rand), "ari_mean": sum(rand) / len(rand), "min_cluster_share": float(base.n.min() / total),
                    "clusters": int((base.n > 0).sum())})
    return out


def _agreement(points: DataFrame, width: int, plans) -> tuple[dict, list[float]]:
    """Contingency tables (plan, other) and the sum of silhouettes of each plan, from one pass."""
    scale, at_once, columns = float(1 << 30), POINTS_AT_ONCE, [f"x{i}" for i in range(width)]
    sent = points.sparkSession.sparkContext.broadcast(
        [(b.population, b.centers, b.n, b.sums, b.squares, [o.centers for o in others]) for b, others in plans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def labels(x, centers):
            return ((x * x).sum(1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(1)).argmin(1)

        tables, scores = {}, np.zeros(len(sent.value), np.int64)
        for batch in batches:
            kind = batch.column("population").to_numpy(zero_copy_only=False)
            every = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            for at, (population, centers, n, sums, squares, others) in enumerate(sent.value):
                mine = every[kind == population]
                for low in range(0, len(mine), at_once):
                    x = mine[low:low + at_once]
                    k, label, rows = len(centers), labels(x, centers), np.arange(min(at_once, len(mine) - low))
                    for no, other in enumerate(others):
                        cells = np.bincount(label * k + labels(x, other), minlength=k * k)
                        tables[at, no] = tables.get((at, no), 0) + cells
                    held = np.maximum(n, 1)
                    apart = (x * x).sum(1)[:, None] - 2 * (x @ (sums / held[:, None]).T) + squares / held
                    own = apart[rows, label] * n[label] / np.maximum(n[label] - 1, 1)
                    apart[rows, label] = np.inf
                    apart[:, n == 0] = np.inf
                    other = apart.min(1)
                    most = np.maximum(own, other)
                    good = (n[label] > 1) & np.isfinite(other) & (most > 0)
                    s = np.where(good, (other - own) / np.where(good, most, 1), 0)
                    scores[at] += int(np.rint(s * scale).sum())
        rows = [(a, o, c, int(v)) for (a, o), cells in tables.items() for c, v in enumerate(cells) if v]
        rows += [(a, -1, 0, int(v)) for a, v in enumerate(scores)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else
                                         [pa.array([], pa.int64())] * 4, ["plan", "other", "cell", "n"])

    added = points.select("population", *columns).mapInArrow(run, "plan bigint, other bigint, cell bigint, n bigint")
    tables, scores = defaultdict(lambda: None), [0.0] * len(plans)
    for at, (base, others) in enumerate(plans):
        for no in range(len(others)):
            tables[at, no] = np.zeros((base.k, base.k))
    for r in added.groupBy("plan", "other", "cell").agg(F.sum(F.col("n").cast("decimal(28,0)")).alias("n")).collect():
        if r.other < 0:
            scores[r.plan] = float(r.n) / scale
        else:
            tables[r.plan, r.other].reshape(-1)[r.cell] = float(r.n)
    sent.destroy()
    return tables, scores


# ---- Ward linkage over micro-clusters
def ward(n: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, list[float]]:
    """(group of each summary, heights): summaries (rows and sums) are merged by the smallest growth of the squares within,
    down to ``k`` groups; heights are all growths down to one group. Ties go to the first pair. Groups are numbered by their
    first member."""
    size, mean = n.astype(float).copy(), sums / n[:, None]
    alive, group = np.ones(len(n), bool), np.arange(len(n))
    cost = _growth(size, mean, alive)
    heights, out = [], group.copy()
    for left in range(len(n), 1, -1):
        if left == k:
            out = group.copy()
        a, b = divmod(int(cost.argmin()), len(n))
        a, b = min(a, b), max(a, b)
        heights.append(float(cost[a, b]))
        mean[a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
        group[group == b] = a
        row = np.where(alive, size[a] * size / (size[a] + size) * ((mean - mean[a]) ** 2).sum(1), np.inf)
        row[a] = np.inf
        cost[a], cost[:, a] = row, row
        cost[b], cost[:, b] = np.inf, np.inf
    if k >= len(n):
        out = np.arange(len(n))
    elif k == 1:
        out = group
    return np.unique(out, return_inverse=True)[1], heights


def _growth(size: np.ndarray, mean: np.ndarray, alive: np.ndarray) -> np.ndarray:
    apart = ((mean[:, None, :] - mean[None, :, :]) ** 2).sum(2)
    cost = size[:, None] * size[None, :] / (size[:, None] + size[None, :]) * apart
    cost[~alive] = np.inf
    cost[:, ~alive] = np.inf
    np.fill_diagonal(cost, np.inf)
    return cost


@dataclass
class Linkage:
    micro: Model
    group: np.ndarray
    heights: list[float]

    @property
    def within_micro(self) -> float:
        """Squares of the points about the means of their micro-clusters."""
        return float((self.micro.squares - (self.micro.sums ** 2).sum(1) / self.micro.n).sum())


def ward_linkage(scaled: DataFrame, features, k: int, seed: int, micro: int = MICRO, steps: int = 10) -> Linkage:
    """Ward's hierarchy over summaries of all rows. The rows are summarised into at most ``micro`` micro-clusters by a few
    Lloyd steps; the summaries are a bounded list, which the driver links. With as many micro-clusters as distinct rows the
    hierarchy is that of the rows."""
    points, width = stacked([(scaled, tuple(features))])
    model = fit(points, width, [(0, micro, seed, 0)], steps)[0]
    some = model.n > 0
    model = Model(0, int(some.sum()), seed, 0, model.centers[some], model.n[some], model.sums[some], model.squares[some])
    return Linkage(model, *ward(model.n, model.sums, k))


def linked_labels(scaled: DataFrame, features, linkage: Linkage) -> DataFrame:
    """(customer_id, other): the group of each row's nearest micro-cluster."""
    names, at_once = list(features), POINTS_AT_ONCE
    sent = scaled.sparkSession.sparkContext.broadcast((linkage.micro.centers, linkage.group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, group = sent.value
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in names])
            label = [((x[a:a + at_once, None, :] - centers[None]) ** 2).sum(2).argmin(1) for a in range(0, len(x), at_once)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("customer_id"), pa.array(group[np.concatenate(label)] if label else [], pa.int32())],
                ["customer_id", "other"])

    return scaled.select("customer_id", *names).mapInArrow(run, "customer_id string, other int")


# ---- silhouette over plain distances
def plain_silhouette(labelled: DataFrame, features, landmarks: int = LANDMARKS) -> DataFrame:
    """(customer_id, silhouette, low, high) over plain Euclidean distances, linear in the rows.

    A cluster is stood for by at most ``landmarks`` landmarks: all its rows if it has no more, else the means of the rows
    nearest to as many sampled ones. The mean distance of a row to a cluster is taken to the landmarks, weighted by their
    rows. By the triangle inequality it is off by no more than the mean distance of the cluster's rows to their landmarks,
    so the true silhouette lies between ``low`` and ``high``; where clusters are small enough all three are equal.
    A cluster of one row, and a single cluster, have 0. Landmarks (clusters x ``landmarks`` rows) pass through the driver."""
    names, spark = list(features), labelled.sparkSession
    order = Window.partitionBy("label").orderBy(F.xxhash64("customer_id"), "customer_id")
    picked = labelled.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= landmarks)
    rows = picked.select("label", *names).collect()
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = {g: np.array([[r[f] for f in names] for r in rows if r.label == g]) for g in sorted(sizes)}
    weights = {g: np.ones(len(x)) for g, x in held.items()}
    reach = dict.fromkeys(held, 0.0)
    large = {g: held[g] for g in held if sizes[g] > landmarks}
    for last in (False, True):
        if not large:
            break
        n, sums, radius = _landmark_sums(labelled, names, large)
        for g in large:
            some = n[g] > 0
            if last:
                held[g], weights[g], reach[g] = large[g][some], n[g][some], radius[g]
            else:
                large[g] = sums[g][some] / n[g][some][:, None]
    groups = list(held)
    sent = spark.sparkContext.broadcast([(held[g], weights[g], sizes[g], reach[g]) for g in groups])
    place = {g: i for i, g in enumerate(groups)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(a, b):
            most = np.maximum(a, b)
            return np.where(most > 0, (b - a) / np.where(most > 0, most, 1), 0.0)

        for batch in batches:
            every = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in names])
            label = np.array([place[g] for g in batch.column("label").to_pylist()], int)
            out = []
            for low in range(0, len(every), 512):
                x, mine = every[low:low + 512], label[low:low + 512]
                mean, slack = np.empty((len(x), len(groups))), np.empty((len(x), len(groups)))
                alone = np.zeros(len(x), bool)
                for g, (marks, weight, n, off) in enumerate(sent.value):
                    apart = np.zeros((len(x), len(marks)))
                    for f in range(x.shape[1]):
                        apart += (x[:, f, None] - marks[None, :, f]) ** 2
                    apart = np.sqrt(apart)
                    own = mine == g
                    total = apart @ weight - np.where(own, apart.min(1), 0)
                    others = n - own
                    mean[:, g] = total / np.maximum(others, 1)
                    slack[:, g] = off / np.maximum(others, 1)
                    alone |= own & (n == 1)
                at = np.arange(len(x))
                a, da = mean[at, mine], slack[at, mine]
                mean[at, mine] = np.inf
                b = mean.min(1)
                b_low, b_high = (mean - slack).min(1), (mean + slack).min(1)
                zero = alone | ~np.isfinite(b)
                b, b_low, b_high = (np.where(zero, 0, v) for v in (b, b_low, b_high))
                three = of(a, b), of(a + da, np.maximum(b_low, 0)), of(np.maximum(a - da, 0), b_high)
                out.append([np.where(zero, 0.0, v) for v in three])
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([batch.column("customer_id"), *map(pa.array, columns)],
                                             ["customer_id", "silhouette", "low", "high"])

    return labelled.select("customer_id", "label", *names).mapInArrow(
        run, "customer_id string, silhouette double, low double, high double")


def _landmark_sums(labelled: DataFrame, names: list[str], large: dict) -> tuple[dict, dict, dict]:
    """Per cluster: rows and sums of each landmark's nearest rows, and the sum of their distances to it."""
    scale, groups = float(1 << 30), sorted(large)
    sent = labelled.sparkSession.sparkContext.broadcast(large)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {g: np.zeros(len(m), np.int64) for g, m in sent.value.items()}
        sums = {g: np.zeros(m.shape, np.int64) for g, m in sent.value.items()}
        off = {g: np.zeros(len(m), np.int64) for g, m in sent.value.items()}
        for batch in batches:
            every = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in names])
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for g, marks in sent.value.items():
                mine = every[label == g]
                for low in range(0, len(mine), 512):
                    x = mine[low:low + 512]
                    apart = np.zeros((len(x), len(marks)))
                    for f in range(x.shape[1]):
                        apart += (x[:, f, None] - marks[None, :, f]) ** 2
                    near = apart.argmin(1)
                    np.add.at(n[g], near, 1)
                    np.add.at(sums[g], near, np.rint(x * scale).astype(np.int64))
                    np.add.at(off[g], near, np.rint(np.sqrt(apart[np.arange(len(x)), near]) * scale).astype(np.int64))
        rows = [(g, i, int(n[g][i]), int(off[g][i]), *sums[g][i].tolist()) for g in n for i in np.flatnonzero(n[g]).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else
                                         [pa.array([], pa.int64())] * (4 + len(names)), ["label", "place", "n", "off", *names])

    shape = "label bigint, place bigint, n bigint, off bigint, " + ", ".join(f"{f} bigint" for f in names)
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    added = labelled.select("label", *names).mapInArrow(run, shape).groupBy("label", "place").agg(
        F.sum("n").alias("n"), exact("off"), *[exact(f) for f in names]).collect()
    n = {g: np.zeros(len(large[g])) for g in groups}
    sums = {g: np.zeros(large[g].shape) for g in groups}
    off = dict.fromkeys(groups, 0.0)
    for r in added:
        n[r.label][r.place], sums[r.label][r.place] = r.n, [float(r[f]) / scale for f in names]
        off[r.label] += float(r.off) / scale
    sent.destroy()
    return n, sums, off
