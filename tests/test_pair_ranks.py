"""Rank correlations that make a row tall once per column."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.operators import stats
from tallywork.sources.store import Store


class Watched(Store):
    def save(self, name, df):
        self.seen = {**getattr(self, "seen", {}), name: super().save(name, df)}
        return self.seen[name]


def test_ranks_of_pairs_from_one_tall_row_a_column(spark, tmp_path):
    """Before, a value was made tall, sorted and joined once for every set of columns that a pair needs."""
    rng = np.random.default_rng(4)
    rows = [(f"C{i}", float(rng.integers(0, 6)), float(rng.normal()), None if rng.random() < 0.3 else float(rng.integers(0, 9)),
             None if rng.random() < 0.2 else float(rng.normal())) for i in range(500)]
    df = spark.createDataFrame(rows, "customer_id string, p double, q double, x double, y double").repartition(4)
    store, features = Watched(spark, str(tmp_path)), ("p", "q", "x", "y")
    got = {(r.feature_a, r.feature_b): r for r in stats.spearman_matrix(store, "few", df, "customer_id", features, ("x", "y")).collect()}
    known = df.toPandas()[list(features)]
    for (a, b), r in got.items():
        both = known[[a, b]].dropna().rank()
        assert (r.n, r.rho) == (len(both), pytest.approx(both[a].corr(both[b]), abs=1e-4))
    assert len(got) == 6
    counts = store.seen["spearman_few_counts"].df
    assert {r.measure for r in counts.select("measure").distinct().collect()} == set(features)
    assert counts.agg(F.sum("n")).first()[0] == known.notna().sum().sum()
