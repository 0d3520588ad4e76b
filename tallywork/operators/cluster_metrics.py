"""Quality measures of a labelling: inertia, Calinski-Harabasz, adjusted Rand, silhouette. Those of a whole grid are in ``batch_kmeans``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scatter(labelled: DataFrame, features) -> DataFrame:
    """Within-group squares (inertia about the group means), between-group squares, Calinski-Harabasz and the smallest
    share. Squares come from sums and sums of squares, so the rows are read once."""
    exact = lambda x: x.cast("decimal(38,12)")
    groups = labelled.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(exact(F.col(f))).cast("double").alias(f"{f}_s") for f in features],
        *[F.sum(exact(F.col(f) * F.col(f))).cast("double").alias(f"{f}_q") for f in features])
    plus = lambda xs: reduce(lambda a, b: a + b, xs)
    within = plus([F.col(f"{f}_q") - F.col(f"{f}_s") * F.col(f"{f}_s") / F.col("n") for f in features])
    sums = groups.agg(F.sum(within).alias("within"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
                      F.min("n").alias("smallest"), *[F.sum(f"{f}_q").alias(f"{f}_q") for f in features],
                      *[F.sum(f"{f}_s").alias(f"{f}_s") for f in features])
    whole = plus([F.col(f"{f}_q") - F.col(f"{f}_s") * F.col(f"{f}_s") / F.col("n") for f in features])
    between = whole - F.col("within")
    ch = (between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return sums.select("k", "n", F.col("within").alias("inertia"), between.alias("between"),
                       ch.alias("calinski_harabasz"), (F.col("smallest") / F.col("n")).alias("min_cluster_share"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index from the contingency counts (at most k x k rows after the first aggregate)."""
    pick2 = lambda n: n * (n - 1) / 2
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pick2(F.col("n")))).scalar()
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pick2(F.col("n")))).scalar()
    one = cells.agg(F.sum(pick2(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    one = one.withColumns({"by_a": rows, "by_b": cols})
    chance = F.col("by_a") * F.col("by_b") / pick2(F.col("n"))
    ceiling = (F.col("by_a") + F.col("by_b")) / 2
    return one.select(F.when(ceiling == chance, 1.0).otherwise((F.col("both") - chance) / (ceiling - chance))
                      .alias("adjusted_rand"))


def silhouette(labelled: DataFrame, features) -> DataFrame:
    """The squared-Euclidean silhouette of every row. The mean squared distance of a point to the rows of a group follows
    from the group's size, sums and sum of squares, so one aggregate and one projection give the exact measure; it
    differs from the silhouette over plain distances, which needs all pairs. A group of one row has 0. The k groups are
    a few numbers, which the plan holds as literals."""
    exact = lambda x: x.cast("decimal(38,12)")
    square = reduce(lambda a, b: a + b, (F.col(f) * F.col(f) for f in features))
    groups = labelled.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(exact(square)).cast("double").alias("q"),
        *[F.sum(exact(F.col(f))).cast("double").alias(f) for f in features]).orderBy("label").collect()
    own, others = F, []
    for g in groups:
        dot = reduce(lambda a, b: a + b, (F.col(f) * F.lit(g[f] / g.n) for f in features))
        apart = square - 2 * dot + F.lit(g.q / g.n)
        mine = F.col("label") == g.label
        own = own.when(mine, apart * F.lit(g.n / (g.n - 1)) if g.n > 1 else F.lit(None).cast("double"))
        others.append(F.when(~mine, apart))
    other = F.array_min(F.array_compact(F.array(*others)))
    return labelled.select("customer_id", F.when(own.isNull() | other.isNull(), 0.0).otherwise(
        (other - own) / F.nullif(F.greatest(own, other), F.lit(0.0))).alias("silhouette")).fillna(0.0, ["silhouette"])
