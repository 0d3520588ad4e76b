"""Reconciliation at every grain: the same measures from two tables, compared cell by cell and by order-free checksums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grains_of(dimensions) -> list[list[str]]:
    """The total, each dimension alone, and all of them together."""
    return [[], *([d] for d in dimensions), list(dimensions)]


def cells(df: DataFrame, dimensions, measures: dict[str, Column], grains: list[list[str]] | None = None) -> DataFrame:
    """(grain, cell, measures): one row per cell of every grain, from one pass with grouping sets."""
    made = df.groupingSets(grains or grains_of(dimensions), *dimensions).agg(
        *[m.alias(k) for k, m in measures.items()],
        F.concat_ws(",", *[F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions]).alias("grain"),
        F.concat_ws("|", *[F.when(F.grouping(d) == 0, F.coalesce(F.col(d).cast("string"), F.lit("null"))) for d in dimensions])
        .alias("cell"))
    return made.select(F.when(F.col("grain") == "", "all").otherwise(F.col("grain")).alias("grain"), "cell", *measures)


def compare_cells(left: DataFrame, right: DataFrame, measures, tolerance: float = 0.01) -> DataFrame:
    """Cells of two tables side by side: the left measures, ``worst`` (the largest difference) and a status. A cell that only
    one side has is MISSING."""
    other = right.select("grain", "cell", F.struct(*measures).alias("_other"))
    joined = left.select("grain", "cell", *measures, F.lit(True).alias("_own")).join(other, ["grain", "cell"], "full")
    gaps = [F.abs(F.coalesce(F.col(m), F.lit(0)).cast("double") - F.coalesce(F.col(f"_other.{m}"), F.lit(0)).cast("double"))
            for m in measures]
    worst = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    status = F.when(F.col("_own").isNull() | F.col("_other").isNull(), "MISSING").when(worst < tolerance, "PASS").otherwise("CHECK")
    return joined.select("grain", "cell", *measures, worst.alias("worst"), status.alias("status"))


def checksums(table: DataFrame, measures, places: int = 2) -> DataFrame:
    """(grain, cells, checksum): equal for equal cells in any order."""
    shown = [F.round(F.col(m).cast("decimal(38,6)"), places).cast("string") for m in measures]
    return table.groupBy("grain").agg(F.count(F.lit(1)).alias("cells"), F.bit_xor(F.xxhash64("cell", *shown)).alias("checksum"))


def compare_grains(left: DataFrame, right: DataFrame, measures) -> DataFrame:
    """(grain, cells, status): whether both sides have the same cells with the same measures."""
    a, b = (checksums(t, measures) for t in (left, right))
    same = reduce(lambda x, y: x & y, [F.col(f"_b.{c}").eqNullSafe(F.col(c)) for c in ("cells", "checksum")])
    joined = a.join(b.select("grain", F.struct("cells", "checksum").alias("_b")), "grain", "full")
    return joined.select("grain", "cells", F.when(same, "PASS").otherwise("CHECK").alias("status"))
