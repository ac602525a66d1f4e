"""The similarity network: weighted, undirected, without loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators import scoring


def edges(norm: DataFrame, corr: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(src, dst, weight), src < dst: corrected scores at or above the query's threshold; the larger direction counts."""
    rows = scoring.corrected(norm.select("qt", "tt", "query", "target", "s"), corr, "s").join(thresholds, ["qt", "query"])
    rows = rows.where((F.col("c") >= F.col("thr") - scoring.EPS) & ((F.col("query") != F.col("target")) | (F.col("qt") != F.col("tt"))))
    return rows.groupBy(F.least("query", "target").alias("src"), F.greatest("query", "target").alias("dst")).agg(F.max("c").alias("weight"))


def from_hits(norm: DataFrame) -> DataFrame:
    """Edges straight from normalised hits."""
    rbh = scoring.reciprocal_best_hits(scoring.best_hits(norm))
    corr = scoring.pair_correction(rbh)
    return edges(norm, corr, scoring.gene_threshold(rbh, corr))
