"""Scores between records: length normalisation, best hits, reciprocity, correction, thresholds.

Relations (column names are fixed, tables are the caller's):

    hits        qt, tt, line_no, query, target, evalue, score
    norm_hits   hits + s, the score over the sum of both lengths
    best_hits   qt, tt, query, target, s
    reciprocal  qt, tt, query, target, m, the mean of both directions
    correction  lo, hi, corr, for an unordered pair of collections
    thresholds  query, thr
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9  # symmetric scores are often equal to their threshold but for rounding


def filter_hits(hits: DataFrame, evalue: float) -> DataFrame:
    """Hits with an E-value strictly below the limit."""
    return hits.where(F.col("evalue") < F.lit(evalue))


def merge_lengths(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Adds len_t and len_q by (collection, name); null where a record is unknown."""
    target = genes.select(F.col("taxon").alias("tt"), F.col("name").alias("target"), F.col("length").alias("len_t"))
    query = genes.select(F.col("taxon").alias("qt"), F.col("name").alias("query"), F.col("length").alias("len_q"))
    return hits.join(target, ["tt", "target"], "left").join(query, ["qt", "query"], "left")


def normalise(merged: DataFrame) -> DataFrame:
    """Adds s; hits of unknown records have none and are dropped."""
    s = F.try_divide(F.col("score").cast("double"), (F.col("len_q") + F.col("len_t")).cast("double"))
    return merged.withColumn("s", s).where("s is not null")


def require_known(merged: DataFrame) -> DataFrame:
    """Hits with lengths; one of a record that no collection has fails the run."""
    bad = merged.where("len_q is null or len_t is null").head(1)
    if bad:
        raise ValueError(f"a hit of an unknown record: {bad[0]['query']} in {bad[0]['qt']}, {bad[0]['target']} in {bad[0]['tt']}")
    return merged


def best_hits(norm: DataFrame) -> DataFrame:
    """The best target of each query in each ordered pair; ties go to the earliest line."""
    best = F.max_by(F.struct("target", "s"), F.struct(F.col("s"), -F.col("line_no")))
    return norm.groupBy("qt", "tt", "query").agg(best.alias("b")).select("qt", "tt", "query", "b.target", "b.s")


def reciprocal_best_hits(best: DataFrame) -> DataFrame:
    """Best hits that are each other's best hit, in both directions."""
    back = best.select(F.col("qt").alias("tt"), F.col("tt").alias("qt"), F.col("query").alias("target"), F.col("target").alias("query"), F.col("s").alias("back"))
    return best.join(back, ["qt", "tt", "query", "target"]).select("qt", "tt", "query", "target", ((F.col("s") + F.col("back")) / 2).alias("m"))


def _pair() -> tuple[Column, Column]:
    return F.least("qt", "tt").alias("lo"), F.greatest("qt", "tt").alias("hi")


def pair_correction(rbh: DataFrame) -> DataFrame:
    """Mean reciprocal score of each unordered pair; both directions hold the same values."""
    return rbh.groupBy(*_pair()).agg(F.avg("m").alias("corr"))


def corrected(rows: DataFrame, corr: DataFrame, value: str) -> DataFrame:
    """Adds c, the value over the pair's correction; pairs without a positive one drop out."""
    lo, hi = F.least("qt", "tt"), F.greatest("qt", "tt")
    out = rows.withColumns({"lo": lo, "hi": hi}).join(corr.where("corr > 0"), ["lo", "hi"])
    return out.withColumn("c", F.col(value) / F.col("corr")).drop("lo", "hi", "corr")


def gene_threshold(rbh: DataFrame, corr: DataFrame) -> DataFrame:
    """The least corrected reciprocal score of each query over all pairs."""
    return corrected(rbh, corr, "m").groupBy("qt", "query").agg(F.min("c").alias("thr"))
