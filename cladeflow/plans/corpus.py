"""The operators bound to the driver's tables.

documents: a record is a doc_id, its collection is its source, its length the number of
5-word shingles, and a hit's score the number of the query's shingle occurrences that the
target shares, over shingles of 2 to ``most`` documents. Hits of score 10 or more are kept.

The tables that many queries begin with are staged once a session, as a run does, for the
files they are made of; changed files, or a shared folder that was emptied, make a new table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions import paths
from cladeflow.functions.staging import stage, table
from cladeflow.operators import mcl, network, orthogroups, postings, scoring

MIN_SCORE = 10
MOST = 50  # documents of a shingle that makes hits; None for no limit
_staged: dict[tuple, DataFrame] = {}


def staged(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    files = (paths.listed(spark, f"{d}/documents.parquet"), paths.listed(spark, f"{d}/documents.parquet/*"))
    key = (spark.sparkContext.applicationId, name, repr(files))
    if key not in _staged or not paths.finished(spark, _staged[key].staged_at):
        _staged[key] = stage(build(), name)
    return _staged[key]


def forget() -> None:
    """Tables are staged anew from here on."""
    _staged.clear()


def _split() -> Column:
    return F.split(F.lower(F.trim("text")), r"\s+")


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, g, n): occurrences of each shingle, by its hash, in each document."""
    rows = table(spark, d, "documents").select("doc_id", "source", _split().alias("w")).where(F.size("w") >= 5)
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)]))
    return rows.select("doc_id", "source", F.explode(grams).alias("g")).groupBy("doc_id", "source", "g").agg(F.count("*").alias("n"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    """(taxon, name, length, taxon_idx, rec_idx) of documents with a shingle."""
    # the limit holds for what was staged: before it, texts would be split for it once more
    rows = staged(spark, d, "genes", lambda: table(spark, d, "documents").select("source", "doc_id", (F.size(_split()) - 4).alias("length")))
    return rows.where("length > 0").select(F.col("source").alias("taxon"), F.col("doc_id").alias("name"), "length", F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("taxon_idx"), F.col("doc_id").alias("rec_idx"))


def _hits(spark: SparkSession, d: str, most: int | None) -> DataFrame:
    words = F.transform(_split(), lambda w: F.xxhash64(w))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", words.alias("words"))
    return postings.shared_pairs(rows, genes(spark, d).agg(F.sum("length")).first()[0] or 0, most, 5).withColumn("line_no", F.col("target"))


def hits(spark: SparkSession, d: str, most: int | None = MOST) -> DataFrame:
    """Without a limit they grow with the square of a shingle's documents, and are not staged."""
    return _hits(spark, d, most) if most is None else staged(spark, d, f"hits_{most}", lambda: _hits(spark, d, most))


def merged(spark: SparkSession, d: str) -> DataFrame:
    return scoring.merge_lengths(hits(spark, d), genes(spark, d))


def norm_hits(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d, "norm_hits", lambda: scoring.normalise(merged(spark, d).where(F.col("score") >= MIN_SCORE)))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d, "edges", lambda: network.from_hits(norm_hits(spark, d)))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d, "clusters", lambda: mcl.markov_clusters(edges(spark, d)))


def letters(spark: SparkSession, d: str) -> DataFrame:
    """(taxon, name, seq): a document's letters in upper case, as a sequence; documents without letters are left out."""
    seq = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, d, "documents").select(F.col("source").alias("taxon"), F.col("doc_id").alias("name"), seq.alias("seq")).where("seq <> ''")


def groups(spark: SparkSession, d: str) -> DataFrame:
    return orthogroups.orthogroups(genes(spark, d), clusters(spark, d))
