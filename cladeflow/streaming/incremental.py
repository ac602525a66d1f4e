"""Streams of new search hits, folded into staged minima and maxima.

Maxima of pairs may be merged batch by batch in any order; best hits, means of reciprocal
scores, thresholds and edges are made of the merged table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeflow.functions import paths


def best_scores(hits: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """A stream of (qt, tt, query, target, s) as the running maximum of each pair of records.

    Hits with a time ``ts`` give a maximum for each pair and ``window`` of time, whose state
    ends when the watermark passes it; maxima of windows merge in any order. Without ``ts``
    each pair's state is kept.
    """
    keys = ["qt", "tt", "query", "target"]
    if "ts" in hits.columns:
        hits = hits.withWatermark("ts", delay)
        keys.append(F.window("ts", width))
    return hits.groupBy(*keys).agg(F.max("s").alias("s"))


def on_batches(stream: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Runs ``fold`` on every batch of what is there, then stops."""
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


class HitStore:
    """The hits of a stream, folded batch by batch into a table that best hits and edges are made of.

    The best hit of a query may change with any batch, and with it reciprocity, corrections and
    thresholds; so the store keeps what all of them follow from, one row a pair of records: its
    largest score and the line where it came first. A batch is merged with the version before it
    into a version of its own number: a batch that runs again gives the same table, and a reader
    sees whole versions only. Versions before the last two are deleted.
    """

    KEYS = ("qt", "tt", "query", "target")

    def __init__(self, folder: str):
        self.folder = folder

    def versions(self, spark: SparkSession) -> list[int]:
        found = [x.rsplit("-", 1)[1] for x, *_ in paths.listed(spark, f"{self.folder}/hits-*")]
        return sorted(int(n) for n in found if paths.finished(spark, f"{self.folder}/hits-{n}"))

    def _at(self, version: int) -> str:
        return f"{self.folder}/hits-{version:012d}"

    def fold(self, batch: DataFrame, number: int) -> None:
        """For ``on_batches``: merges a batch of (qt, tt, query, target, s, line_no)."""
        spark = batch.sparkSession
        rows = batch.select(*self.KEYS, "s", "line_no").where("s is not null")
        before = [v for v in self.versions(spark) if v < number]
        if before:
            rows = rows.unionByName(spark.read.parquet(self._at(before[-1])))
        best = F.max_by(F.struct("s", "line_no"), F.struct(F.col("s"), -F.col("line_no")))
        rows.groupBy(*self.KEYS).agg(best.alias("b")).select(*self.KEYS, "b.*").write.mode("overwrite").parquet(self._at(number))
        for old in before[:-1]:
            paths.remove(spark, self._at(old))

    def hits(self, spark: SparkSession) -> DataFrame:
        """The last whole version."""
        return spark.read.parquet(self._at(self.versions(spark)[-1]))
