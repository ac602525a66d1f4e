"""Durable intermediate tables and table readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session may lack it: there a temporary folder is made and remembered in
    the session. On a cluster, where such a folder would be seen by one machine alone,
    the missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("cladeflow.shared.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="cladeflow-")
        spark.conf.set("cladeflow.shared.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the reread table.

    Cuts lineage: a lost executor costs no recomputation of what lies before, and
    the reread table has real size statistics for the join planner. Shuffle files of the
    write are deleted when it ends, and not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cladeflow/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def stage_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The staged table and its number of rows, counted while it is written."""
    out, seen = stage_observed(df, name, n=F.count(F.lit(1)))
    return out, seen["n"]


def stage_observed(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict]:
    """The staged table and aggregates of its rows, taken while it is written."""
    seen = Observation()
    out = stage(df.observe(seen, *[c.alias(k) for k, c in aggregates.items()]), name)
    return out, seen.get


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
