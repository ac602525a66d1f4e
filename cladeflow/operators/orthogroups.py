"""From clusters to groups: singletons, numbering, counts, single-copy groups, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeflow.functions.staging import stage


def singletons(genes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Records in no cluster."""
    return genes.join(clusters.select(F.col("node").alias("name")).distinct(), "name", "left_anti")


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``rows`` with their place in an order, from 0, without a task that sees them all.

    Rows are dealt in ranges and numbered inside; the sizes of the ranges before, one row
    a range, are added.
    """
    ranged = stage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(F.broadcast(sizes), "_range").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_before", "_inside")


def orthogroups(genes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(og_idx, og_label, size, taxon, taxon_idx, rec_idx, name, length) of every record; size is the group's.

    Clusters come first, by size downwards and then smallest member; singletons follow in
    collection and record order. Groups are numbered in ranges of that order, each range by
    the groups of the ranges before it.
    """
    alone = singletons(genes, clusters).select("name", F.col("name").alias("cluster"), F.lit(1).alias("alone"))
    member = clusters.select(F.col("node").alias("name"), "cluster", F.lit(0).alias("alone")).unionByName(alone)
    member = member.join(genes, "name")
    first = F.min(F.struct("taxon_idx", "rec_idx"))
    groups = member.groupBy("alone", "cluster").agg(F.countDistinct("name").alias("size"), F.min("name").alias("least"), first.alias("first"))
    # singletons are ordered by their place, clusters by size and least member
    order = ["alone", F.when(F.col("alone") == 0, -F.col("size")), F.when(F.col("alone") == 0, F.col("least")), "first", "least"]
    ranked = numbered(groups, "og_idx", *order)
    width = ranked.agg(F.length(F.count("*").cast("string")).alias("width"))
    ranked = ranked.join(F.broadcast(width)).withColumn("og_label", F.concat(F.lit("OG"), F.lpad(F.col("og_idx").cast("string"), F.greatest(F.col("width"), F.length(F.col("og_idx").cast("string"))), F.lit("0"))))
    return member.join(ranked.select("alone", "cluster", "og_idx", "og_label", "size"), ["alone", "cluster"]).drop("alone", "cluster")


def gene_counts(groups: DataFrame) -> DataFrame:
    """(og_idx, og_label, taxon, n) in long form."""
    return groups.groupBy("og_idx", "og_label", "taxon").agg(F.count("*").alias("n"))


def count_matrix(groups: DataFrame, taxa: list[str]) -> DataFrame:
    """One row a group, one column a collection, 0 where it has no record."""
    return groups.groupBy("og_idx", "og_label").pivot("taxon", taxa).count().na.fill(0)


def single_copy(groups: DataFrame, n_taxa: int, threshold: float = 0.5) -> DataFrame:
    """Groups with one record a collection and an occupancy strictly above the threshold."""
    stats = groups.groupBy("og_idx", "og_label").agg(F.count("*").alias("n"), F.countDistinct("taxon").alias("taxa"))
    return stats.where((F.col("n") == F.col("taxa")) & (F.col("taxa") / F.lit(float(n_taxa)) > threshold))


def wrapped(seq: str = "seq", width: int = 70) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fasta_payload(groups: DataFrame, sequences: DataFrame, header: Column | None = None) -> DataFrame:
    """(og_idx, fasta): each group's records in collection and record order, 70 columns wide."""
    return fasta_texts(groups.join(sequences.select("taxon", "name", "seq"), ["taxon", "name"]), header)


def fasta_texts(rows: DataFrame, header: Column | None = None) -> DataFrame:
    """(og_idx, fasta) of records that have their sequence."""
    text = F.concat(F.lit(">"), header if header is not None else F.col("name"), F.lit("\n"), wrapped())
    lines = F.sort_array(F.collect_list(F.struct("taxon_idx", "rec_idx", text.alias("t"))))
    return rows.groupBy("og_idx").agg(F.concat(F.array_join(F.transform(lines, lambda x: x["t"]), "\n"), F.lit("\n")).alias("fasta"))


def fasta_records(groups: DataFrame, sequences: DataFrame, header: Column | None = None) -> DataFrame:
    """(file, header, seq, og_idx, taxon_idx, rec_idx): a row a record of each group, 70 columns wide."""
    rows = groups.join(sequences.select("taxon", "name", "seq"), ["taxon", "name"])
    return rows.select(F.concat(F.lit("OG"), F.col("og_idx").cast("string"), F.lit(".fa")).alias("file"), (header if header is not None else F.col("name").cast("string")).alias("header"), wrapped().alias("seq"), "og_idx", "taxon_idx", "rec_idx")


def taxon_header() -> Column:
    """``collection|record`` without the file's extension."""
    bare = F.regexp_replace(F.coalesce("taxon", F.lit("UnknownSpecies")), r"\.(fa|faa|fas|fasta|pep|prot)$", "")
    return F.concat(bare, F.lit("|"), F.col("name"))


#: Of a table of groups, whose numbers run from 0: what is counted while it is staged.
GROUPED = {"groups": "coalesce(max(og_idx) + 1, 0)", "singletons": "count_if(size = 1)"}


def counted_statistics(spark: SparkSession, n_genes: int, n_edges: int, grouped: dict, n_single: int) -> DataFrame:
    """The row of ``run_statistics`` from what was counted when the tables were staged, without a further scan."""
    row = (n_genes, n_edges, grouped["groups"], n_single, grouped["singletons"])
    return spark.createDataFrame([row], "n_genes long, n_edges long, n_orthogroups long, n_single_copy long, n_singletons long")


def run_statistics(genes: DataFrame, edges: DataFrame, groups: DataFrame, single: DataFrame) -> DataFrame:
    """One row: records, edges, groups, single-copy groups and singletons."""
    sizes = groups.groupBy("og_idx").agg(F.count("*").alias("n"))
    parts = [("n_genes", genes.agg(F.count("*"))), ("n_edges", edges.agg(F.count("*"))), ("n_orthogroups", sizes.agg(F.count("*"))), ("n_single_copy", single.agg(F.count("*"))), ("n_singletons", sizes.where("n = 1").agg(F.count("*")))]
    rows = [t.toDF("v").select(F.lit(k).alias("k"), "v") for k, t in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy().pivot("k", [k for k, _ in parts]).agg(F.first("v"))
