"""Removal of later copies of repeated line runs, in DataFrame operations only.

A text's non-blank lines, trimmed, are a sequence of line IDs (64-bit hashes). Lines that
occur once in the corpus break the sequence into islands; only islands are sorted.

Ranks by prefix doubling: after round k a suffix's rank is (line ID, offset), the place of
its first 2**k lines among all suffixes, as a suffix array orders them. A round pairs each
rank with the rank 2**k lines on, counts the distinct pairs (partial aggregation), and
adds to the offset the number of suffixes in the same group with a smaller pair. No round
needs a global sort: groups begin at their line ID. Suffixes alone in a group leave.

An interval of suffixes that share at least a given prefix is then found by two ranks
that overlap to that length. For each line the shortest run that begins there, and the
shortest that ends there, with ``min_words`` words or more are looked up; all but the
first suffix of an interval are later copies. The union of these runs is exactly the set
of lines covered by maximal repeated runs of ``min_words`` words, since any such run is a
union of shortest ones; touching runs are joined before they are deleted.

Order of copies: (doc_id, hash of the text, line). Defined results: a null text stays
null, an empty one empty; a row with null doc_id is returned unchanged and takes no part;
rows that agree in doc_id and text are one document, so neither is a copy of the other;
a blank line goes when one of those shortest runs spans it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions.staging import stage, unstage

TRIMMED = " \t\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame) -> DataFrame:
    """(d, v, s, i, h, w): s-th non-blank line, which is line i, its ID and words."""
    kept = F.filter(
        F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(TRIMMED)).alias("t"))),
        lambda x: x["t"] != "",
    )
    rows = docs.where("d is not null and text is not null").select("d", "v", F.posexplode(kept).alias("s", "x"))
    return rows.select("d", "v", "s", "x.i", F.xxhash64("x.t").alias("h"), F.regexp_count("x.t", F.lit(WORD)).alias("w"))


def _islands(lines: DataFrame) -> DataFrame:
    """The lines whose ID occurs more than once, with the number of their island."""
    often = stage(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")
    order = Window.partitionBy("d", "v").orderBy("s")
    return lines.join(often, "h").distinct().withColumn("island", F.col("s") - F.row_number().over(order))


def _double(ranks: DataFrame, k: int) -> DataFrame:
    """Adds the offset l{k+1} of ranks by 2**(k+1) lines; null where that prefix is unique.

    The distinct pairs of a common line are ordered in ranges of the following line's
    hash, so that no line's pairs meet in one task; tables that are joined by a key that
    many rows may share are staged, so that such a key's partition can be split.
    """
    along = Window.partitionBy("d", "v", "island").orderBy("s")
    old, new = f"l{k}", f"l{k + 1}"
    step = 1 << k
    ahead = ranks.withColumn("h2", F.lead("h", step).over(along)).withColumn("o2", F.lead(old, step).over(along))
    live = f"{old} is not null and o2 is not null"
    groups = ahead.where(live).groupBy("h", old, "h2", "o2").agg(F.count("*").alias("n"))
    groups = stage(groups.withColumn("range", F.shiftright("h2", 56)), "pairs")
    ranges = groups.groupBy("h", old, "range").agg(F.sum("n").alias("all"))
    earlier = Window.partitionBy("h", old).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("all").over(earlier), F.lit(0))).drop("all")
    before = Window.partitionBy("h", old, "range").orderBy("h2", "o2").rowsBetween(Window.unboundedPreceding, -1)
    named = groups.withColumn("within", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 1")
    named = named.join(ranges.hint("merge"), ["h", old, "range"]).withColumn(new, F.col(old) + F.col("ahead") + F.col("within"))
    named = stage(named.select("h", old, "h2", "o2", new), "named")
    out = stage(ahead.join(named.hint("merge"), ["h", old, "h2", "o2"], "left").drop("h2", "o2"), "ranks")
    unstage(ranks, groups, named)
    return out


def _run(a: Column, j: Column, size: Column, levels: int) -> Column:
    """The run of ``size`` lines from the j-th of the island, named by two ranks; null if unique."""

    def at(k: int) -> Column:
        x, y = F.get(a, j), F.get(a, j + size - (1 << k))
        return F.when(
            x[f"l{k}"].isNotNull() & y[f"l{k}"].isNotNull(),
            F.struct(x["s"].alias("s"), x["i"].alias("first"), F.get(a, j + size - 1)["i"].alias("last"), size.alias("size"), x["h"].alias("h1"), x[f"l{k}"].alias("o1"), y["h"].alias("h2"), y[f"l{k}"].alias("o2")),
        )

    out = F.when(size < 2, at(0))
    for k in range(1, levels):
        out = out.when(size < (2 << k), at(k))
    return out


def _part(first: Column, last: Column, step: int) -> Column:
    """Entries of the island from first to last; slice() would copy it whole inside a lambda."""
    return F.transform(F.sequence(first, last, F.lit(step)), lambda j: F.get("a", j))


def _reach(part: Column, words: int) -> Column:
    """The number of leading entries of ``part`` until they hold ``words`` words; 0 if never."""
    zero = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"))
    end = F.aggregate(part, zero, lambda t, x: F.when(t["w"] >= words, t).otherwise(F.struct((t["w"] + x["w"]).alias("w"), (t["n"] + 1).alias("n"))))
    return F.when(end["w"] >= words, end["n"]).otherwise(F.lit(0))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(d, v, runs): for each document with later copies, their line ranges, from 0.

    ``d`` is the id and ``v`` the text's hash; ranges are structs (first, last), in order.
    """
    source = docs.select(F.col(id_col).alias("d"), F.xxhash64(F.col(text_col)).alias("v"), F.col(text_col).alias("text"))
    lines = stage(_lines(source), "lines")
    ranks = stage(_islands(lines).withColumn("l0", F.lit(0).cast("long")), "ranks")
    levels = max(1, min_words).bit_length()
    for k in range(levels - 1):
        ranks = _double(ranks, k)

    cells = [f"l{k}" for k in range(levels)]
    islands = ranks.groupBy("d", "v", "island").agg(F.sort_array(F.collect_list(F.struct("s", "i", "w", "h", *cells))).alias("a"))
    spots = islands.select("d", "v", "a", F.posexplode(F.transform("a", lambda x, j: F.struct(_reach(_part(j, F.least(j + min_words, F.size("a")) - 1, 1), min_words).alias("on"), _reach(_part(j, F.greatest(j + 1 - min_words, F.lit(0)), -1), min_words).alias("back")))).alias("j", "x"))
    named = spots.select("d", "v", F.explode(F.array(F.struct(F.col("j"), F.col("x.on").alias("size")), F.struct((F.col("j") - F.col("x.back") + 1).alias("j"), F.col("x.back").alias("size")))).alias("y"), "a")
    named = named.where("y.size > 0").select("d", "v", _run(F.col("a"), F.col("y.j"), F.col("y.size"), levels).alias("r")).where("r is not null")
    runs = stage(named.select("d", "v", "r.*"), "runs")

    name = ["size", "h1", "o1", "h2", "o2"]
    heads = runs.groupBy(*name).agg(F.min(F.struct("d", "v", "s")).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    # staged, so that the partition of a passage that many documents share can be split
    later = runs.join(stage(heads, "heads").hint("merge"), name).where(F.struct("d", "v", "s") > F.col("head"))
    covered = later.select("d", "v", F.explode(F.sequence("first", "last")).alias("i")).distinct()
    joined = covered.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("d", "v").orderBy("i")))
    joined = joined.groupBy("d", "v", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    return joined.groupBy("d", "v").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _kept(lines: Column, runs: Column) -> Column:
    """The lines between runs that are in order and apart: each line is looked at once, whatever the number of runs."""

    def between(a: Column, first: Column, last: Column) -> Column:
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda j: F.get(a, j))).otherwise(F.array().cast("array<string>"))

    def kept(a: Column) -> Column:
        after = lambda i: F.when(i > 0, F.get(runs, i - 1)["last"] + 1).otherwise(F.lit(0))
        return F.flatten(F.concat(F.transform(runs, lambda r, i: between(a, after(i), r["first"] - 1)), F.array(between(a, after(F.size(runs)), F.size(a) - 1))))

    return F.get(F.transform(F.array(lines), kept), F.lit(0))  # the lines are split once


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, runs_col: str | None = "deleted_runs") -> DataFrame:
    """``docs`` with later copies of repeated runs cut out of the text, and ``runs_col`` with what was cut.

    Other columns are kept, whatever their names; one called as ``runs_col`` gives way to it.
    """
    names = [c for c in docs.columns if c != runs_col]
    kept = [f"_k{i}" for i in range(len(names))]  # the caller's names may be any
    found = repeated_runs(docs, id_col, text_col, min_words).select(F.col("d").alias("_d"), F.col("v").alias("_v"), F.col("runs").alias("_runs"))
    found = stage(found, "deleted").hint("merge")  # the deletions grow with the input, so they are never broadcast
    rows = docs.select(*[docs[c].alias(k) for c, k in zip(names, kept, strict=True)], docs[id_col].alias("_id"), docs[text_col].alias("_text")).withColumn("_h", F.xxhash64("_text"))
    out = rows.join(found, (F.col("_id") == F.col("_d")) & (F.col("_h") == F.col("_v")), "left")
    text = F.when(F.col("_runs").isNull(), F.col("_text")).otherwise(F.array_join(_kept(F.split("_text", "\n", -1), F.col("_runs")), "\n"))
    cut = [F.coalesce("_runs", F.array().cast("array<struct<first:int,last:int>>")).alias(runs_col)] if runs_col else []
    return out.select(*[text.alias(c) if c == text_col else F.col(k).alias(c) for c, k in zip(names, kept, strict=True)], *cut)
