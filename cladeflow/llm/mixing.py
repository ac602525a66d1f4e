"""Mixing sources to target weights, in DataFrame operations only.

Every source's documents, in a pseudorandom order, form one stream of tokens (words) that
is packed into blocks of ``block_tokens``; only the last block of a source is shorter.
Targets come from weights, by water filling under a cap of 3 times the source's size.
An output shard has ``shard_slots`` slots; for each shard the number of slots of each
source is a multinomial draw with the targets' shares. Slots are counted through the
shards, so the j-th slot of a source is known; it is mapped to a block by a pseudorandom
permutation of the source's block indexes (a swap-or-not network, one permutation a
pass), and blocks are joined by source and index. Slots beyond a source's target are
left empty, what is missing fills make-up shards, and the last slot is cut, so that each
source's words meet its target to within one word. No block is used more than 3 times,
and so no document.

Sizes, order and draws depend on doc_id, size and seed alone, so reruns agree.

Defined results: a null text has size 0 and is never taken; a null source is a source of
its own, last in order; rows with one doc_id in one source are packed by (doc_id, size),
and equal rows share the mean of their words, rounded down or up; with no words at all
targets are 0. A text of any length is taken whole or in parts. Columns other than those
named play no part, whatever their names; ``mix_documents`` repeats them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions.staging import stage, unstage

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 24  # of the swap-or-not network
CAP = 3
SHARDS = 1024  # in a range whose slots are counted by one task


def uniform(*parts: Column | int | str) -> Column:
    """A hash of the parts as a double in [0, 1)."""
    h = F.xxhash64(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def permuted(x: Column, n: Column, *keys: Column | int) -> Column:
    """The image of x in a pseudorandom permutation of 0 .. n-1 chosen by the keys."""
    keys = [k if isinstance(k, Column) else F.lit(k) for k in keys]

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - at, n)
        coin = F.xxhash64(*keys, r, F.greatest(at, other), F.lit("coin"))
        return F.when(coin.bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x.cast("long"), swap)


def unpermuted(x: Column, n: Column, *keys: Column | int) -> Column:
    """The inverse of ``permuted``: each round is its own inverse."""
    keys = [k if isinstance(k, Column) else F.lit(k) for k in keys]

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - at, n)
        coin = F.xxhash64(*keys, r, F.greatest(at, other), F.lit("coin"))
        return F.when(coin.bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)), x.cast("long"), swap)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, k, source_size, target) by source in code point order, null last.

    A source takes min(cap, weight * level) words; the level is the largest of
    (words left) / (weight left) over the sources in order of cap / weight. Windows here
    run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("k", F.row_number().over(order) - 1).withColumn("weight", F.get(cycle, F.pmod("k", F.lit(len(weights)))))
    ranked = Window.orderBy(F.col("source_size") / F.col("weight"), "k")
    every, earlier = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), ranked.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum(CAP * F.col("source_size")).over(earlier), F.lit(0)))
    per = per.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))))
    per = per.withColumn("level", F.max("level").over(every))
    return per.select("source", "k", "source_size", F.least((CAP * F.col("source_size")).cast("double"), F.col("weight") * F.col("level")).alias("target"))


def packed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, copies): one row for equal rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return stage(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "sizes")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, block_tokens: int = 512, shard_slots: int = 1024, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sizes, sources, slots, segments).

    ``slots``: shard, place in it, k (the source), block, pass and words of the block
    taken from its start. ``segments``: doc_id, k, size, block, the document's first word
    in the block, its word in the document, and their number.
    """
    sizes = packed(docs, id_col, text_col, source_col)
    sources = targets(sizes.selectExpr("source", "size * copies as size"))
    n = F.ceil(F.col("source_size") / F.lit(block_tokens)).cast("long")
    sources = sources.withColumn("blocks", n).withColumn("goal", F.round("target").cast("long"))
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = sources.withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
    # the short block's slot in the last pass; if it comes in, one slot holds fewer words
    short = unpermuted(F.col("blocks") - 1, F.greatest("blocks", F.lit(1).cast("long")), seed, F.col("k"), F.col("passes"))
    # where it is the last of them, only if it doesn't hold what that slot has to give
    ahead = F.ceil(F.col("rest") / block_tokens) - 1
    lack = F.col("blocks") * block_tokens - F.col("source_size")
    lack = F.when((short < ahead) | ((short == ahead) & (F.col("rest") - ahead * block_tokens > block_tokens - lack)), lack).otherwise(F.lit(0))
    sources = sources.withColumn("words", F.when(F.col("rest") > 0, F.col("rest") + lack).otherwise(F.lit(0)))
    sources = sources.withColumn("part", F.ceil(F.col("words") / block_tokens).cast("long"))
    sources = stage(sources.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("part")), "sources")

    # shards and draws
    # running shares, in a window over one row a source; a draw is the source whose interval holds
    # the slot's uniform number, which is looked up by bucket: as many buckets as sources
    order = Window.orderBy("k")
    shares = sources.where("target > 0").withColumn("high", F.sum("target").over(order)).withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = shares.withColumns({"all": F.max("high").over(every), "buckets": F.count("*").over(every)})
    total = shares.agg(F.sum("slots").alias("total"), F.max("all").alias("all"), F.max("buckets").alias("buckets"))
    bucket = lambda x: F.least(F.floor(F.col(x) / F.col("all") * F.col("buckets")), F.col("buckets") - 1)
    shares = shares.select("k", "low", F.when(F.col("high") < F.col("all"), F.col("high")).otherwise(float("inf")).alias("high"), F.explode(F.sequence(bucket("low"), bucket("high"))).alias("bucket"))
    shards = total.where("total > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / shard_slots))).alias("shard"), "all", "total", "buckets").repartition("shard")
    draws = shards.select("shard", "all", "buckets", F.explode(F.sequence(F.lit(0), F.least(F.lit(shard_slots), F.col("total") - F.col("shard") * shard_slots).cast("int") - 1)).alias("draw"))
    draws = draws.withColumn("u", uniform("draw", F.col("shard"), F.col("draw"), seed) * F.col("all")).select("shard", "u", bucket("u").alias("bucket"))
    counts = draws.join(shares, "bucket").where("low <= u and u < high").groupBy("k", "shard").agg(F.count("*").alias("n"))
    counts = stage(counts, "counts")
    # slots of a source before a shard: those of earlier ranges of shards, and those inside its range
    counts = counts.withColumn("range", F.floor(F.col("shard") / SHARDS))
    ranges = counts.groupBy("k", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    through = Window.partitionBy("k", "range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(through), F.lit(0))).join(ranges, ["k", "range"]).withColumn("first", F.col("first") + F.col("before")).drop("range", "before")
    drawn = counts.groupBy("k").agg(F.sum("n").alias("drawn"))
    missing = sources.join(drawn, "k", "left").select("k", F.col("slots"), F.coalesce("drawn", F.lit(0)).alias("drawn"))
    missing = missing.where("slots > drawn").select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - F.col("drawn") - 1) / shard_slots))).alias("m"), "slots", "drawn")
    makeup = missing.select("k", (-1 - F.col("m")).alias("shard"), F.least(F.lit(shard_slots), F.col("slots") - F.col("drawn") - F.col("m") * shard_slots).alias("n"), (F.col("drawn") + F.col("m") * shard_slots).alias("first"))
    counts = counts.select("k", "shard", "n", "first").unionByName(makeup)

    own = sources.select("k", "blocks", "passes", "words", "slots")
    # a row becomes up to shard_slots rows, so rows are dealt out before, in a number that stays
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = counts.join(own, "k").repartition(tasks, "k", "shard")
    slots = spread.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("place")).withColumn("slot", F.col("first") + F.col("place")).where("slot < slots")
    turn = F.floor(F.col("slot") / F.col("blocks"))
    slots = slots.withColumn("turn", turn).withColumn("block", permuted(F.col("slot") - F.col("turn") * F.col("blocks"), F.col("blocks"), seed, F.col("k"), F.col("turn")))
    limit = F.when((F.col("turn") == F.col("passes")) & (F.col("slot") == F.col("slots") - 1), F.col("words") - (F.col("slot") - F.col("turn") * F.col("blocks")) * block_tokens).otherwise(F.lit(block_tokens))
    slots = slots.select("shard", "k", "slot", "turn", "block", limit.cast("long").alias("limit"))

    # each document's place in its source's stream: two levels of buckets, then rows
    placed = sizes.where("size > 0").join(sources.select("source", "k"), sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    h = F.xxhash64("doc_id", F.lit(seed))
    placed = placed.withColumn("b1", F.pmod(h, F.lit(256))).withColumn("b2", F.pmod(F.shiftrightunsigned(h, 8), F.lit(256)))
    fine = placed.groupBy("k", "b1", "b2").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    coarse = fine.groupBy("k", "b1").agg(F.sum("n").alias("n"))

    def ahead(*keys: str) -> Column:
        w = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    coarse = coarse.withColumn("at1", ahead("k", "b1")).drop("n")
    fine = fine.withColumn("at2", ahead("k", "b1", "b2")).drop("n")
    inside = Window.partitionBy("k", "b1", "b2").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at3", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    placed = placed.join(fine, ["k", "b1", "b2"]).join(coarse, ["k", "b1"])
    at = F.col("at1") + F.col("at2") + F.col("at3")
    span = placed.select("doc_id", "k", "size", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda c: F.struct(c.alias("copy"), (at + c * F.col("size")).alias("at")))).alias("x")).select("doc_id", "k", "size", "x.*")
    block = F.explode(F.sequence(F.floor(F.col("at") / block_tokens), F.floor((F.col("at") + F.col("size") - 1) / block_tokens)))
    segments = span.withColumn("block", block)
    start = F.greatest("at", F.col("block") * block_tokens)
    stop = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_tokens)
    segments = segments.select("doc_id", "k", "size", "copy", "block", (start - F.col("block") * block_tokens).alias("offset"), (start - F.col("at")).alias("word"), (stop - start).alias("n"))
    return sizes, sources, slots, segments


def taken_segments(slots: DataFrame, segments: DataFrame) -> DataFrame:
    """Slots joined with the documents' words in their blocks."""
    got = slots.join(segments.hint("merge"), ["k", "block"])  # both grow with the input
    n = F.greatest(F.lit(0), F.least(F.col("n"), F.col("limit") - F.col("offset")))
    return got.withColumn("n", n).where("n > 0")


def mix_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw: int) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    sizes, sources, slots, segments = plan(docs, id_col, text_col, source_col, **kw)
    took = taken_segments(slots, segments).groupBy("doc_id", "k", "size", "copy").agg(F.sum("n").alias("taken"))
    per = sources.select("source", "k", "source_size", "target")
    each = sizes.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    each = each.join(per, each["source"].eqNullSafe(per["source"])).drop(per["source"])
    out = each.join(took.withColumnRenamed("doc_id", "_d"), (each["doc_id"].eqNullSafe(F.col("_d"))) & (each["k"] == took["k"]) & (each["size"] == took["size"]) & (each["copy"] == took["copy"]), "left")
    return out.select(each["doc_id"], each["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw: int) -> DataFrame:
    """The mix as documents: for each pass over its source, the words taken of a document.

    A document appears up to 3 times, cut to the words that the mix takes; white space
    after a taken word goes with it. Other columns are repeated. Documents with one
    doc_id, source and size must be the same document.
    """
    sizes, sources, slots, segments = plan(docs, id_col, text_col, source_col, **kw)
    # staged, since one query over all of it is planned anew after each of its exchanges, in the driver's memory
    slots, segments = stage(slots, "slots"), stage(segments, "segments")
    took = taken_segments(slots, segments).where("copy = 0")
    took = took.groupBy("doc_id", "k", "size", "turn").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("parts"), F.sum("n").alias("all"))
    took = took.join(sources.select("k", F.col("source").alias("_s")), "k").select(F.col("doc_id").alias("_d"), "_s", F.col("size").alias("_n"), "turn", F.when(F.col("all") < F.col("size"), F.col("parts")).alias("parts"))
    took = stage(took, "taken").hint("merge")  # grows with the input: never broadcast
    unstage(slots, segments)
    names = [f"_k{i}" for i in range(len(docs.columns))]  # the caller's names may be any
    rows = docs.select(*[docs[c].alias(k) for c, k in zip(docs.columns, names, strict=True)], docs[id_col].cast("long").alias("_id"), docs[source_col].cast("string").alias("_source"), docs[text_col].alias("_text"))
    rows = rows.withColumn("_w", F.regexp_count("_text", F.lit(WORD)).cast("long"))
    out = rows.join(took, rows["_id"].eqNullSafe(took["_d"]) & rows["_source"].eqNullSafe(took["_s"]) & (rows["_w"] == took["_n"]))
    words = F.regexp_extract_all("_text", F.lit(WORD + r"[\x20\x09-\x0D]*"), 0)
    text = F.when(F.col("parts").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, (p["word"] + 1).cast("int"), p["n"].cast("int")))), ""))
    return out.select(*[text.alias(c) if c == text_col else F.col(k).alias(c) for c, k in zip(docs.columns, names, strict=True)])
