from collections import defaultdict

from pyspark.sql import functions as F

from cladeflow.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def rows(n=120):
    out = [(i, " ".join(["w"] * (1 + i * i % 97)), f"s{i % 5}" if i % 3 else "hot", "x") for i in range(n)]
    return out + [(n, None, "s1", None), (n + 1, "", None, None), (n + 2, "a b c", None, None), (None, "q r", "s2", None), (5, out[5][1], out[5][2], "again")]


def filled(size, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, target = float(sum(size.values())), set(names), {}
    while True:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * level > cap * size[s]]
        if not over:
            return target | {s: w[s] * level for s in open_}
        for s in over:
            target[s] = float(cap * size[s])
            left -= target[s]
            open_.discard(s)


def test_targets_caps_and_reruns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.mix_digest(docs, block_tokens=16, shard_slots=8).collect()
    again = mixing.mix_digest(docs.repartition(3), block_tokens=16, shard_slots=8).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows())
    source = {(r[0], r[2]) for r in rows()}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        names = [s for i, s in source if i == r["doc_id"]]
        assert len(names) == 1 and 0 <= r["taken"] <= 3 * r["size"]
        size[names[0]] += r["size"]
        taken[names[0]] += r["taken"]
        target[names[0]] = r["target"]
    want = filled(dict(size))
    for s in size:
        assert abs(want[s] - target[s]) < 1e-6 and abs(taken[s] - target[s]) <= 1


def test_texts_hold_the_taken_words(spark):
    docs = spark.createDataFrame([r for r in rows() if r[0] is not None][:-1], SCHEMA)
    taken = mixing.mix_digest(docs, block_tokens=16, shard_slots=8).agg(F.sum("taken")).first()[0]
    mixed = mixing.mix_documents(docs, block_tokens=16, shard_slots=8)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == taken


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        t = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), 1, 2).alias("y"))
        t = t.select("id", "y", mixing.unpermuted(F.col("y"), F.lit(n).cast("long"), 1, 2).alias("z")).collect()
        assert sorted(r.y for r in t) == list(range(n)) and all(r.z == r.id for r in t)


def test_empty(spark):
    assert mixing.mix_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix_digest(spark.createDataFrame([(1, None, "a", None)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)]


def test_every_rest_of_a_source(spark):
    """Targets of 500 equal sources end anywhere in a block, also where the source's short block comes last."""
    docs = spark.range(500 * 8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (1 + F.col("id") % 400).cast("int")).alias("text"), F.format_string("s%03d", (F.col("id") / 8).cast("int")).alias("source"), F.lit("x").alias("size"))
    for block in (64, 17):
        got = mixing.mix_digest(docs, block_tokens=block, shard_slots=64, seed=block)
        got = got.withColumn("s", F.floor(F.col("doc_id") / 8)).groupBy("s").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"))
        assert got.where("abs(taken - target) > 1 or over > 0").count() == 0 and got.count() == 500
