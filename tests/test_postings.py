"""Pairs by shared tokens against brute force, and what staging leaves behind."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.functions.staging import stage
from cladeflow.operators import mcl, postings


@pytest.mark.parametrize("most", [None, 3])
def test_shared_pairs_meet_brute_force(spark, most):
    rng = np.random.default_rng(5)
    rows = [(i % 40 if i % 17 else None, ["a", "b", None][i % 3], rng.integers(0, 25, rng.integers(0, 12)).tolist() if i % 11 else None) for i in range(90)]
    held: dict[tuple, Counter] = {}
    for name, source, words in rows:
        words = words or []
        held.setdefault((name, source), Counter()).update(zip(words, words[1:], strict=False))
    of: dict[tuple, list] = {}
    for node, grams in held.items():
        for g in grams:
            of.setdefault(g, []).append(node)
    want: Counter = Counter()
    for g, nodes in of.items():
        if 2 <= len(nodes) <= (most or len(nodes)):
            want.update({(q, t): held[q][g] for q in nodes for t in nodes})
    given = spark.createDataFrame(rows, "id long, source string, words array<long>").withColumn("words", F.transform("words", lambda x: F.xxhash64(x)))
    got = postings.shared_pairs(given, 500, most, 2).collect()
    assert len(got) == len(want) and {((r.query, r.qt), (r.target, r.tt)): r.score for r in got} == dict(want)


def test_a_passage_makes_one_list_and_pairs_are_not_shuffled(spark):
    """300 records share a passage of 200 tokens: 18 million rows in a join by tokens, 300 entries here."""
    words = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda x: F.xxhash64(x))
    found = postings.shared_pairs(spark.range(300).select("id", F.lit("s").alias("source"), words.alias("words")), 60_000)
    assert [tuple(r) for r in found.groupBy("score").count().collect()] == [(200, 90_000)]


def test_staging_leaves_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data")}
    before = files()
    staged = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    assert not files() - before
    assert staged.count() == 7


def test_dense_products_mix_as_sparse_ones():
    rng = np.random.default_rng(3)
    columns = [(np.sort(rng.choice(50, 20, replace=False)), rng.random(20)) for _ in range(40)]
    own = [(np.sort(rng.choice(40, 9, replace=False)), rng.random(9)) for _ in range(30)]
    for (at, f), got in zip(own, mcl.products(50, own, columns), strict=True):
        want = np.zeros(50)
        for k, x in zip(at, f, strict=True):
            want[columns[k][0]] += x * columns[k][1]
        assert np.allclose(got, want)
