"""Operators on small tables, and queries against their SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.operators import components, mcl, network, orthogroups, scoring, search
from cladeflow.plans import catalog
from cladeflow.sources import files, sinks

DATA = "/root/testdata/sf0.001"
HITS = "qt string, tt string, line_no long, target string, query string, evalue double, score double"


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), HITS)


def test_evalue_at_the_limit_drops(spark):
    t = hits(spark, ("A", "B", 1, "x", "y", 1e-4, 1.0), ("A", "B", 2, "x", "y", 9e-5, 1.0))
    assert [r.line_no for r in scoring.filter_hits(t, 1e-4).collect()] == [2]


def test_first_line_wins_ties_and_one_direction_is_no_pair(spark):
    t = hits(spark, ("A", "B", 5, "b1", "a1", 0.0, 9.0), ("A", "B", 3, "b2", "a1", 0.0, 9.0)).withColumnRenamed("score", "s")
    best = scoring.best_hits(t)
    assert [(r.target, r.s) for r in best.collect()] == [("b2", 9.0)]
    assert scoring.reciprocal_best_hits(best).count() == 0


def test_self_hits_make_thresholds_but_no_edges(spark):
    t = hits(spark, ("A", "A", 1, "a", "a", 0.0, 2.0), ("A", "A", 2, "b", "a", 0.0, 1.9), ("A", "A", 3, "b", "b", 0.0, 2.0)).withColumnRenamed("score", "s")
    assert network.from_hits(t).count() == 0
    assert network.from_hits(hits(spark).withColumnRenamed("score", "s")).count() == 0


def test_unknown_records_drop(spark):
    genes = spark.createDataFrame([("A", "a", 10)], "taxon string, name string, length int")
    t = scoring.normalise(scoring.merge_lengths(hits(spark, ("A", "A", 1, "a", "a", 0.0, 5.0), ("A", "A", 2, "z", "a", 0.0, 5.0)), genes))
    assert [r.s for r in t.collect()] == [0.25]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: find(k) for k in parent}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_large_even_components_stay_whole(spark):
    # a clique whose first expanded entries all lie under the prune, as those of 2155 nodes did under 1e-5
    n = 60
    clique = spark.createDataFrame([(a, b, 1.0) for a in range(n) for b in range(a)], "src long, dst long, weight double")
    got = {r.node: r.cluster for r in mcl.sparse_mcl(clique, 1.5, prune=(1 / n) ** 1.5 * 1.01).collect()}
    assert got == dict.fromkeys(range(n), 0)
    # joins give what dense blocks give, whatever the size of a component
    star = spark.createDataFrame([(0, k, 0.5 + k / 100) for k in range(1, 30)] + [(k, k + 1, 1.0) for k in range(1, 29, 3)], "src long, dst long, weight double")
    a, b = ({(r.node, r.cluster) for r in mcl.markov_clusters(star, dense=d).collect()} for d in (1500, 5))
    assert a == b
    with pytest.raises(RuntimeError):
        mcl.sparse_mcl(star, 1.5, rounds=1)


def test_blocks_of_columns_give_dense_clusters(spark):
    rng = random.Random(3)
    rows = [(f"n{a:03d}", f"n{b:03d}", rng.uniform(0.5, 1)) for a in range(170) for b in range(a) if rng.random() < (0.6 if a // 20 == b // 20 else 0.01)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    dense = {(r.node, r.cluster) for r in mcl.markov_clusters(edges).collect()}
    assert {(r.node, r.cluster) for r in mcl.sparse_mcl(edges, 1.5).collect()} == dense and 4 <= len({c for _, c in dense}) <= 12
    # columns cut to more entries than a cluster has lose nothing here
    assert {(r.node, r.cluster) for r in mcl.sparse_mcl(edges, 1.5, most=60).collect()} == dense


def test_a_hub_finishes(spark):
    """A star's square has an entry for each two leaves; selection keeps columns short."""
    n = 6000
    edges = spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    got = mcl.sparse_mcl(edges, 1.5, most=50)
    assert got.count() == n and got.select("cluster").distinct().count() == 1


def test_duplicate_names_fail(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a d\nMK\r\n LV\n>a\nM\n")
    seqs = files.sequences(spark, str(tmp_path))
    assert sorted((r.name, r.length) for r in seqs.collect()) == [("a", 1), ("a", 4)]
    with pytest.raises(ValueError):
        files.require_unique(seqs)


def test_file_names_with_the_separator(spark, tmp_path):
    for n in ("a_2_b.fa", "a.fa"):
        (tmp_path / n).write_text(">x\nM\n")
    (tmp_path / "a_2_b.fa_2_a.fa.phmmerout.txt").write_text("# c\nt - q - 1e-9 50.5 0 1 1\n")
    t = files.search_tables(spark, str(tmp_path), files.taxa(spark, str(tmp_path)))
    assert [(r.qt, r.tt, r.target, r.query, r.score) for r in t.collect()] == [("a_2_b.fa", "a.fa", "t", "q", 50.5)]


def test_occupancy_is_strict_and_wrapping(spark):
    g = spark.createDataFrame([(0, "OG0", "A"), (0, "OG0", "B"), (1, "OG1", "A")], "og_idx long, og_label string, taxon string")
    assert [r.og_idx for r in orthogroups.single_copy(g, 4, 0.25).collect()] == [0]
    text = spark.createDataFrame([("x" * 140,)], "seq string").select(orthogroups.wrapped().alias("t")).first().t
    assert text == "x" * 70 + "\n" + "x" * 70


def aligned(a, b, m):
    """The textbook recurrences of local alignment, cell by cell."""
    rows, cols, low = len(a) + 1, len(b) + 1, float("-inf")
    h, e, f = ([[v] * cols for _ in range(rows)] for v in (0.0, low, low))
    best = 0.0
    for i in range(1, rows):
        for j in range(1, cols):
            e[i][j] = max(h[i][j - 1] - search.GAP_OPEN, e[i][j - 1]) - search.GAP_EXTEND
            f[i][j] = max(h[i - 1][j] - search.GAP_OPEN, f[i - 1][j]) - search.GAP_EXTEND
            h[i][j] = max(0, h[i - 1][j - 1] + m[ord(a[i - 1]), ord(b[j - 1])], e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_alignment_against_brute_force():
    m = search.blosum62()
    assert (m == m.T).all() and m[ord("w"), ord("W")] == 11 and m[ord("B"), ord("D")] == 4 and m[ord("*"), ord("A")] == -4 and m[ord("J"), ord("A")] == 0
    rng = random.Random(3)
    for _ in range(60):
        core = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWYBZX*", k=rng.randrange(0, 40)))
        a, b = list(core), list(core)
        for s in (a, b):
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(s) + 1)
                s[at : at + rng.randrange(3)] = rng.choices("ACDEFGHIKLMNPQRSTVWY", k=rng.randrange(5))
        a, b = "".join(a), "".join(b)
        assert search.local_score(a, b, m) == aligned(a, b, m)
    assert search.local_score("HEAGAWGHEE", "PAWHEAE", m) == aligned("HEAGAWGHEE", "PAWHEAE", m) == 17


def test_matrix_files():
    m = search.matrix_of("# two residues\n   A  R\nA  2 -1\nR -1  3\n")
    assert m[65, 65] == 2 and m[65, ord("r")] == -1 and m[ord("W"), 65] == -1
    with pytest.raises(ValueError):
        search.matrix_of("A R\nA 1\n")


def test_native_search(spark):
    seq = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVV"
    rows = [("A", "a", seq), ("B", "b", seq[5:]), ("B", "c", "GGGGGGGGGGGG"), ("C", "d", seq)] + [("D", f"g{k}", seq[:20] + seq[k % 40 : k % 40 + 30]) for k in range(60)]
    table = spark.createDataFrame([(t, n, len(s), s) for t, n, s in rows], "taxon string, name string, length int, seq string")
    for kw in ({}, {"common": 1}, {"exact": True}, {"band": 64}):  # common seeds drop no record's hits
        got = {(r.query, r.target): (r.score, r.evalue) for r in search.native(table, **kw).collect()}
        assert ("a", "b") in got and ("a", "c") not in got and got["a", "b"][0] == pytest.approx(got["b", "a"][0])
        assert got["a", "a"][0] == got["d", "a"][0] == got["a", "d"][0] and {q for q, _ in got} == {n for _, n, _ in rows}
    bits = (search.LAMBDA * aligned(seq, seq[5:], search.blosum62()) - np.log(search.KAPPA)) / np.log(2)
    assert got["a", "b"] == pytest.approx((bits, len(seq) * (len(seq) - 5 + 12) * 2.0**-bits))


def test_numbering(spark):
    rows = [(k % 7, k) for k in range(500)] + [(None, 1000)]
    got = orthogroups.numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), "at", "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.at)] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) and sorted(r.at for r in got) == list(range(501))


def test_matrix_steps(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5)], "src long, dst long, weight double")
    m = np.zeros((4, 4))
    for a, b, w in ((1, 2, 1.0), (2, 3, 0.5), (1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.5)):
        m[a, b] = m[b, a] = w
    m[:, 1:] /= m[:, 1:].sum(axis=0)
    first = {(r.i, r.j): r.v for r in mcl.transition(edges).collect()}
    assert first == pytest.approx({(i, j): m[i, j] for i in range(4) for j in range(4) if m[i, j]})
    x = (m @ m) ** 1.5
    x[:, 1:] /= x[:, 1:].sum(axis=0)
    got = {(r.i, r.j): r.v for r in mcl.expanded(mcl.transition(edges), 1.5).collect()}
    assert got == pytest.approx({(i, j): x[i, j] for i in range(4) for j in range(4) if x[i, j]})


def test_components_of_names(spark):
    edges = [("b", "a"), ("c", "b"), ("x", "y"), ("q", "q")] + [("hub", f"n{k}") for k in range(50)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "q": "q", "hub": "hub"} | {f"n{k}": "hub" for k in range(50)}


def test_count_header(spark):
    m = orthogroups.count_matrix(spark.createDataFrame([(0, "OG0", "A")], "og_idx long, og_label string, taxon string"), ["A", "B"])
    assert [r.value for r in sinks.count_lines(m, ["A", "B"]).orderBy("og_idx").collect()] == ["files: A B", "OG0: 1 0"]


@pytest.mark.parametrize("name", ["edges", "gene_threshold", "component_groups", "run_stats", "fasta_wrap70", "best_hit_parts", "mcl_round", "mcl_converged", "orthogroup_lines", "fasta_scan", "search_table_scan", "resumed_run", "count_lines", "group_fasta", "edge_list_scan", "cluster_scan", "candidate_hits_all", "hit_evalues", "native_seeds", "fasta_source", "group_files"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem", "part", "nation"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, DATA).toPandas()[list(want.columns)]
    rows = lambda t: sorted(map(repr, ([getattr(v, "item", lambda v=v: v)() for v in r] for r in t.itertuples(index=False, name=None))))
    assert rows(got) == rows(want)
