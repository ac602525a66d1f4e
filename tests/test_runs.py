"""Readers, writers, searches and whole runs on small files made here."""

import random
import stat
import sys

import pytest

from cladeflow import cli
from cladeflow.functions import staging
from cladeflow.operators import network
from cladeflow.plans.run import Config, run, settings
from cladeflow.sources import files, sinks
from cladeflow.streaming import incremental

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def family(rng, n, length=120):
    """Sequences that differ from each other in a few residues."""
    base = rng.choices(RESIDUES, k=length)
    out = []
    for _ in range(n):
        s = list(base)
        for _ in range(6):
            s[rng.randrange(length)] = rng.choice(RESIDUES)
        out.append("".join(s))
    return out


@pytest.fixture
def proteomes(tmp_path):
    """Three collections: two families with a member in each, and a record without relatives."""
    rng = random.Random(8)
    one, two = family(rng, 3), family(rng, 3)
    for k, taxon in enumerate(("ant.fa", "bee.faa", "cat_2_dog.pep")):
        text = f">one{k} first\n{one[k][:70]}\n{one[k][70:]}\n>two{k}\n{two[k]}\n"
        (tmp_path / taxon).write_text(text + (">lone\n" + "".join(rng.choices(RESIDUES, k=90)) + "\n" if k == 0 else ""))
    (tmp_path / "notes.txt").write_text(">x\nM\n")
    return tmp_path


PROGRAM = """#!{python}
import os, sys
out, a, b = sys.argv[sys.argv.index("--tblout") + 1], sys.argv[-2], sys.argv[-1]
def read(p):
    return [(r.split()[0], "".join(r.split(chr(10))[1:])) for r in open(p).read().split(">")[1:]]
with open(out, "w") as f:
    f.write("# target - query\\n")
    for q, x in read(a):
        for t, y in read(b):
            same = sum(c == d for c, d in zip(x, y))
            if same > 60:
                f.write(f"{{t}} - {{q}} - 1e-{{same}} {{same}}.5 0.0 1e-9 1 0 1 1 0 0 1 1 1 1 words to end\\n")
    f.write("#\\n# [ok]\\n")
with open({log!r}, "a") as f:
    f.write(os.path.basename(a) + " " + os.path.basename(b) + chr(10))
"""


@pytest.fixture
def program(tmp_path_factory):
    where = tmp_path_factory.mktemp("program")
    path, log = where / "finder", where / "log"
    path.write_text(PROGRAM.format(python=sys.executable, log=str(log)))
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    log.touch()
    return path, log


def names_of(groups) -> set[frozenset]:
    out = {}
    for r in groups.collect():
        out.setdefault(r.og_idx, set()).add(r.name)
    return {frozenset(x) for x in out.values()}


WANT = {frozenset({"one0", "one1", "one2"}), frozenset({"two0", "two1", "two2"}), frozenset({"lone"})}


def test_records_of_split_files(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for f in ("b.fa", "a.fasta"):
        text = "no header yet\r\n" if f == "b.fa" else ""
        for k in range(300):
            seq = "".join(rng.choices(RESIDUES, k=rng.randrange(0, 150)))
            text += f"{' ' * (k % 50 == 7)}>r{k} words {k}\r\n" + "".join(f"{seq[x : x + 60]} \n" for x in range(0, len(seq), 60))
            want.append((f, k, f"r{k}", seq))
        (tmp_path / f).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.sequences(spark, str(tmp_path))
        assert rows.select("taxon").rdd.getNumPartitions() >= 1
        got = sorted((r.taxon, r.rec_idx, r.name, r.seq) for r in rows.collect())
        assert got == sorted(want)
        assert {(r.taxon, r.taxon_idx) for r in rows.collect()} == {("b.fa", 0), ("a.fasta", 1)}
        lines = [f"t{k} - q{k} - 1e-{k} {k} 0 x x x x x x x x x x x x d" for k in range(500)]
        (tmp_path / "b.fa_2_a.fasta.phmmerout.txt").write_text("# head\n" + "\n".join(lines) + "\n\n# [ok]\n")
        (tmp_path / "a.fasta_2_b.fa.phmmerout.txt").write_text("# head\n" + lines[0])
        hits = files.search_tables(spark, str(tmp_path), files.taxa(spark, str(tmp_path))).where("qt = 'b.fa'").orderBy("line_no").collect()
        assert [(r.line_no, r.target, r.query, r.score) for r in hits] == [(k, f"t{k}", f"q{k}", float(k)) for k in range(500)]
        assert [r.file for r in files.finished_tables(spark, str(tmp_path)).collect()] == ["b.fa_2_a.fasta.phmmerout.txt"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_nameless_headers_fail(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">\nM\n")
    with pytest.raises(Exception, match="no name"):
        files.sequences(spark, str(tmp_path)).collect()


def test_native_run_and_resume(spark, proteomes):
    done = run(spark, Config(str(proteomes), search_backend="native"))
    assert names_of(done.groups) == WANT
    assert done.statistics.first().asDict() == {"n_genes": 7, "n_edges": 6, "n_orthogroups": 3, "n_single_copy": 2, "n_singletons": 1}
    lines = [x.value for x in spark.read.text(str(proteomes / "orthogroups")).collect()]
    assert lines == ["OG0: one0 one1 one2", "OG1: two0 two1 two2", "OG2: lone"]
    counts = [x.value for x in spark.read.text(str(proteomes / "gene_count")).collect()]
    assert counts == ["files: ant.fa bee.faa cat_2_dog.pep", "OG0: 1 1 1", "OG1: 1 1 1", "OG2: 1 0 0"]
    assert [x.value for x in spark.read.text(str(proteomes / "single_copy_names")).collect()] == ["OG0", "OG1"]
    text = (proteomes / "orthogroup_sequences" / "OG0.fa").read_text()
    assert text.count(">") == 3 and max(map(len, text.splitlines())) == 70
    single = (proteomes / "single_copy_sequences" / "OG0.fa").read_text()
    assert [x for x in single.splitlines() if x[0] == ">"] == [">ant|one0", ">bee|one1", ">cat_2_dog|one2"]
    again = run(spark, Config(str(proteomes), start="search_res", stop="infer"))
    assert names_of(again.groups) == WANT and sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, done.edges.collect()))
    assert cli.parser().parse_args([str(proteomes), "-m", "mcl", "--compat", "--taxon_order", "a,b"]).taxon_order == ("a", "b")


def test_program_runs_once_a_pair(spark, proteomes, program, tmp_path_factory):
    path, log = program
    out = tmp_path_factory.mktemp("out")
    config = Config(str(proteomes), str(out), phmmer=str(path), cpu=1)
    done = run(spark, config)
    assert names_of(done.groups) == WANT and len(log.read_text().splitlines()) == 9
    table = out / "working" / "ant.fa_2_cat_2_dog.pep.phmmerout.txt"
    assert table.read_text().endswith("# [ok]\n")
    table.write_text(table.read_text()[:-6])  # cut short: this pair alone is searched again
    assert names_of(run(spark, config).groups) == WANT
    assert log.read_text().splitlines()[9:] == ["ant.fa cat_2_dog.pep"]
    resumed = run(spark, Config(str(proteomes), str(out), start="search_res"))
    assert sorted(map(tuple, resumed.edges.collect())) == sorted(map(tuple, done.edges.collect()))
    assert len(list((out / "orthogroup_sequences").glob("OG*.fa"))) == 3


def test_one_name_in_two_collections(spark, tmp_path):
    rng = random.Random(4)
    one, two = family(rng, 2), family(rng, 2)
    (tmp_path / "a.fa").write_text(f">x\n{one[0]}\n>p\n{two[0]}\n")
    (tmp_path / "b.fa").write_text(f">x\n{two[1]}\n>q\n{one[1]}\n")
    done = run(spark, Config(str(tmp_path), search_backend="native"))
    assert names_of(done.groups) == {frozenset({"a.fa|x", "q"}), frozenset({"b.fa|x", "p"})}
    assert done.groups.count() == 4 and all(n.count(">") == 2 for n in (p.read_text() for p in (tmp_path / "orthogroup_sequences").glob("OG*.fa")))


def test_unknown_records_fail_a_run(spark, proteomes):
    (proteomes / "working").mkdir()
    (proteomes / "working" / "ant.fa_2_bee.faa.phmmerout.txt").write_text("nobody - one0 - 1e-9 50 0 1 1\n")
    with pytest.raises(ValueError, match="unknown record"):
        run(spark, Config(str(proteomes), start="search_res"))


def test_prepare_only(spark, proteomes):
    plan = run(spark, Config(str(proteomes), stop="prepare", cpu=1)).plan
    assert plan.count() == 9 and plan.first()["command"].startswith("phmmer --mx BLOSUM62 --noali --notextw --cpu 1")


def test_settings(tmp_path, program):
    here = str(tmp_path)
    for bad in ({"start": "x"}, {"stop": "x"}, {"evalue": 0}, {"inflation_value": 1}, {"substitution_matrix": "X"}, {"start": "search_res", "stop": "prepare"}, {"output_directory": "/no/such"}, {"phmmer": "/no/such"}, {"search_backend": "x"}, {"cpu": 0}):
        with pytest.raises(ValueError):
            Config(here, **{"phmmer": str(program[0])} | bad)
    with pytest.raises(ValueError):
        Config("/no/such")
    config = Config(here, phmmer=str(program[0]), cpu=10_000)
    assert 1 <= config.cpu < 10_000 and f"folder of sequences: {here}" in settings(config, 3) and "start: NA" in settings(config, 3)


def test_lists_of_edges_and_clusters(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 1.5), ("c", "b", 0.25)], "src string, dst string, weight double")
    sinks.write_text(sinks.edge_lines(edges), str(tmp_path / "edges"))
    assert sorted(map(tuple, files.edge_list(spark, str(tmp_path / "edges")).collect())) == [("a", "b", 1.5), ("b", "c", 0.25)]
    (tmp_path / "clusters").write_text("b\ta\n\nz\n")
    assert sorted(map(tuple, files.cluster_file(spark, str(tmp_path / "clusters")).collect())) == [("a", "a"), ("b", "a"), ("z", "z")]


def test_streams_of_hits(spark, tmp_path):
    hits = spark.createDataFrame([("A", "B", "q", "t", 1.0, 0), ("A", "B", "q", "t", 3.0, 60), ("A", "B", "q", "t", 2.0, 4000), ("A", "B", "q", "u", 2.0, 0)], "qt string, tt string, query string, target string, s double, at long").selectExpr("qt", "tt", "query", "target", "s", "timestamp_seconds(at) as ts")
    hits.write.parquet(str(tmp_path / "in"))
    got = []
    stream = incremental.best_scores(spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in")), width="1 hour")
    incremental.on_batches(stream, lambda batch, _: got.extend((r.target, r.window.start.hour - 0, r.s) for r in batch.collect()), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((t, s) for t, _, s in got) == [("t", 2.0), ("t", 3.0), ("u", 2.0)]


def test_staged_tables(spark):
    t, n = staging.stage_counted(spark.range(5), "five")
    assert n == t.count() == 5
    staging.unstage(t)
    with pytest.raises(Exception, match="not exist|PATH_NOT_FOUND|FAILED_READ"):
        spark.read.parquet(t.staged_at).count()


def test_a_stream_of_hits_ends_in_the_batch_edges(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for f in range(8):
        for a in range(4):
            for b in range(4):
                rows.append((f"t{a}", f"t{b}", f"g{f}_{a}", f"g{f}_{b}", rng.choice([1.0, 1.5, 2.0]) + (a == b), len(rows)))
    rows += [(*r[:4], r[4] - 0.5, r[5] + 1000) for r in rows[::3]]  # hits that come again with a lower score
    rng.shuffle(rows)
    schema = "qt string, tt string, query string, target string, s double, line_no long"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.parquet(str(tmp_path / "parts" / str(k)))
    (tmp_path / "in").mkdir()
    for k in range(3):
        next((tmp_path / "parts" / str(k)).glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
    store = incremental.HitStore(str(tmp_path / "store"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.on_batches(stream.where("s > 0"), store.fold, str(tmp_path / "checkpoint"), "append").awaitTermination()
    assert store.versions(spark) == [1, 2]
    edges = lambda t: sorted(map(tuple, network.from_hits(t).collect()))
    want = edges(spark.createDataFrame(rows, schema))
    assert len(want) > 20 and edges(store.hits(spark)) == want
    before = sorted(map(tuple, store.hits(spark).collect()))
    store.fold(spark.createDataFrame(rows[2::3], schema), 2)  # a batch that runs again
    assert sorted(map(tuple, store.hits(spark).collect())) == before


def test_tables_written_together_are_read_as_tables_alone(spark, tmp_path):
    names = ["a.fa", "a_2_b.fa", "b.fa", "2_b.fa"]
    text = {(q, t): "# target query\n" + "\n".join(f"{t}{k} - {q}{k} - 1e-9 {50 + k} 0 1 1 a # b" for k in range(3 + len(q))) + "\n\n" for q in names for t in names}
    for folder in ("alone", "together"):
        (tmp_path / folder).mkdir()
    for (q, t), x in text.items():
        (tmp_path / "alone" / f"{q}_2_{t}.phmmerout.txt").write_text(x + "# [ok]\n")
    files.write_tables(spark.createDataFrame([(f"{q}_2_{t}.phmmerout.txt", x) for (q, t), x in text.items()], "name string, text string").repartition(3), str(tmp_path / "together"))
    assert files.has_tables(spark, str(tmp_path / "together")) and not files.has_tables(spark, str(tmp_path))
    listed = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "taxon string, taxon_idx int")
    alone, together = ({tuple(r) for r in files.search_tables(spark, str(tmp_path / x), listed).collect()} for x in ("alone", "together"))
    assert alone == together and len(list((tmp_path / "together" / files.BUNDLE).glob("part-*"))) == 3
    crossed = {tuple(r) for r in files.taxon_pairs(listed).selectExpr("concat(qt, '_2_', tt, '.phmmerout.txt') as file", "qt", "tt").collect()}
    assert {tuple(r) for r in files.pairs_of(spark.createDataFrame([(f,) for f in {x[0] for x in crossed}], "file string"), listed).collect()} == crossed
