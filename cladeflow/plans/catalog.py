"""All queries of the library by name, with their SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions.staging import shared_dir, stage, table
from cladeflow.operators import components, karlin, mcl, orthogroups, scoring, search, substitution
from cladeflow.plans import corpus
from cladeflow.plans.run import Config, run
from cladeflow.sources import fasta, files, sinks

# The chain of common table expressions that the SQL of the documents shares.
CHAIN = r"""
with ws as (select doc_id, source, regexp_split_to_array(lower(trim(text)), '\s+') as w from documents),
gene as (select source as taxon, doc_id as name, cast(len(w) - 4 as bigint) as length from ws where len(w) >= 5),
sh as (select doc_id, source, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as g
       from (select doc_id, source, w, unnest(range(1, len(w) - 3)) as i from ws where len(w) >= 5)),
occ as (select doc_id, source, g, count(*) as n from sh group by all),
rare as (select g from occ group by g having count(*) between 2 and 50),
hit as (select a.source as qt, b.source as tt, a.doc_id as query, b.doc_id as target, cast(sum(a.n) as bigint) as score
        from occ a join rare using (g) join occ b using (g) group by all),
norm as (select h.*, cast(score as double) / (q.length + t.length) as s from hit h
         join gene q on q.name = h.query join gene t on t.name = h.target where score >= 10),
best as (select qt, tt, query, target, s from
         (select *, row_number() over (partition by qt, tt, query order by s desc, target) as k from norm) where k = 1),
rbh as (select x.qt, x.tt, x.query, x.target, (x.s + y.s) / 2 as m from best x join best y
        on x.qt = y.tt and x.tt = y.qt and x.query = y.target and x.target = y.query),
corr as (select least(qt, tt) as lo, greatest(qt, tt) as hi, avg(m) as corr from rbh group by all),
thr as (select query, min(m / corr) as thr from rbh join corr on lo = least(qt, tt) and hi = greatest(qt, tt) group by all),
edge as (select least(n.query, n.target) as src, greatest(n.query, n.target) as dst, max(s / corr) as weight
         from norm n join corr on lo = least(qt, tt) and hi = greatest(qt, tt) join thr on thr.query = n.query
         where n.query <> n.target and s / corr >= thr - 1e-9 group by all)
"""

#: The chain on files of a hundred documents, with their names in the files.
FILED = CHAIN.replace("from documents)", "from (select 'd' || lpad(cast(doc_id as varchar), 12, '0') as doc_id, 'OG' || (doc_id // 100) || '.fa' as source, text from documents))")

REACH = CHAIN.replace("\nwith ws", "\nwith recursive ws", 1) + """,
ends as (select src as a, dst as b from edge union all select dst, src from edge),
reach as (select a as node, a as seen from ends union select r.node, b.b from reach r join ends b on b.a = r.seen)
"""


def _rounded_to(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return _rounded_to(df, 6, *names)


def _part_hits(spark: SparkSession, d: str) -> DataFrame:
    """Parts bought in one order: a collection is a brand, the score the number of orders."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    a = rows.select("l_orderkey", F.col("p_brand").alias("qt"), F.col("p_partkey").alias("query"))
    b = rows.select("l_orderkey", F.col("p_brand").alias("tt"), F.col("p_partkey").alias("target"))
    hits = a.join(b, "l_orderkey").where("query <> target").groupBy("qt", "tt", "query", "target").agg(F.count("*").cast("double").alias("s"))
    return hits.withColumn("line_no", F.col("target"))


def scan_genes(spark: SparkSession, d: str) -> DataFrame:
    return corpus.genes(spark, d).select("taxon", "name", F.col("length").cast("long").alias("length"))


def dup_id_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("taxon"), F.col("l_partkey").alias("name"))
    return files.duplicate_ids(rows)


def taxon_pairs(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "nation").select(F.col("n_name").alias("taxon"), F.col("n_nationkey").alias("taxon_idx"))
    return files.taxon_pairs(listed).select("qt", "tt")


def search_plan(spark: SparkSession, d: str) -> DataFrame:
    return search.commands(taxon_pairs(spark, d), "phmmer", "in", "out")


def kmer_occurrences(spark: SparkSession, d: str) -> DataFrame:
    occ = corpus.occurrences(spark, d)
    return occ.groupBy("doc_id").agg(F.sum("n").alias("n_shingles"), F.count("*").alias("n_distinct"), F.max("n").alias("most"))


def candidate_hits(spark: SparkSession, d: str) -> DataFrame:
    return corpus.hits(spark, d).select("qt", "tt", "query", "target", "score")


def candidate_hits_all(spark: SparkSession, d: str) -> DataFrame:
    """The hits of shingles of any number of documents."""
    return corpus.hits(spark, d, None).select("qt", "tt", "query", "target", "score")


def filter_evalue(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("len_q").cast("double") * F.col("len_t") * F.pow(F.lit(2.0), -F.col("score").cast("double"))
    hits = scoring.filter_hits(corpus.merged(spark, d).withColumn("evalue", e), 1e-4)
    return hits.select("qt", "tt", "query", "target", "score")


def merge_lengths(spark: SparkSession, d: str) -> DataFrame:
    return corpus.merged(spark, d).select("query", "target", "score", F.col("len_q").cast("long").alias("len_q"), F.col("len_t").cast("long").alias("len_t"))


def hit_evalues(spark: SparkSession, d: str) -> DataFrame:
    """Bits and E-values of the hits, their scores taken as raw ones under BLOSUM62 without gaps; a space is a collection's shingles."""
    space = corpus.genes(spark, d).groupBy(F.col("taxon").alias("tt")).agg(F.sum("length").alias("space"))
    rows = karlin.with_evalues(corpus.merged(spark, d).withColumnRenamed("score", "raw").join(space, "tt"), ungapped(), "len_q")
    return rows.select("query", "target", F.round("score", 6).alias("bits"), F.round(F.log10(F.greatest("evalue", F.lit(1e-300))), 6).alias("log_evalue"))


def ungapped() -> karlin.Statistics:
    return karlin.ungapped(substitution.residues("BLOSUM62"))


#: Of the search over documents' letters: the first length of a seed, the most documents of one, and the diagonals of a band.
SEED, COMMON, BAND = 16, 20, 64


def native_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of unlike documents by their seeds; equal letters are one class, named by the smallest doc_id."""
    classes = stage(corpus.letters(spark, d).groupBy("seq").agg(F.min("name").alias("id")), "classes")
    return search.seed_pairs(search.seeds(classes, SEED, COMMON, groups=None))


def native_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the native search over documents' letters, aligned around the diagonals of their seeds."""
    hits = search.native(corpus.letters(spark, d), SEED, common=COMMON, groups=None, band=BAND)
    return _rounded(hits.select("qt", "tt", "query", "target", "score", F.log10(F.greatest("evalue", F.lit(1e-300))).alias("log_evalue")), "score", "log_evalue")


def norm_score(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(corpus.norm_hits(spark, d).select("query", "target", "s"), "s")


def best_hit(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.best_hits(corpus.norm_hits(spark, d)), "s")


def best_hit_parts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.best_hits(_part_hits(spark, d))


def reciprocal_best_hits(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.reciprocal_best_hits(scoring.best_hits(corpus.norm_hits(spark, d))), "m")


def pair_correction(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.pair_correction(scoring.reciprocal_best_hits(scoring.best_hits(corpus.norm_hits(spark, d)))), "corr")


def gene_threshold(spark: SparkSession, d: str) -> DataFrame:
    rbh = scoring.reciprocal_best_hits(scoring.best_hits(corpus.norm_hits(spark, d)))
    return _rounded(scoring.gene_threshold(rbh, scoring.pair_correction(rbh)).select("query", "thr"), "thr")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(corpus.edges(spark, d), "weight")


def edge_list_tsv(spark: SparkSession, d: str) -> DataFrame:
    return sinks.edge_lines(corpus.edges(spark, d).withColumn("weight", F.format_string("%.6f", "weight")))


def connected(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_components(corpus.edges(spark, d))


def mcl_converged(spark: SparkSession, d: str) -> DataFrame:
    return corpus.clusters(spark, d)


def mcl_round(spark: SparkSession, d: str) -> DataFrame:
    """The matrix after loops, normalisation and one expansion and inflation."""
    m = mcl.expanded(mcl.transition(corpus.edges(spark, d)), 1.5, prune=0.0)
    return _rounded_to(m, 5, "v").select("i", "j", "v")


def singletons(spark: SparkSession, d: str) -> DataFrame:
    e = corpus.edges(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return orthogroups.singletons(corpus.genes(spark, d), nodes).select("name", "taxon")


def _component_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups from connected components, which SQL can check; Markov clusters refine them."""
    clusters = connected(spark, d).withColumnRenamed("component", "cluster")
    return orthogroups.orthogroups(corpus.genes(spark, d), clusters)


def component_groups(spark: SparkSession, d: str) -> DataFrame:
    return _component_groups(spark, d).select("og_idx", "og_label", F.col("name"), "taxon")


def orthogroup_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.group_lines(corpus.groups(spark, d))


def gene_count_long(spark: SparkSession, d: str) -> DataFrame:
    return orthogroups.gene_counts(_component_groups(spark, d)).select("og_idx", "taxon", "n")


def gene_count_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Line items a return flag and line status, 0 filled."""
    rows = table(spark, d, "lineitem").select(F.year("l_shipdate").cast("long").alias("og_idx"), F.year("l_shipdate").cast("string").alias("og_label"), F.col("l_returnflag").alias("taxon"))
    return orthogroups.count_matrix(rows, ["A", "N", "R"])


def single_copy(spark: SparkSession, d: str) -> DataFrame:
    """Groups of one record a collection; the occupancy must exceed a twentieth."""
    g = _component_groups(spark, d)
    n = table(spark, d, "documents").select("source").distinct().count()
    return orthogroups.single_copy(g, n, 0.05).select("og_idx", "n", "taxa")


def single_copy_headers(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.genes(spark, d).select(F.concat("taxon", F.lit(".fa")).alias("taxon"), F.col("name").cast("string").alias("name"))
    return rows.select(orthogroups.taxon_header().alias("header"))


def fasta_wrap70(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[^!-~]", "").alias("seq"))
    return rows.select("doc_id", orthogroups.wrapped().alias("fasta"))


def og_names_compat(spark: SparkSession, d: str) -> DataFrame:
    return sinks.name_lines(_component_groups(spark, d))


def run_stats(spark: SparkSession, d: str) -> DataFrame:
    e = corpus.edges(spark, d)
    clusters = components.connected_components(e).withColumnRenamed("component", "cluster")
    g = stage(orthogroups.orthogroups(corpus.genes(spark, d), clusters), "groups")
    return orthogroups.run_statistics(corpus.genes(spark, d), e, g, orthogroups.single_copy(g, 20, 0.05))


def count_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a count file, with its header at -1."""
    return sinks.count_lines(gene_count_matrix(spark, d), ["A", "N", "R"])


def group_fasta(spark: SparkSession, d: str) -> DataFrame:
    """Each group's sequences under ``collection|record``, as one digest; a document's sequence is its letters."""
    seqs = table(spark, d, "documents").select(F.col("source").alias("taxon"), F.col("doc_id").alias("name"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))
    fasta = orthogroups.fasta_payload(_component_groups(spark, d), seqs, orthogroups.taxon_header())
    return fasta.select("og_idx", F.md5("fasta").alias("digest"))


# ---------------------------------------------------------------- whole runs on files


def edge_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """The network, written as a list of edges and read back."""
    path = f"{shared_dir(spark)}/cladeflow/edges-{uuid.uuid4().hex}"
    sinks.write_text(sinks.edge_lines(corpus.edges(spark, d)), path)
    return _rounded(files.edge_list(spark, path), "weight")


def cluster_scan(spark: SparkSession, d: str) -> DataFrame:
    """Connected components, written one a line and read back with their least name."""
    path = f"{shared_dir(spark)}/cladeflow/clusters-{uuid.uuid4().hex}"
    members = connected(spark, d).groupBy("component").agg(F.array_join(F.collect_list(F.col("node").cast("string")), "\t").alias("value"))
    sinks.write_text(members.select("value"), path)
    return files.cluster_file(spark, path)


def _record(c: Column) -> Column:
    return F.concat(F.lit("d"), F.lpad(c.cast("string"), 12, "0"))


def _as_file(c: Column, names: int = 100) -> Column:
    """The collection of a document in the queries on files: blocks of ``names`` doc_ids, so that no file grows with the table."""
    return F.concat(F.lit("OG"), F.floor(c / names).cast("string"), F.lit(".fa"))


def written(spark: SparkSession, d: str, seq: Column | None = None) -> str:
    """A new folder of sequence files with a record a document: its letters, or ``seq`` of its length."""
    folder = f"{shared_dir(spark)}/cladeflow/files-{uuid.uuid4().hex}"
    if seq is None:
        rows = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("seq"))
    else:
        rows = corpus.genes(spark, d).select(F.col("name").alias("doc_id"), seq.alias("seq"))
    rows = rows.select(F.floor(F.col("doc_id") / 100).alias("og_idx"), F.lit("x").alias("taxon"), _record(F.col("doc_id")).alias("name"), F.lit(0).alias("taxon_idx"), F.col("doc_id").alias("rec_idx"), "seq")
    sinks.write_group_files(orthogroups.fasta_texts(rows), folder)
    return folder


def fasta_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents' letters, written as sequence files and read back."""
    return files.sequences(spark, written(spark, d)).select("taxon", "rec_idx", "name", F.col("length").cast("long").alias("length"), F.md5("seq").alias("digest"))


def fasta_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents' letters, written as sequence files and read back through the data source in pieces of 64 KB."""
    rows = fasta.read(spark, written(spark, d), split=1 << 16)
    rows = files.numbered_records(rows, "taxon", "offset")
    return rows.select("taxon", "rec_idx", "name", F.col("length").cast("long").alias("length"), F.md5("seq").alias("digest"))


def group_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of groups as the data source writes them: each one's records and a digest of its bytes."""
    folder = f"{shared_dir(spark)}/cladeflow/groups-{uuid.uuid4().hex}"
    seqs = table(spark, d, "documents").select(F.col("source").alias("taxon"), F.col("doc_id").alias("name"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))
    fasta.write(orthogroups.fasta_records(_component_groups(spark, d), seqs, orthogroups.taxon_header()), folder, "taxon_idx", "rec_idx")
    found = fasta.read(spark, folder, "taxon string").groupBy(F.col("taxon").alias("file")).agg(F.count("*").alias("n"))
    return fasta.with_digests(found, folder)


def _tables(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """Writes the hits of the documents as search tables, one for each two files that have some, many in a file; the hits."""
    hit = corpus.hits(spark, d).where(F.col("score") >= corpus.MIN_SCORE)
    hit = hit.select(_as_file(F.col("query")).alias("qt"), _as_file(F.col("target")).alias("tt"), _record(F.col("query")).alias("query"), _record(F.col("target")).alias("target"), "score")
    line = F.concat_ws(" ", "target", F.lit("-"), "query", F.lit("-"), F.lit("1e-30"), F.col("score").cast("string"), F.lit("0.0 1e-30 1 0.0 1.0 1 0 0 1 1 1 1 a description"))
    lines = hit.groupBy("qt", "tt").agg(F.sort_array(F.collect_list(F.struct("target", "query", line.alias("t")))).alias("x"))
    text = F.concat(F.lit("# target query\n"), F.array_join(F.transform("x", lambda r: r["t"]), "\n"), F.lit("\n"))
    files.write_tables(lines.select(F.concat("qt", F.lit("_2_"), "tt", F.lit(".phmmerout.txt")).alias("name"), text.alias("text")), folder)
    return hit


def search_table_scan(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the documents, written as search tables and read back."""
    folder = f"{shared_dir(spark)}/cladeflow/tables-{uuid.uuid4().hex}"
    _tables(spark, d, folder)
    listed = table(spark, d, "documents").select(_as_file(F.col("doc_id")).alias("taxon")).distinct().withColumn("taxon_idx", F.lit(0))
    return files.search_tables(spark, folder, listed).select("qt", "tt", "query", "target", "score", "line_no")


def resumed_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole run from sequence files and finished search tables: the lines of its groups, as it wrote them.

    A record's sequence has as many residues as the document has shingles.
    """
    folder = written(spark, d, F.repeat(F.lit("M"), F.col("length")))
    _tables(spark, d, f"{folder}/working")
    run(spark, Config(folder, start="search_res"))
    return spark.read.text(f"{folder}/orthogroups")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (scan_genes, dup_id_check, taxon_pairs, search_plan, kmer_occurrences, candidate_hits, candidate_hits_all, filter_evalue, merge_lengths, hit_evalues, native_seeds, native_hits, norm_score, best_hit, best_hit_parts, reciprocal_best_hits, pair_correction, gene_threshold, edges, edge_list_tsv, mcl_converged, mcl_round, singletons, component_groups, orthogroup_lines, gene_count_long, gene_count_matrix, single_copy, single_copy_headers, fasta_wrap70, og_names_compat, run_stats, count_lines, group_fasta, edge_list_scan, cluster_scan, fasta_scan, fasta_source, group_files, search_table_scan, resumed_run)
    return {f.__name__: f for f in own} | {"connected_components": connected}


ROUNDS = 60


def _markov(chain: str) -> str:
    """``chain`` with Markov clusters: ``comp`` (node, cluster) after ROUNDS rounds of the whole matrix."""
    step = ["""b0 as materialized (select src as i, dst as j, weight as v from edge union all select dst, src, weight from edge),
m0 as materialized (select i, j, v / sum(v) over (partition by j) as v from (select i, j, v from b0 union all select j, j, max(v) from b0 group by j))"""]
    for k in range(ROUNDS):
        step.append(f"""p{k} as materialized (select a.i, b.j, pow(sum(a.v * b.v), 1.5) as v from m{k} a join m{k} b on a.j = b.i group by a.i, b.j),
m{k + 1} as materialized (select i, j, v / sum(v) over (partition by j) as v from (select *, max(v) over (partition by j) as top from p{k}) where v >= 1e-8 or v >= top)""")
    step.append(f"""strong as (select i, j, v from m{ROUNDS} where v > 1e-3),
sys as (select s.j as i, min(s.i) as system from strong s where s.j in (select i from strong) group by s.j),
mass as (select j as node, system, sum(v) as v from strong join sys on sys.i = strong.i group by all),
chosen as (select node, system from (select *, row_number() over (partition by node order by round(v, 9) desc, system) as k from mass) where k = 1),
comp as (select node, min(node) over (partition by system) as cluster from chosen)""")
    return chain + ", " + ",\n".join(step)


GROUPED = REACH + """,
comp as (select node, min(seen) as cluster from reach group by node),"""

NUMBERED = """
member as (select g.name, g.taxon, coalesce(c.cluster, g.name) as cluster, c.node is null as alone,
           cast(regexp_extract(g.taxon, '(\\d+)', 1) as int) as ti from gene g left join comp c on c.node = g.name),
grp as (select alone, cluster, count(*) as size, min(ti) as ti from member group by all),
ranked as (select *, cast(row_number() over (order by alone, case when alone then 0 else -size end,
           case when alone then ti else 0 end, cluster) - 1 as bigint) as og_idx from grp),
og as (select r.og_idx, m.name, m.taxon from member m join ranked r on r.alone = m.alone and r.cluster = m.cluster),
label as (select og_idx, 'OG' || lpad(cast(og_idx as varchar), cast(greatest(length(cast(og_idx as varchar)), (select length(cast(count(*) as varchar)) from ranked)) as int), '0') as og_label from ranked)
"""

GROUPED += NUMBERED


RECORDS = "select 'OG' || (doc_id // 100) || '.fa' as taxon, cast(row_number() over (partition by doc_id // 100 order by doc_id) - 1 as bigint) as rec_idx, 'd' || lpad(cast(doc_id as varchar), 12, '0') as name, length(s) as length, md5(s) as digest from (select doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') as s from documents)"


def _seeds() -> str:
    """Words at each place by length; those that are too common go on to the next length."""
    lengths = [math.ceil(SEED * x) for x in search.LEVELS]
    step = [f"""with s as (select seq, min(doc_id) as id from (select doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) as seq from documents) where seq <> '' group by seq),
w0 as (select id, p, """ + ", ".join(f"substr(seq, p + 1, {n}) as h{k}" for k, n in enumerate(lengths)) + f" from (select id, seq, unnest(range(0, greatest(length(seq) - {SEED}, 0) + 1)) as p from s))"]
    for k in range(len(lengths)):
        limit = f"where n <= {COMMON}" if k + 1 < len(lengths) else ""
        step.append(f"""c{k} as (select id, h{k}, min(p) as p from w{k} group by id, h{k}), n{k} as (select h{k}, count(*) as n from c{k} group by h{k} having count(*) > 1),
k{k} as (select id, p, '{k}' || h{k} as seed from c{k} join n{k} using (h{k}) {limit}),
w{k + 1} as (select w{k}.* from w{k} join n{k} using (h{k}) where n > {COMMON})""")
    step.append("seed as (" + " union all ".join(f"select * from k{k}" for k in range(len(lengths))) + ")")
    return ",\n".join(step) + f""",
bins as (select a.id as a, b.id as b, floor((b.p - a.p) / {search.NEAR}) as bin, count(*) as n, sum(b.p - a.p) as t from seed a join seed b on a.seed = b.seed and a.id < b.id group by all),
near as (select a, b, bin, sum(n) as n, sum(t) as t from (select a, b, bin, n, t from bins union all select a, b, bin + 1, n, t from bins) group by a, b, bin)
select a, b, cast(n as bigint) as shared, cast(floor(t / n) as bigint) as diagonal from (select *, row_number() over (partition by a, b order by n desc, bin) as k from near where n >= 2) where k = 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "native_seeds": _seeds(),
        "hit_evalues": CHAIN + f""", space as (select taxon, sum(length) as n from gene group by taxon)
select query, target, round(bits, 6) as bits, round(log10(greatest(cast(len as double) * n * pow(2, -bits), 1e-300)), 6) as log_evalue from
(select query, target, q.length as len, space.n, (score * {ungapped().rate!r} - {math.log(ungapped().kappa)!r}) / {math.log(2)!r} as bits from hit h join gene q on q.name = h.query join space on space.taxon = h.tt)""",
        "scan_genes": CHAIN + "select taxon, name, length from gene",
        "dup_id_check": "select l_orderkey as taxon, l_partkey as name, count(*) as n from lineitem group by all having count(*) > 1",
        "taxon_pairs": "select a.n_name as qt, b.n_name as tt from nation a cross join nation b",
        "search_plan": "select a.n_name as qt, b.n_name as tt, 'phmmer --mx BLOSUM62 --noali --notextw --cpu 1 --tblout out/' || a.n_name || '_2_' || b.n_name || '.phmmerout.txt in/' || a.n_name || ' in/' || b.n_name as command from nation a cross join nation b",
        "kmer_occurrences": CHAIN + "select doc_id, cast(sum(n) as bigint) as n_shingles, count(*) as n_distinct, max(n) as most from occ group by doc_id",
        "candidate_hits": CHAIN + "select qt, tt, query, target, score from hit",
        "candidate_hits_all": CHAIN.replace("count(*) between 2 and 50", "count(*) >= 2") + "select qt, tt, query, target, score from hit",
        "filter_evalue": CHAIN + "select qt, tt, query, target, score from hit h join gene q on q.name = h.query join gene t on t.name = h.target where cast(q.length as double) * t.length * pow(2, -cast(score as double)) < 1e-4",
        "merge_lengths": CHAIN + "select query, target, score, q.length as len_q, t.length as len_t from hit h join gene q on q.name = h.query join gene t on t.name = h.target",
        "norm_score": CHAIN + "select query, target, round(s, 6) as s from norm",
        "best_hit": CHAIN + "select qt, tt, query, target, round(s, 6) as s from best",
        "best_hit_parts": """with l as (select distinct l_orderkey, l_partkey, p_brand from lineitem join part on p_partkey = l_partkey),
n as (select a.p_brand as qt, b.p_brand as tt, a.l_partkey as query, b.l_partkey as target, cast(count(*) as double) as s
from l a join l b on a.l_orderkey = b.l_orderkey where a.l_partkey <> b.l_partkey group by all)
select qt, tt, query, target, s from (select *, row_number() over (partition by qt, tt, query order by s desc, target) as k from n) where k = 1""",
        "reciprocal_best_hits": CHAIN + "select qt, tt, query, target, round(m, 6) as m from rbh",
        "pair_correction": CHAIN + "select lo, hi, round(corr, 6) as corr from corr",
        "gene_threshold": CHAIN + "select query, round(thr, 6) as thr from thr",
        "edges": CHAIN + "select src, dst, round(weight, 6) as weight from edge",
        "connected_components": REACH + "select node, min(seen) as component from reach group by node",
        "mcl_round": CHAIN + """, b0 as (select src as i, dst as j, weight as v from edge union all select dst, src, weight from edge),
m0 as (select i, j, v from b0 union all select j, j, max(v) from b0 group by j),
m1 as (select i, j, v / sum(v) over (partition by j) as v from m0),
m2 as (select a.i, b.j, pow(sum(a.v * b.v), 1.5) as v from m1 a join m1 b on a.j = b.i group by a.i, b.j)
select i, j, round(v / sum(v) over (partition by j), 5) as v from m2""",
        "mcl_converged": _markov(CHAIN) + " select node, cluster from comp",
        "orthogroup_lines": _markov(CHAIN) + "," + NUMBERED + "select og.og_idx, og_label || ': ' || string_agg(cast(name as varchar), ' ' order by name) as value from og join label on label.og_idx = og.og_idx group by og.og_idx, og_label",
        "count_lines": "with m as (select cast(year(l_shipdate) as bigint) as y, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'N') as n, count(*) filter (l_returnflag = 'R') as r from lineitem group by 1) select cast(-1 as bigint) as og_idx, 'files: A N R' as value union all select y, y || ': ' || a || ' ' || n || ' ' || r from m",
        "group_fasta": GROUPED + """, line as (select og.og_idx, cast(regexp_extract(og.taxon, '(\\d+)', 1) as int) as ti, name, '>' || og.taxon || '|' || name || chr(10) || rtrim(regexp_replace(regexp_replace(d.text, '[^A-Za-z]', '', 'g'), '(.{70})', '\\1' || chr(10), 'g'), chr(10)) as t
from og join documents d on d.doc_id = og.name) select og_idx, md5(string_agg(t, chr(10) order by ti, name) || chr(10)) as digest from line group by og_idx""",
        "group_files": GROUPED + """, line as (select og.og_idx, cast(regexp_extract(og.taxon, '(\\d+)', 1) as int) as ti, name, '>' || og.taxon || '|' || name || chr(10) || rtrim(regexp_replace(regexp_replace(d.text, '[^A-Za-z]', '', 'g'), '(.{70})', '\\1' || chr(10), 'g'), chr(10)) as t
from og join documents d on d.doc_id = og.name) select 'OG' || og_idx || '.fa' as file, count(*) as n, md5(string_agg(t, chr(10) order by ti, name) || chr(10)) as digest from line group by og_idx""",
        "edge_list_scan": CHAIN + "select least(cast(src as varchar), cast(dst as varchar)) as src, greatest(cast(src as varchar), cast(dst as varchar)) as dst, round(weight, 6) as weight from edge",
        "cluster_scan": REACH + "select cast(node as varchar) as node, min(cast(node as varchar)) over (partition by c) as cluster from (select node, min(seen) as c from reach group by node)",
        "fasta_scan": RECORDS,
        "fasta_source": RECORDS,
        "search_table_scan": CHAIN + """select 'OG' || (query // 100) || '.fa' as qt, 'OG' || (target // 100) || '.fa' as tt, 'd' || lpad(cast(query as varchar), 12, '0') as query, 'd' || lpad(cast(target as varchar), 12, '0') as target, cast(score as double) as score,
cast(row_number() over (partition by query // 100, target // 100 order by target, query) - 1 as bigint) as line_no from hit where score >= 10""",
        "resumed_run": _markov(FILED) + "," + NUMBERED.replace("cast(regexp_extract(g.taxon, '(\\d+)', 1) as int)", "g.taxon").replace("then ti else 0", "then ti else ''") + "select og_label || ': ' || string_agg(name, ' ' order by name) as value from og join label on label.og_idx = og.og_idx group by og.og_idx, og_label",
        "edge_list_tsv": CHAIN + "select cast(src as varchar) || chr(9) || cast(dst as varchar) || chr(9) || printf('%.6f', weight) as value from edge",
        "fasta_wrap70": "select doc_id, rtrim(regexp_replace(regexp_replace(text, '[^!-~]', '', 'g'), '(.{70})', '\\1' || chr(10), 'g'), chr(10)) as fasta from documents",
        "singletons": CHAIN + "select name, taxon from gene where name not in (select src from edge union all select dst from edge)",
        "component_groups": GROUPED + "select og.og_idx, og_label, name, taxon from og join label on label.og_idx = og.og_idx",
        "gene_count_long": GROUPED + "select og_idx, taxon, count(*) as n from og group by all",
        "gene_count_matrix": "select cast(year(l_shipdate) as bigint) as og_idx, cast(year(l_shipdate) as varchar) as og_label, " + ", ".join(f"count(*) filter (l_returnflag = '{f}') as \"{f}\"" for f in "ANR") + " from lineitem group by 1, 2",
        "single_copy": GROUPED + "select og_idx, count(*) as n, count(distinct taxon) as taxa from og group by og_idx having count(*) = count(distinct taxon) and count(distinct taxon) / cast((select count(distinct source) from documents) as double) > 0.05",
        "single_copy_headers": CHAIN + "select taxon || '|' || cast(name as varchar) as header from gene",
        "og_names_compat": GROUPED + "select og_idx, og_label as value from label",
        "run_stats": GROUPED + """, sized as (select og_idx, count(*) as n, count(distinct taxon) as taxa from og group by og_idx)
select (select count(*) from gene) as n_genes, (select count(*) from edge) as n_edges, (select count(*) from sized) as n_orthogroups,
(select count(*) from sized where n = taxa and taxa / 20.0 > 0.05) as n_single_copy, (select count(*) from sized where n = 1) as n_singletons""",
    }
