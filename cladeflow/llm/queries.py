"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions.staging import table
from cladeflow.llm import ann, langid, license_scan, line_dedup, mixing, prefix_trie, quality, sanitise, sigtree, spm, tiff, whitening, xent

#: Vocabulary files are found here; they are never copied into the repository.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_digest(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.jaccard_components(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def pieces_path(spark: SparkSession) -> str:
    """The model file: what the session names in ``cladeflow.pieces``, by any path that Spark reads, or ``PIECES``."""
    return spark.conf.get("cladeflow.pieces", PIECES)


def op7_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return spm.encode_column(table(spark, sf_dir, "documents"), spm.load(spark, path or pieces_path(spark)))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = xent.cross_entropy_difference(table(spark, sf_dir, "documents"), good)
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    cut = F.aggregate("deleted_runs", F.lit(0), lambda t, r: t + r["last"] - r["first"] + 1)
    runs = F.array_join(F.transform("deleted_runs", lambda r: F.concat(r["first"].cast("string"), F.lit("-"), r["last"].cast("string"))), ",")
    return out.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), cut.cast("long").alias("n_deleted"), runs.alias("deleted_runs"), "text")


def op10_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media_digest(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), rebuild=True)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.pii_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_source_mixing": op2_source_mixing,
        "op3_quality_cotraining": op3_quality_cotraining,
        "op4_ann_search": op4_ann_search,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_language_id": op6_language_id,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_line_dedup": op9_line_dedup,
        "op10_tiff_pages": op10_tiff_pages,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_whitening": op12_whitening,
        "op13_sanitise": op13_sanitise,
    }


WORDS = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents)"""

#: Pairs of documents by their common shingles; components by transitive closure.
JACCARD = (
    WORDS
    + """,
sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w)),
n as (select doc_id, count(*) as n from sh group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
ends as (select a, b from link union all select b, a from link),
reach as (select a as node, a as seen from ends union select r.node, e.b from reach r join ends e on e.a = r.seen),
comp as (select node, min(seen) as c from reach group by node), deg as (select a, count(*) as n from ends group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(comp.c, d.doc_id) as component_id, coalesce(deg.n, 0) as n_links
from documents d left join n on n.doc_id = d.doc_id left join comp on comp.node = d.doc_id left join deg on deg.a = d.doc_id"""
)

#: Bigram models of the documents labelled good and of all, as in the module; ' s' and ' e' are no words.
LOSSES = (
    WORDS
    + """,
good as (select distinct doc_id from labels where quality = 1),
seq as (select w.doc_id, list_concat([' s'], w, [' e']) as x, g.doc_id is not null as t from w left join good g on g.doc_id = w.doc_id where len(w) > 0),
bi as (select doc_id, t, x[i] as h, x[i + 1] as w from (select doc_id, t, x, unnest(range(1, len(x))) as i from seq)),
c2 as (select h, w, count(*) as b, count(*) filter (t) as t from bi group by h, w),
c1 as (select w, sum(b) as b, sum(t) as t from c2 group by w), ch as (select h, sum(b) as b, sum(t) as t from c2 group by h),
total as (select sum(b) as b, sum(t) as t, count(*) filter (w <> ' e') + 2 as v from c1),
loss as (select c2.h, c2.w, ln(ch.b + 100) - ln(c2.b + 100 * (c1.b + 1) / (total.b + v)) as b, ln(ch.t + 100) - ln(c2.t + 100 * (c1.t + 1) / (total.t + v)) as t
  from c2 join c1 using (w) join ch using (h) cross join total),
doc as (select doc_id, count(*) as n, sum(loss.t) as t, sum(loss.b) as b from bi join loss on loss.h = bi.h and loss.w = bi.w group by doc_id)
select d.doc_id, coalesce(n, 0) as n_tokens, round(t / n, 6) as target_loss, round(b / n, 6) as background_loss, round((t - b) / n, 6) as score
from (select distinct doc_id from documents) d left join doc on doc.doc_id = d.doc_id"""
)

#: Diagonals of equal lines hold the repeated runs; of these, the shortest of 50 words that begin or end at a line are cut.
LINES = r"""with l as (select doc_id, i, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as k,
  row_number() over (partition by doc_id order by i) - 1 as s from (select doc_id, i, trim(x[i + 1], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as t
  from (select doc_id, x, unnest(range(0, len(x))) as i from (select doc_id, string_split(text, chr(10)) as x from documents where text is not null))) where t <> ''),
c as (select *, sum(k) over (partition by doc_id order by s) as upto from l),
twice as (select t from l group by t having count(*) > 1),
h as (select c.* from c join twice using (t)),
same as (select b.doc_id, b.s, a.doc_id as d2, b.s - a.s as gap from h a join h b on a.t = b.t and (a.doc_id < b.doc_id or (a.doc_id = b.doc_id and a.s < b.s))),
run as (select doc_id, d2, gap, min(s) as s1, max(s) as s2 from (select *, s - row_number() over (partition by doc_id, d2, gap order by s) as g from same) group by doc_id, d2, gap, g),
long as (select distinct r.doc_id, s1, s2 from run r join c x on x.doc_id = r.doc_id and x.s = s1 join c y on y.doc_id = r.doc_id and y.s = s2 where y.upto - x.upto + x.k >= 50),
cand as (
  select x.doc_id, x.s as p1, (select min(y.s) from c y where y.doc_id = x.doc_id and y.upto - x.upto + x.k >= 50) as p2 from c x where x.doc_id in (select doc_id from long)
  union select y.doc_id, (select max(x.s) from c x where x.doc_id = y.doc_id and y.upto - x.upto + x.k >= 50), y.s from c y where y.doc_id in (select doc_id from long)),
cut as (select distinct a.doc_id, x.i as i1, y.i as i2 from cand a join long r on r.doc_id = a.doc_id and r.s1 <= p1 and p2 <= r.s2
  join c x on x.doc_id = a.doc_id and x.s = p1 join c y on y.doc_id = a.doc_id and y.s = p2),
gone as (select distinct doc_id, unnest(range(i1, i2 + 1)) as i from cut),
part as (select doc_id, min(i) as first, max(i) as last from (select doc_id, i, i - row_number() over (partition by doc_id order by i) as g from gone) group by doc_id, g),
runs as (select doc_id, sum(last - first + 1) as n, string_agg(first || '-' || last, ',' order by first) as runs from part group by doc_id),
kept as (select doc_id, string_agg(x[i + 1], chr(10) order by i) as text, count(*) as n from (select doc_id, x, unnest(range(0, len(x))) as i from (select doc_id, string_split(text, chr(10)) as x from documents where text is not null)) k
  where not exists (select 1 from gone g where g.doc_id = k.doc_id and g.i = k.i) group by doc_id)
select d.doc_id, case when d.text is null then null else greatest(coalesce(kept.n, 0), 1) end as n_lines, cast(coalesce(runs.n, 0) as bigint) as n_deleted, coalesce(runs.runs, '') as deleted_runs,
case when d.text is null then null else coalesce(kept.text, '') end as text from documents d left join runs on runs.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id"""


#: Nodes by the whole text of their turns, and every node joined to all its ancestors.
TRIE = """with t as (select conv_id, coalesce(role, '') as r, coalesce(text, '') as x,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p from conversations where conv_id is not null),
ids as (select c, xor(list_reduce(list_transform(string_split(cast(c as varchar), ''), lambda a: cast(ascii(a) as bigint)),
  lambda s, b: list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(s, b)), cast(4294967295 as bigint)), 4294967295) % 9 as h from (select distinct conv_id as c from t)),
b as (select c, p as k, r, x from ids join t on t.conv_id = c - c % 5 and p <= h union all select c, 9 + p, r, x from ids join t on t.conv_id = c and p > h),
d as (select c, row_number() over (partition by c order by k) as d, r, x from b),
pre as (select c, d, string_agg(strlen(r) || ':' || r || strlen(x) || ':' || x, '') over (partition by c order by d) as key, strlen(x) as n from d union all select c, 0, '', 0 from ids),
last as (select c, max(d) as m from pre group by c),
node as (select d, key, min(c) as id, count(*) as n, any_value(n) as size, string_agg(cast(c as varchar), ',' order by c) filter (d = m) as ends from pre join last using (c) group by d, key),
up as (select v.id, v.d, v.n, v.size, a.id as aid, a.d as ad from node v join pre on pre.c = v.id and pre.d <= v.d join node a on a.d = pre.d and a.key = pre.key),
kids as (select aid, ad, count(*) as n from up where ad = d - 1 group by 1, 2),
sums as (select up.aid, up.ad, sum((up.n - 1) * size) as saved, count(*) filter (kids.n is null) as leaves from up left join kids on kids.aid = up.id and kids.ad = up.d group by 1, 2)
select v.id as conv_id, v.d as depth, p.aid as parent_conv_id, v.n as n_convs, coalesce(kids.n, 0) as n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from node v join sums on sums.aid = v.id and sums.ad = v.d left join kids on kids.aid = v.id and kids.ad = v.d left join up p on p.id = v.id and p.d = v.d and p.ad = v.d - 1"""


def _found(kind: int, pattern: str) -> str:
    return f"select rid, {kind} as kind, regexp_split_to_array(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}') as found from d"


def _strung(rows: str) -> str:
    return f"select rid, string_agg(k || ':' || start || ':' || stop, ',' order by start, kind) as s from (select *, (['email', 'ip', 'card', 'phone', 'term'])[kind + 1] as k from {rows}) group by rid"


LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
LOWERED = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: Spans of the patterns; then terms by the tokens between the borders of an entity's context.
SPANS = "\nunion all ".join([
    _found(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), _found(1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    _found(2, r"[0-9]([\x20-]?[0-9])+"), _found(3, r"\+[0-9][\x20().0-9-]+[0-9]"), _found(4, r"[^\x20\x09-\x0D]+"),
])
PERSONAL = f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
f as ({SPANS}),
p as (select rid, kind, m, stop - length(m) as start, stop from (select *, sum(length(gap) + length(m)) over (partition by rid, kind order by i) as stop
  from (select rid, kind, i, gaps[i] as gap, found[i] as m from (select *, unnest(range(1, len(found) + 1)) as i from f)))),
e as (select *, case kind when 0 then translate(m, {LOWERED}) when 1 then m else regexp_replace(m, '[^0-9]', '', 'g') end as value from p where kind < 4),
s as (select rid, kind, start, stop, kind || ':' || value as entity from e where case kind when 0 then true
  when 1 then len(list_filter(string_split(m, '.'), lambda x: coalesce(try_cast(x as bigint), 256) > 255)) = 0
  when 2 then length(value) between 12 and 19 and list_sum(list_transform(range(1, length(value) + 1), lambda i:
    case when i % 2 = 1 then cast(value[length(value) + 1 - i] as int) else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][cast(value[length(value) + 1 - i] as int) + 1] end)) % 10 = 0
  else length(value) between 9 and 15 end),
w as (select rid, start, stop, core, translate(core, {LOWERED}) as term, start + length(opened) as a from
  (select rid, start, stop, regexp_extract(m, '^["''(\\[{{<]*({LETTERS}+)[.,;:!?)\\]}}>"'']*$', 1) as core, regexp_extract(m, '^["''(\\[{{<]*') as opened from p where kind = 4) where core <> ''),
near as (select distinct s.rid, entity, term, a, a + length(core) as b from s join d using (rid) join w using (rid)
  where (w.stop < s.start and (s.start < 128 or w.start > (s.start // 64 - 1) * 64))
  or (w.start > s.stop and (w.stop < ((s.stop - 1) // 64 + 2) * 64 or ((s.stop - 1) // 64 + 2) * 64 >= length(d.text)))),
known as (select entity, count(distinct rid) as n from s group by entity having n >= 2),
pair as (select entity, term, count(distinct rid) as n from near where entity in (select entity from known) group by entity, term having count(distinct rid) >= 2),
held as (select term, count(distinct rid) as n from w group by term), total as (select count(*) as n from d),
told as (select entity, term from pair join known using (entity) join held using (term) cross join total
  where known.n < total.n and 1 + log2(least(pair.n / held.n, 1)) / log2(total.n / known.n) >= 0.85),
t as (select distinct rid, a as start, b as stop, 4 as kind from near join told using (entity, term)),
base as ({_strung("s")}), every as ({_strung("(select rid, kind, start, stop from s union all select rid, kind, start, stop from t)")}),
n as (select rid, count(*) filter (kind = 0) as e, count(*) filter (kind = 1) as i, count(*) filter (kind = 2) as c, count(*) filter (kind = 3) as p from s group by rid), m as (select rid, count(*) as n from t group by rid)
select doc_id, coalesce(n.e, 0) as n_email, coalesce(n.i, 0) as n_ip, coalesce(n.c, 0) as n_card, coalesce(n.p, 0) as n_phone, sha256(coalesce(base.s, '')) as base_sha256, coalesce(every.s, '') as spans, coalesce(m.n, 0) as n_terms
from d left join base using (rid) left join every using (rid) left join n using (rid) left join m using (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_jaccard": JACCARD, "op8_lm_scoring": LOSSES, "op9_line_dedup": LINES, "op11_prefix_trie": TRIE, "op13_sanitise": PERSONAL}
