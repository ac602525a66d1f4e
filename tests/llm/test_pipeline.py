import random

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from cladeflow.functions.staging import stage
from cladeflow.llm.queries import oracle_sql, queries


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        docs = stage(step(spark, docs, sf), name)
        sizes.append(docs.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert sizes[0] >= sizes[1] == sizes[2] >= sizes[3] and sizes[5] == sizes[4] > 0
    assert docs.where("not round_trip").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "source_mixing", "sentencepiece"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, parts string, deleted_runs int, `_w` long, tokens string"


def prose(rng, n):
    return " ".join(rng.choices(["river", "stone", "walks", "over", "green", "hills", "and", "sings", "about", "winter"], k=n)) + f" {rng.random()}"


def test_stages_on_odd_rows(spark):
    rng = random.Random(1)
    row = lambda i, t, lang="en", source="s": (i, t, lang, source, None if t is None else len(t), 7, "p", 3, 9, "t")
    passage = "\n".join(prose(rng, 12) for _ in range(6))
    rows = [row(i, prose(rng, 30), source=rng.choice(["a", "b", None])) for i in range(60)]
    rows += [row(100, passage), row(101, "own line here\n" + passage + "\nanother line here"), row(102, prose(rng, 20_000))]
    rows += [row(110, rows[5][1]), row(111, rows[5][1]), rows[7], rows[7]]  # copies, and a row three times
    rows += [row(120, None), row(121, ""), row(122, "12 34"), row(None, prose(rng, 30)), row(123, prose(rng, 25), lang=None, source=None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = {r[0]: r[1] for r in rows}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(step(spark, docs, "/nowhere"), name)
        got, had = docs.collect(), before.collect()
        if k < 4:
            assert docs.columns == before.columns and all((r.key, r.parts, r.deleted_runs, r["_w"], r.tokens) == (7, "p", 3, 9, "t") for r in got)
        ids = lambda t: sorted(r.doc_id for r in t if r.doc_id is not None)
        if name == "language_id":
            assert set(ids(had)) - set(ids(got)) == {120, 121, 122}
            assert len(got) == len(had) - 3
        if name == "line_dedup":
            cut = {r.doc_id: r.text for r in got}
            assert len(got) == len(had) and cut[100] == passage and cut[101] == "own line here\nanother line here"
            assert all(r.text == texts[r.doc_id] for r in got if r.doc_id != 101 and r.doc_id is not None)
        if name == "near_duplicates":
            assert set(ids(had)) - set(ids(got)) == {110, 111} and sum(r.doc_id == 7 for r in got) == 3 and sum(r.doc_id is None for r in got) == 1
        if name == "source_mixing":
            size = lambda t: sum(len((r.text or "").split()) for r in t)
            assert abs(size(got) - size(had)) <= 3 and all(n <= 3 * m for n, m in ((sum(x.doc_id == i for x in got), sum(x.doc_id == i for x in had)) for i in set(ids(got))))
        if name == "sentencepiece":
            assert len(got) == len(had) and all(r.round_trip for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        empty = step(spark, empty, "/nowhere")
        assert empty.count() == 0 and (k == 4 or empty.columns == SCHEMA.replace("`", "").replace(" long", "").replace(" string", "").replace(" int", "").split(", "))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(oracle_sql()[name]).df()
    got = queries()[name](spark, sf).toPandas()[list(want.columns)]
    # either side may hold a null number as NaN or NA, and its column as floats
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else getattr(v, "item", lambda: v)()
    rows = lambda t: sorted(repr([plain(v) for v in r]) for r in t.itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_names():
    names = sorted(int(k[2:].split("_")[0]) for k in queries())
    assert names == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
