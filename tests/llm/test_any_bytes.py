"""Every operator on documents with nulls, blanks, a long text, bytes that are no UTF-8, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

from cladeflow.llm import langid, license_scan, line_dedup, mixing, quality, sanitise, sigtree, spm, tiff, xent
from cladeflow.llm.queries import pieces_path

TEXTS = ["null", "''", "'  \\n\\t '", "'plain words of one text here'", "'plain words of one text here'", "repeat('long text ', 100000)", "cast(unhex('FF61FE20E228') as string)", "cast(unhex('C3') as string)"]
OPERATORS = {
    "licences": license_scan.scan_digest,
    "mixing": mixing.mix_digest,
    "quality": lambda d: quality.classify(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality")).distinct()),
    "jaccard": sigtree.jaccard_components,
    "language": langid.identify,
    "pieces": lambda d: spm.encode_column(d, spm.load(d.sparkSession, pieces_path(d.sparkSession))),
    "losses": lambda d: xent.cross_entropy_difference(d, d.where("doc_id = 3").select("doc_id")),
    "lines": line_dedup.dedup_lines,
    "tiff": tiff.text_media_digest,
    "sanitise": sanitise.pii_digest,
}
#: Operators that give a row an id, and not a row a row.
BY_ID = {"losses"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = " union all ".join(f"select {min(k, 5) if k != 4 else 3}L as doc_id, {t} as text, 'en' as lang, 's' as source, 1 as n_tokens, 'x' as ids, 2 as row, 3L as k, 9L as n_chars" if k < 6 else f"select {k}L, {t}, null, null, null, null, null, null, null" for k, t in enumerate(TEXTS))
    return spark.sql(rows)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_any_bytes(docs, name):
    got = OPERATORS[name](docs).select("doc_id").collect()
    want = [0, 1, 2, 3, 3, 5, 6, 7]
    assert sorted({r[0] for r in got}) == sorted(set(want)) and (name in BY_ID or len(got) == len(want))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(docs, name):
    assert OPERATORS[name](docs.where("doc_id < 0")).count() == 0


def test_what_bad_bytes_become(docs):
    import hashlib

    raw = bytes.fromhex("FF61FE20E228")
    r = tiff.text_media_digest(docs).where("doc_id = 6").first()
    assert r["n_bytes"] == 6 and r["payload_sha256"] == hashlib.sha256(raw.ljust(192)).hexdigest()
    model = spm.load(docs.sparkSession, pieces_path(docs.sparkSession))
    r = spm.encode_column(docs, model).where("doc_id = 6").first()
    assert not r["round_trip"] and r["ids"] == spm.encode_column(docs.sparkSession.createDataFrame([(1, raw.decode("utf-8", "replace"))], "doc_id long, text string"), model).first()["ids"]
