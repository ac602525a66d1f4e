import hashlib
import random
import zlib

import numpy as np
import pytest

from cladeflow.llm import ann, tiff

rng = random.Random(6)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 191, 192, 193, 5000, 70000])
def test_codecs_and_round_trip(n):
    for data in (bytes(rng.choices(range(256), k=n)), b"a" * n, bytes(rng.choices(b"ab  ", k=n))):
        assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data
        media, size = tiff.text_to_tiff(data, page_rows=100)
        back = b"".join(p[4] for p in tiff.read_pages(media))
        assert back == data.ljust(size) and size % 192 == 0 and size >= max(192, n)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("form", [{"tile": 16}, {"rows_per_strip": 7}, {"tile": 32, "predictor": True}, {"order": ">", "predictor": True}])
def test_pages(compression, form):
    pages = [np.array(rng.choices(range(256), k=h * w * 3), np.uint8).reshape(h, w, 3) for h, w in ((33, 50), (1, 1), (16, 64))]
    got = list(tiff.read_pages(tiff.write_tiff(pages, compression, **form)))
    assert [(p[0], p[1], p[4]) for p in got] == [(x.shape[1], x.shape[0], x.tobytes()) for x in pages]


def test_media_column(spark):
    good = tiff.write_tiff([np.zeros((2, 2, 3), np.uint8)] * 2, tiff.LZW)
    rows = [(1, good), (2, None), (3, b""), (4, b"junk"), (5, good[:-40]), (1, good)]
    got = tiff.media_pages(spark.createDataFrame(rows, "k long, m binary"), "k", "m").collect()
    assert sorted((r.k, r.page, r.error is None) for r in got if r.k != 5) == [(1, 0, True), (1, 0, True), (1, 1, True), (1, 1, True), (4, 0, False)]
    assert any(r.k == 5 and r.error for r in got)


def test_damaged_media_never_raise_another_error(spark):
    pages = [np.array(rng.choices(range(256), k=20 * 30 * 3), np.uint8).reshape(20, 30, 3)] * 2
    kept = []
    for compression in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for form in ({}, {"tile": 16, "order": ">"}):
            good = tiff.write_tiff(pages, compression, **form)
            for _ in range(150):
                bad = bytearray(good)
                for _ in range(rng.randrange(1, 4)):
                    at = rng.randrange(len(bad)) if rng.random() < 0.5 else rng.randrange(len(bad) - 250, len(bad))
                    bad[at] = rng.choice([0, 255, 128, rng.randrange(256)])
                kept.append(bytes(bad[: rng.choice([len(bad), rng.randrange(len(bad))])]))
                try:
                    list(tiff.read_pages(kept[-1]))
                except tiff.TiffError:
                    pass

    def tagged(tag, kind, count, value, order="<"):
        raw = bytearray(tiff.write_tiff(pages[:1], tiff.DEFLATE))
        at = raw.rindex(np.array([tag], "<u2").tobytes() + np.array([4 if tag < 258 or tag in (273, 278, 279) else 3], "<u2").tobytes())
        raw[at + 2 : at + 12] = np.array([kind], "<u2").tobytes() + np.array([count, value], "<u4").tobytes()
        return bytes(raw)

    broken = [tagged(256, 4, 0, 0), tagged(256, 4, 1, 2**31), tagged(257, 9, 1, 2**32 - 5), tagged(277, 3, 1, 0), tagged(256, 9, 1, 2**32 - 1), tagged(259, 3, 1, 99)]
    rows = [(k, b, "x") for k, b in enumerate(broken)] + [(None, tiff.write_tiff(pages, tiff.LZW), "y")] + [(100 + k, b, "z") for k, b in enumerate(kept[::40])]
    got = tiff.media_pages(spark.createDataFrame(rows, "id long, m binary, page string"), "id", "m").collect()
    assert sorted(r.id for r in got if r.id is not None and r.id < 100 and r.error) == list(range(len(broken)))
    assert sorted(r.page for r in got if r.id is None) == [0, 1]
    assert tiff.media_pages(spark.createDataFrame([], "id long, m binary"), "id", "m").count() == 0


def test_text_digest(spark):
    texts = [None, "", "é" * 100, "x" * 192, "hello\nworld " * 900, "x" * 192]
    got = {r.doc_id: r for r in tiff.text_media_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[3][1:] == got[5][1:] and got[0][1:] == got[1][1:]
    long = ["".join(rng.choices("abcdefgh \n", k=200_000 + k)) for k in range(24)]
    forms = [r.form for r in tiff.text_media_digest(spark.createDataFrame([(k, t, 1) for k, t in enumerate(long)], "doc_id long, text string, form int")).collect()]
    assert set(forms) == {"lzw", "deflate", "packbits"}  # the form has nothing to do with the size
    assert tiff.text_media_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute(rows, k=20):
    use = {i: np.array(v, np.float64) for i, v in rows if v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in use:
        if q % 20 == 0:
            scored = sorted((-float((use[q] * v).sum()), i) for i, v in use.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_neighbours(spark):
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)] + [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (920, [1.0]), (904, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<double>, score double").repartition(4)
    got: dict = {}
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows)
    assert got.keys() == want.keys()
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.97 * sum(map(len, want.values()))
    few = df.where("vec_id < 5")
    assert [r.vec_id for r in ann.nearest(few).orderBy("rank").collect()] == [i for i, _ in brute(rows[:5])[0]]
    assert ann.nearest(df.limit(0)).count() == 0


def test_recall_at_64_dimensions(spark):
    r = np.random.default_rng(11)
    plain = r.standard_normal((6000, 64))
    grouped = r.standard_normal((30, 64))[r.integers(0, 30, 3000)] + 0.3 * r.standard_normal((3000, 64))
    for v in (plain / np.linalg.norm(plain, axis=1, keepdims=True), grouped):
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
        got: dict = {}
        for row in ann.nearest(df).collect():
            got.setdefault(row.query_id, {})[row.vec_id] = row.score
        hits = 0
        for q in range(0, len(v), 20):
            score = (v[q] * v).sum(axis=1)
            want = [i for i in np.lexsort((np.arange(len(v)), -score)).tolist() if i != q][:20]
            hits += len(set(want) & set(got[q]))
            assert len(got[q]) == 20 and all(s == score[i] for i, s in got[q].items())
        assert hits >= 0.99 * len(got) * 20


def test_estimates_keep_their_bounds():
    r = np.random.default_rng(12)
    v, q, centre = r.standard_normal((2000, 50)), r.standard_normal((40, 50)), r.standard_normal(50)
    turn = ann.rotation(50, 0)
    codes = ann.Codes.of(v, centre, turn)
    assert codes.bits.shape == (2000, 4) and np.allclose(turn @ turn.T, np.eye(50), atol=0.5)
    guess, bound = codes.estimate(q @ turn, q @ centre)
    off = np.abs(guess - q @ v.T)
    assert (off <= bound).mean() > 0.97 and bound.mean() < 0.5 * (q @ v.T).std() * 3


def test_repeated_vectors_and_queries(spark):
    v = [1.0, 2.0, -1.0, 0.5, 0.0, 3.0]
    rows = [(i, v) for i in range(30)] + [(0, v), (0, [2.0] * 6)] + [(None, v)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    mine = [(r.query_id, r["rank"], r.vec_id) for r in got if r.query_id == 20]
    assert sorted(mine)[:3] == [(20, 1, 0), (20, 2, 1), (20, 3, 2)] and {r.query_id for r in got} == {0, 20}


def test_each_length_is_searched_apart(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=6 if i % 3 else 9).tolist() for i in range(90)} | {100: [1.0], 101: [0.0, 1.0]}
    got = ann.nearest(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>"), k=4)
    want = {}
    for q in range(0, 90, 20):
        a = np.float32(vectors[q]).astype(float)
        scored = sorted((-float(a @ np.float32(v).astype(float)), i) for i, v in vectors.items() if i != q and len(v) == len(a))
        want[q] = [i for _, i in scored[:4]]
    rows = sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect())
    assert rows == sorted((q, k + 1, v) for q, near in want.items() for k, v in enumerate(near))
