"""Language ID, quality, LM scoring: accuracy, brute force and edge cases."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cladeflow.llm import langid, quality, xent

DATA = "/root/testdata/sf0.001"


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_cases(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["der", "und"] if i % 2 else ["the", "and"], k=30)), "de" if i % 2 else "en", "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "12 34 !", "de", "s"), (102, "", None, "s"), (103, "und der und", None, "s"), (3, rows[3][1], "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "de"
    assert {r.doc_id for r in langid.keep_identified(docs).collect()} == set(range(60)) | {103}
    none = docs.where("lang is null")
    assert {r.lang_pred for r in langid.identify(none).collect()} == {"und"} and langid.identify(docs.limit(0)).count() == 0


def test_quality_learns(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    assert both[both.quality == 1].score.mean() > both[both.quality == 0].score.mean()


def test_quality_on_labels_kept_apart(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    got = {r.doc_id: r.score for r in quality.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in got]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert len(good) > 20 and len(bad) > 20
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.95  # the area under the curve


def test_quality_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "PER_ROUND", 10)
    rng = random.Random(2)
    rows = []
    for i in range(150):
        kind = i % 2
        text = " ".join(rng.choices(["lorem", "ipsum", "dolor", "BUY", "now", "1"], weights=[5, 5, 5, 1, 1, 1] if kind else [1, 1, 1, 5, 5, 5], k=rng.randrange(3, 40)))
        rows.append((i, text, rng.choice("ab") if rng.random() < 0.7 else "cd"[kind], "en", len(text)))
    labels = [(i, i % 2) for i in range(0, 60)]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    got = {r.doc_id: (r.text_score, r.meta_score, r.score) for r in quality.classify(spark.createDataFrame([(*r, "x") for r in rows], schema + ", y string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    t = pa.table({k: [r[j] for r in rows] for j, k in enumerate(("doc_id", "text", "source", "lang", "n_chars"))})
    x = (quality.text_view(t["text"].combine_chunks()), quality.meta_view([t["source"].combine_chunks(), t["lang"].combine_chunks()], t["n_chars"].combine_chunks()))
    rounds = []

    def most_sure(models, given, n_good, n_bad):
        rounds.append(models)
        out = []
        for v in (0, 1):
            z = {i: float(quality.logits(x[v][[i]], models[v])[0]) for i in range(60, 150) if i not in given[1 - v]}
            good = [i for _, i in sorted((-s, i) for i, s in z.items() if s >= quality.SURE_LOGIT)[:n_good]]
            bad = [i for _, i in sorted((s, i) for i, s in z.items() if s <= -quality.SURE_LOGIT)[:n_bad]]
            out.append({i: (1.0, x[1 - v][i]) for i in good} | {i: (0.0, x[1 - v][i]) for i in bad})
        return out

    order = sorted(range(60), key=lambda i: (zlib.crc32(str(i).encode()), i))
    model = quality.co_train(x[0][order], x[1][order], np.array([i % 2 for i in order], float), most_sure)
    want = np.stack(model.views(*x), axis=1)
    assert len(rounds) == quality.ROUNDS
    assert np.allclose([got[i] for i in range(150)], want, atol=1e-3)


def test_language_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    model = langid.fit(docs, per_lang=20)
    texts = ["Das ist ein Haus", "the house", "日本 Été ÉTÉ", "a", "1 2", None, "", "x\0y z " * 2000]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, score string"), model).collect()}
    for i, t in enumerate(texts):
        if not t or not any(map(str.isalpha, t)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        tf, low = Counter(), t.lower()
        for n in (1, 2, 3):
            for k in range(len(low) - n + 1):
                h = 0
                for c in low[k : k + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
                if "\0" not in low[k : k + n]:
                    tf[int(langid.mix(np.array([(h + n) % 2**64], np.uint64))[0]) % model.dims] += 1
        x = {b: (1 + math.log(n)) * model.idf[b] for b, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [sum(v / norm * model.weights[b, k] for b, v in x.items()) + model.bias[k] for k in range(len(model.langs))]
        p = [math.exp((a - max(z)) / model.temperature) for a in z]
        assert got[i].lang_pred == model.langs[int(np.argmax(z))] and got[i].score == pytest.approx(max(p) / sum(p), abs=1e-9)
    null = spark.createDataFrame([(None, "the and", "en"), (4, "the and", "en")], "doc_id long, text string, lang string")
    assert all(r.held_out is not None for r in langid.identify(null).collect())


def test_language_fit_holds_its_sample_packed(spark):
    rng = random.Random(4)
    letters = ["".join(map(chr, range(97, 123))), "".join(map(chr, range(0x3B1, 0x3CA)))]
    rows = [(i, "".join(rng.choices(letters[i % 2] + " ", k=4000)), "en" if i % 2 else "el") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    some = [len(at) for _, at, _ in langid.counts([t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2], 8192)]
    tracemalloc.start()
    model = langid.fit(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.langs == ["el", "en"] and most < 8 * sum(some)  # a bucket, its count and its weight take 16 bytes


def test_language_rows_come_back():
    at, n, idf = np.array([0, 3, 4, 8191]), np.array([1, 70_000, 2, 1]), np.linspace(1, 2, 8192)
    got = langid.Rows([langid.packed(at, n), langid.packed(at[1:2], n[1:2])], idf)
    assert len(got) == 2 and (got[0][0] == at).all() and (got[0][1] == langid.weighted(at, n, idf)).all()
    assert got[1][0].tolist() == [3] and got[1][1].tolist() == [1.0]


def test_sparse_regression_learns_and_stays_sparse():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, 300)
    rows = []
    for y in labels:
        at = np.unique(np.concatenate((rng.choice(np.arange(10 * y, 10 * y + 10), 4), rng.choice(np.arange(30, 200), 6))))
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at)))))
    w, bias = langid.ftrl(rows, labels, 200, 3)
    z = np.array([x @ w[at] + bias for at, x in rows])
    assert (z.argmax(1) == labels).mean() > 0.98
    few = langid.ftrl(rows, labels, 200, 3, l1=1.0)[0]
    assert (few == 0).mean() > 0.5 > (w == 0).mean() and (few[:30] != 0).mean() > (few[30:] != 0).mean()


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "a", "en", 0), (None, "x y", "b", "de", 3), (2, "", "a", "en", 0)], "doc_id long, text string, source string, lang string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (1, 0), (7, 0)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, one).collect()} == {1.0}
    assert quality.classify(docs.limit(0), one).count() == 0


def test_quality_labels_the_surest_of_all_documents(spark):
    # the only documents with "zebra" are rare, and outside every sample by hashes of the id
    far = [r.id for r in spark.range(1000, 9000).where("pmod(xxhash64(id, 0), 1 << 30) > 0.95 * (1 << 30)").limit(40).collect()]
    rows = [(i, "fine words here" if i % 2 else "poor stuff there", "good" if i % 2 else "bad", "en", 100) for i in range(400)]
    rows += [(i, "zebra zebra fine" if i in far else "plain text", "good" if i in far else "other", "en", 100) for i in range(1000, 9000)]
    rows += [(9001, "zebra", "other", "en", 100), (9002, "plain", "other", "en", 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = {r.doc_id: r.text_score for r in quality.classify(docs, labels).where("doc_id > 9000").collect()}
    assert got[9001] > got[9002] + 0.1


def test_quality_reads_texts_once_for_all_rounds(spark):
    rows = [(i, "fine words here" if i % 2 else "poor stuff there", "s", "en", 100) for i in range(300)]
    docs, read = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    assert quality.classify(docs.mapInArrow(counted, docs.schema), labels).count() == 300
    assert read.value <= 4 * 300  # twice for the ids of the sample, once for the features, once for the scores


def test_quality_features_come_back():
    x = np.random.default_rng(1).random((7, 5), np.float32)
    column = quality.packed(x)
    assert (quality.unpacked(column, 5) == x).all() and (quality.unpacked(column.slice(2, 3), 5) == x[2:5]).all()
    assert quality.unpacked(column.slice(0, 0), 5).shape == (0, 5)


@pytest.mark.parametrize("vocabulary", [6, 1000])
def test_lm_scores_against_brute_force(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(xent, "PARTITION_TOKENS", 50)
    rng = random.Random(9)
    texts = {i: " ".join(rng.choices("abcdefghi", weights=range(1, 10), k=rng.randrange(1, 40))) for i in range(40)} | {40: None, 41: " \n", 42: "z " * 400}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n long").repartition(3)
    chosen = {i for i in range(0, 40, 3)}
    got = {r.doc_id: r for r in xent.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in chosen], "doc_id long"), vocabulary=vocabulary).collect()}
    words = {i: (t or "").split() for i, t in texts.items()}
    count = Counter(w for x in words.values() for w in x)
    known = {w for w, _ in count.most_common(vocabulary)}

    def model(ids):
        uni, bi, hist = Counter(), Counter(), Counter()
        for i in ids:
            if words[i]:
                seq = ["<s>", *[w if w in known else "?" for w in words[i]], "</s>"]
                uni.update(seq[1:])
                hist.update(seq[:-1])
                bi.update(zip(seq, seq[1:]))
        total, size = sum(uni.values()), len(known) + 2
        return lambda a, w: -math.log((bi[a, w] + xent.MU * (uni[w] + 1) / (total + size)) / (hist[a] + xent.MU))

    target, background = model(chosen), model(words)
    for i, x in words.items():
        if not x:
            assert got[i].score is None and got[i].n_tokens == 0
            continue
        seq = ["<s>", *[w if w in known else "?" for w in x], "</s>"]
        loss = [np.mean([m(*p) for p in zip(seq, seq[1:])]) for m in (target, background)]
        assert got[i].target_loss == pytest.approx(loss[0]) and got[i].score == pytest.approx(loss[0] - loss[1])
    assert xent.cross_entropy_difference(docs.limit(0), docs.select("doc_id").limit(0)).count() == 0


def test_lm_null_and_repeated_ids(spark):
    rows = [(1, "a b"), (1, "b c"), (2, "a b"), (None, "a c"), (None, "c"), (None, None), (3, "")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    chosen = spark.createDataFrame([(2,), (None,)], "doc_id long")
    got = sorted(xent.cross_entropy_difference(docs, chosen).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_tokens, r.score is None) for r in got] == [(1, 6, False), (2, 3, False), (3, 0, True), (None, 5, False)]
    uni, bi, hist = Counter(), Counter(), Counter()
    for _, t in rows:
        if t:
            seq = ["<s>", *t.split(), "</s>"]
            uni.update(seq[1:])
            hist.update(seq[:-1])
            bi.update(zip(seq, seq[1:]))
    smooth = xent.MU / (sum(uni.values()) + 5)
    pairs = [p for t in ("a c", "c") for p in zip(["<s>", *t.split()], [*t.split(), "</s>"])]
    assert got[3].background_loss == pytest.approx(np.mean([-math.log((bi[p] + smooth * (uni[p[1]] + 1)) / (hist[p[0]] + xent.MU)) for p in pairs]))


def test_lm_takes_every_word(spark):
    texts = {i: " ".join(f"w{i * 700 + k}" for k in range(700)) for i in range(100)} | {200: "w1 w2 rare", 201: "w1 w2 seldom"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    uni, bi, hist = Counter(), Counter(), Counter()
    for t in texts.values():
        seq = ["<s>", *t.split(), "</s>"]
        uni.update(seq[1:])
        hist.update(seq[:-1])
        bi.update(zip(seq, seq[1:]))
    for vocabulary in (None, 70_002):
        got = {r.doc_id: r for r in xent.cross_entropy_difference(docs, spark.createDataFrame([(200,)], "doc_id long"), vocabulary=vocabulary).collect()}
        smooth = xent.MU / (sum(uni.values()) + len(uni) + 1)
        for i in (0, 99, 200, 201):
            seq = ["<s>", *texts[i].split(), "</s>"]
            loss = np.mean([-math.log((bi[q] + smooth * (uni[q[1]] + 1)) / (hist[q[0]] + xent.MU)) for q in zip(seq, seq[1:])])
            assert got[i].background_loss == pytest.approx(loss)
        assert got[200].target_loss < got[201].target_loss
