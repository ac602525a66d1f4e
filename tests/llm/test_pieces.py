import os
import random

import pytest
import sentencepiece

from cladeflow.llm import spm
from cladeflow.llm.queries import PIECES

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no vocabulary here")
EDGE = ["", "a", " ", "  ", "   x", "a    b   ", "\n\n\t x  \n   y", "héllo wörld 日本語 😀", "x" * 500, "ab" * 3000, "." * 333, " " * 77 + "b" + " " * 100]


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as f:
        return spm.Model(f.read())


def texts(model):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz   etaoinETA.,;é日\n"
    out = ["".join(rng.choices(letters, k=rng.randrange(150))) for _ in range(400)]
    return EDGE + out + ["".join(rng.choices(model.pieces[259:], k=rng.randrange(40))).replace(chr(spm.MARK), " ") for _ in range(400)]


def split(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_same_ids_as_the_library(model):
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t = texts(model)
    ids, bounds = model.encode(t)
    assert split(ids, bounds) == own.encode(t, num_threads=1)
    assert [b.decode() for b in model.decode(ids, bounds)] == t


def test_words_of_any_length(model, monkeypatch):
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(5)
    letters = [p.strip(chr(spm.MARK)) for p in model.pieces[259:] if p.strip(chr(spm.MARK)).isalpha()]
    t = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000)), "的一是不" * 900, "".join(rng.choices(letters, k=800)), "x" * 5000, "日本語テキスト" * 300 + "abc" * 40]
    t += ["".join(rng.choices(letters, k=rng.randrange(12, 60))) for _ in range(60)]
    plain = []
    monkeypatch.setattr(model, "merge", lambda w, trace=None: plain.append(len(w)) or spm.Model.merge(model, w, trace))
    ids, bounds = model.encode(t)
    assert split(ids, bounds) == own.encode(t, num_threads=1)
    assert [b.decode() for b in model.decode(ids, bounds)] == t
    assert all(n > spm.LONGEST for n in plain if n > 1)


def test_unigram_against_sequential_viterbi():
    with open(PIECES, "rb") as f:
        model = spm.Model(f.read(), kind=spm.UNIGRAM)
    score = lambda ids: sum(model.scores[i] if model.pieces[i] in model.id else 0 for i in ids)
    words = ["hello", "the", "unbelievable", "zzzz", "internationalisation"]
    ids, bounds = model.encode(words)
    for w, got in zip(words, split(ids, bounds), strict=True):
        assert score(got) == pytest.approx(score(model.spelled(model.best(chr(spm.MARK) + w))))


def test_columns(spark, model):
    rows = [(i, t, 0) for i, t in enumerate(EDGE)] + [(99, None, 0), (1, EDGE[1], 0)]
    got = spm.encode_column(spark.createDataFrame(rows, "doc_id long, text string, ids int"), model)
    back = {r.doc_id: r.text for r in spm.decode_column(got, model).collect()}
    assert back == {i: t for i, t, _ in rows}
    assert got.where("round_trip").count() == len(rows) - 1 and got.where("ids is null").count() == 1
    assert spm.encode_column(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
