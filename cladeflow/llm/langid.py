"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are lower-cased character 1- to 3-grams hashed to ``dims`` buckets, weighted
(1 + log tf) * idf and scaled to length 1. Weights are trained by follow-the-regularised-
leader (per-coordinate steps, L1 and L2 penalties, so most weights are exactly 0), and a
temperature fitted on a part of the training sample kept apart calibrates the scores.

Document frequencies cover every training document. The fit itself uses a bounded sample:
about ``per_lang`` documents of each language, and at most about ``FIT_ROWS`` in all, chosen
by a hash of the id; of a document it holds at most a count for each bucket.

Defined results: a null text, or one without letters, is ``und`` with score 0. A null
language never trains. Without any training document everything is ``und``. Equal
texts get equal results, so that repeated rows do, and ties go to the first language by
name. A row with a null id counts as not held out. Columns other than those named play no
part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.tokens import decoded, mix

PER_LANG = 1500  # documents of a language in the fit's sample, about
FIT_ROWS = 12_000  # of all languages together
UND = "und"
CHUNK_CHARS = 400_000


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # dims x langs
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    dims: int


def counts(texts: list[str], dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, buckets, counts) of each text's character 1- to 3-grams, in pieces of texts."""
    lo = 0
    lowered = [t.lower() for t in texts]
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(lowered[hi]) < CHUNK_CHARS) and hi - lo < 128:
            total += len(lowered[hi])
            hi += 1
        part = lowered[lo:hi]
        codes = np.frombuffer("\0".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(t) for t in part])
        doc = np.repeat(np.arange(len(part)), sizes + 1)[: len(codes)]
        keys = []
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, 4):
            m = len(codes) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(1)
            same = doc[:m] == doc[n - 1 :]
            whole = codes != 0 if n == 1 else whole[:m] & (codes[n - 1 :] != 0)
            same &= whole
            keys.append(doc[:m][same] * dims + (mix(h[same] + np.uint64(n)) % np.uint64(dims)).astype(np.int64))
        table = np.bincount(np.concatenate(keys) if keys else np.zeros(0, np.int64), minlength=len(part) * dims).reshape(len(part), dims)
        for i in range(len(part)):
            at = np.flatnonzero(table[i])
            yield lo + i, at, table[i, at]
        lo = hi


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / max(1e-12, np.sqrt((x * x).sum()))


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Buckets in order and their counts, in a fraction of their size."""
    return zlib.compress(np.concatenate((np.diff(at, prepend=0), n)).astype(np.int32).tobytes(), 1)


class Rows(Sequence):
    """The packed rows of the fit's sample; one is unpacked and weighted when it is asked for, so that the driver never holds them all."""

    def __init__(self, cells: list[bytes], idf: np.ndarray):
        self.cells, self.idf = cells, idf

    def __len__(self) -> int:
        return len(self.cells)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        step, n = np.frombuffer(zlib.decompress(self.cells[i]), np.int32).reshape(2, -1)
        at = np.cumsum(step)
        return at, weighted(at, n, self.idf)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ftrl(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int, n_langs: int, *, epochs: int = 4, least: int = 1200, batch: int = 16, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dims x languages) and bias by proximal FTRL over small batches.

    Passes are repeated until there were ``least`` updates, so that small samples converge.
    """
    z, s = np.zeros((dims + 1, n_langs)), np.zeros((dims + 1, n_langs))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(s[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(max(epochs, -(-least * batch // max(1, len(rows))))):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            some = [rows[i] for i in own]
            at = np.unique(np.concatenate([r for r, _ in some] + [[dims]]))
            x = np.zeros((len(own), len(at)))
            for k, (r, v) in enumerate(some):
                x[k, np.searchsorted(at, r)] = v
            x[:, -1] = 1
            w = weights(at)
            p = softmax(x @ w)
            p[np.arange(len(own)), labels[own]] -= 1
            g = x.T @ p / len(own)
            squares = g * g
            sigma = (np.sqrt(s[at] + squares) - np.sqrt(s[at])) / alpha
            z[at] += g - sigma * w
            s[at] += squares
    w = weights(slice(None))
    return w[:-1], w[-1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least loss on documents kept apart.

    Targets are smoothed by one document, so that a few perfect answers do not make the
    model certain.
    """
    if not len(labels):
        return 1.0
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + 2) / max(1, k - 1))
    target[np.arange(n), labels] = 1 - 1 / (n + 2)
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    loss = [-(target * np.log(softmax(logits / t) + 1e-300)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


# ---------------------------------------------------------------- Spark


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))


def in_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_frequencies(texts: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Documents, and documents with each bucket, over all rows: one row a task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, np.int64), 0
        for b in batches:
            for _, at, _ in counts(decoded(b["text"]), dims):
                df[at] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    got = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(dims + 1, np.int64)
    df[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return int(df[-1]), df[:-1]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, dims: int = 8192, per_lang: int = PER_LANG, seed: int = 0) -> Model | None:
    """A model from the rows that are not held out; None if there are none with letters."""
    train = _rows(docs, id_col, text_col, lang_col).where(~in_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    per_lang = min(per_lang, max(1, FIT_ROWS // len(sizes)))
    total, df = document_frequencies(train, dims)
    idf = np.log((1 + total) / (1 + df)) + 1
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))])
    sample = train.where(draw < rate[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs, ids = decoded(b["text"]), b["lang"].to_pylist(), b["doc_id"].to_pylist()
            out = [(str(ids[i]), langs[i], packed(at, n)) for i, at, n in counts(texts, dims) if has_letter(texts[i])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], names=["id", "lang", "cells"])

    got = sorted((r["id"], r["lang"], r["cells"]) for r in sample.mapInArrow(run, "id string, lang string, cells binary").toArrow().to_pylist())
    if not got:
        return None
    langs = sorted({r[1] for r in got})
    labels = np.array([langs.index(r[1]) for r in got])
    apart = np.arange(len(got)) % 5 == 4
    w, bias = ftrl(Rows([r[2] for r, a in zip(got, apart, strict=True) if not a], idf), labels[~apart], dims, len(langs), seed=seed)
    logits = np.array([x @ w[at] + bias for at, x in Rows([r[2] for r, a in zip(got, apart, strict=True) if a], idf)])
    return Model(langs, w, bias, idf, calibrate(logits, labels[apart]), dims)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) and the columns ``keep`` of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("_text"), *keep)
    spec = [rows.schema[c] for c in ("doc_id", *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in decoded(b["_text"])]
            lang, score = [UND] * len(texts), np.zeros(len(texts))
            if model:
                for i, at, n in counts(texts, model.dims):
                    if has_letter(texts[i]):
                        x = weighted(at, n, model.idf) @ model.weights[at] + model.bias
                        p = softmax(x[None] / model.temperature)[0]
                        best = int(p.argmax())
                        lang[i], score[i] = model.langs[best], min(1.0, float(p[best]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[b[c] for c in keep], pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", *keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spec)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    model = fit(docs, id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select("doc_id", in_held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.35) -> DataFrame:
    """``docs`` without the rows whose text has no language or a score under ``least``."""
    names = list(docs.columns)
    model = fit(docs, id_col, text_col, lang_col)
    kept = [f"_k{k}" for k in range(len(names))]  # names of the caller's that clash with ours
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), *[F.col(c).alias(k) for c, k in zip(names, kept, strict=True)])
    out = predict(rows, model, "_id", "_t", tuple(kept)).where((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return out.select(*[F.col(k).alias(c) for c, k in zip(names, kept, strict=True)])
