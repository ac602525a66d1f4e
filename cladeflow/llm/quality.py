"""Quality classifier by co-training of a text view and a metadata view.

The text view sees the words and the shape of the text: hashed word frequencies and rates
of letters, capitals, digits, punctuation, repeated words and lines. The metadata view
sees what describes the page: hashed source and language, and its length. Each view has a
logistic regression. In each round, both views are calibrated on labelled documents kept
apart (Platt scaling), and a pass scores all unlabelled documents. Every view labels, for
the other, those it is most sure of among all of them, in the proportion of the labelled
classes; a label counts as sure if its calibrated probability is ``SURE`` or more, so that a
view that knows little gives little. Then both are fitted again. Finally the calibrated
log-odds are combined with weights by how well each view does on the documents kept apart.

The fit uses a bounded sample of about ``LABELLED`` labelled rows, chosen by hashes of the
id, and ``PER_ROUND`` pseudo-labels a view and round. The latter are a parameter of the fit:
they come from all unlabelled documents, of which none is left out. Every document is scored.

Defined results: a null text counts as empty; null metadata is a value of its own; a row
with null doc_id is scored but never trains; with no labels, or of one class only, the
score is that class's share, 0.5 without labels. A document with several labels counts as
1 if any is 1. Equal texts with equal metadata get equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.staging import stage, unstage
from cladeflow.llm.tokens import utf8, words

LABELLED = 4000
WORD_DIMS = 512
META_DIMS = 128
ROUNDS = 5
PER_ROUND = 400  # pseudo-labels a view gives in a round
SURE = 0.95  # least calibrated probability of a pseudo-label
SURE_LOGIT = float(np.log(SURE / (1 - SURE)))

LETTER, CAPITAL, DIGIT, PUNCT, HIGH = (np.zeros(256, bool) for _ in range(5))
LETTER[list(range(65, 91)) + list(range(97, 123))] = True
CAPITAL[65:91] = True
DIGIT[48:58] = True
PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
HIGH[128:] = True
CLASSES = (LETTER, CAPITAL, DIGIT, PUNCT, HIGH)
TEXT_DIMS = WORD_DIMS + len(CLASSES) + 6


def text_view(column: pa.Array) -> np.ndarray:
    """One row of TEXT_DIMS features per text."""
    data, offsets = utf8(column)
    n = len(column)
    out = np.zeros((n, TEXT_DIMS), np.float32)
    size = np.maximum(1, np.diff(offsets))
    for w in words(column):
        rows = slice(w.lo, w.hi)
        count = np.diff(w.bounds)
        doc = np.repeat(np.arange(len(count)), count)
        cell = (w.hashes >> np.uint64(40)).astype(np.int64) % WORD_DIMS
        freq = np.bincount(doc * WORD_DIMS + cell, minlength=len(count) * WORD_DIMS).reshape(-1, WORD_DIMS)
        x = np.sqrt(freq)
        out[rows, :WORD_DIMS] = 8 * x / np.maximum(1e-9, np.sqrt((x * x).sum(1, keepdims=True)))
        lo, hi = offsets[w.lo], offsets[w.hi]
        bytes_ = data[lo:hi]
        at = offsets[rows.start : rows.stop + 1] - lo
        for k, kind in enumerate(CLASSES):
            sums = np.concatenate(([0], np.cumsum(kind[bytes_])))
            out[rows, WORD_DIMS + k] = 4 * (sums[at[1:]] - sums[at[:-1]]) / size[rows]
        breaks = np.concatenate(([0], np.cumsum(bytes_ == 10)))
        lines = breaks[at[1:]] - breaks[at[:-1]] + 1
        # distinct words, and the largest share of one word
        order = np.lexsort((w.hashes, doc))
        h, d = w.hashes[order], doc[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
        runs = np.diff(np.append(new, len(h)))
        distinct = np.bincount(d[new], minlength=len(count)) if len(h) else np.zeros(len(count))
        most = np.zeros(len(count))
        np.maximum.at(most, d[new], runs)
        some = np.maximum(1, count)
        k = WORD_DIMS + len(CLASSES)
        out[rows, k : k + 6] = np.stack((np.log1p(count) / 4, size[rows] / some / 8, 2 * distinct / some, 4 * most / some, np.log1p(lines) / 3, np.log1p(count / lines) / 3), axis=1)
    return out


def meta_view(columns: list[pa.Array], length: pa.Array) -> np.ndarray:
    """One row of META_DIMS features: hashed values of each column and classes of length."""
    n = len(length)
    out = np.zeros((n, META_DIMS), np.float32)
    for c, column in enumerate(columns):
        code = column.cast(pa.string()).dictionary_encode()
        values = [zlib.crc32(f"{c}:{v}".encode()) % (META_DIMS - 16) for v in [*code.dictionary.to_pylist(), None]]
        at = np.array(values)[code.indices.fill_null(len(values) - 1).to_numpy()]
        out[np.arange(n), at] += 1
    size = np.nan_to_num(length.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0)
    band = np.clip(np.log2(np.maximum(size, 1)).astype(int), 0, 14)
    out[np.arange(n), META_DIMS - 16 + band] = 1
    out[:, -1] = np.log1p(np.maximum(size, 0)) / 10
    return out


def packed(x: np.ndarray) -> pa.Array:
    """Rows of features as binary values."""
    ends = np.arange(len(x) + 1, dtype=np.int64) * x.shape[1] * x.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The rows that were packed; no value is null."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros((0, dims), np.float32)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(-1, dims)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, l2: float = 1e-3, steps: int = 80) -> np.ndarray:
    """Weights and bias by accelerated gradient descent with balanced classes."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    w = weight.astype(np.float64)
    for c in (0, 1):
        w[y == c] /= max(1e-9, w[y == c].sum())
    w = (w / w.sum()).astype(x.dtype)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(12):  # the largest curvature, by power iteration
        v = x.T @ (w * (x @ v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1 / (0.3 * top + l2)
    at = ahead = np.zeros(x.shape[1], x.dtype) if start is None else start.astype(x.dtype)
    for k in range(steps):
        g = x.T @ (w * (sigmoid(x @ ahead) - y).astype(x.dtype)) + l2 * ahead
        following = ahead - step * g
        ahead = following + k / (k + 3) * (following - at)
        at = following
    return at.astype(np.float64)


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits that fit the labels, with Platt's smoothed targets."""
    wide = max(1e-9, float(np.abs(z).mean()))
    z = z / wide
    n = y.sum()
    t = np.where(y == 1, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
    loss = lambda p: (np.logaddexp(0, p[0] * z + p[1]) - t * (p[0] * z + p[1])).sum() + 1e-3 * p @ p
    at = np.zeros(2)
    for _ in range(40):
        p = sigmoid(at[0] * z + at[1])
        g = np.array([((p - t) * z).sum(), (p - t).sum()]) + 2e-3 * at
        q = p * (1 - p)
        h = np.array([[(q * z * z).sum(), (q * z).sum()], [(q * z).sum(), q.sum()]]) + 2e-3 * np.eye(2)
        move, size = np.linalg.solve(h, g), 1.0
        while size > 1e-4 and loss(at - size * move) > loss(at):
            size /= 2
        at = at - size * move
    return float(at[0]) / wide, float(at[1])


class Model(NamedTuple):
    """Two views with their calibration and weights; or a constant."""

    text: np.ndarray | None
    meta: np.ndarray | None
    text_scale: tuple[float, float, float]
    meta_scale: tuple[float, float, float]
    constant: float

    def views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view, and both."""
        if self.text is None:
            c = np.full(len(text), self.constant)
            return c, c, c
        out, z = [], 0
        for x, w, (a, b, share) in ((text, self.text, self.text_scale), (meta, self.meta, self.meta_scale)):
            own = a * logits(x, w) + b
            out.append(sigmoid(own))
            z = z + share * own
        return out[0], out[1], sigmoid(z)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, most_sure: Callable[..., list[dict[int, tuple[float, np.ndarray]]]]) -> Model:
    """y: 0 or 1 for each labelled row, in an order that has nothing to do with it.

    ``most_sure(models, given, n_good, n_bad)``, with calibrated models, has for each view
    what it labels for the other: by doc_id, the label and the features in the other view.
    """
    if len(np.unique(y)) < 2:
        return Model(None, None, (1, 0, 0.5), (1, 0, 0.5), float(y[0]) if len(y) else 0.5)
    apart = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[~apart])) < 2 or len(np.unique(y[apart])) < 2:
        apart[:] = False
    views = (text, meta)
    share = y[~apart].mean()
    given: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]  # for each view, what the other has labelled

    def fitted(v: int, start: np.ndarray | None = None) -> np.ndarray:
        extra = np.array([c for c, _ in given[v].values()])
        weight = np.concatenate((np.ones((~apart).sum()), np.full(len(extra), 0.5)))
        return logistic(np.vstack((views[v][~apart], *[x for _, x in given[v].values()])), np.concatenate((y[~apart], extra)), weight, start, steps=80 if start is not None else 300)

    held = apart if apart.any() else ~apart
    models = [fitted(0), fitted(1)]
    for _ in range(ROUNDS):
        calibrated = []
        for v in (0, 1):
            scale, shift = platt(logits(views[v][held], models[v]), y[held])
            calibrated.append(scale * models[v])
            calibrated[-1][-1] += shift
        for v, found in enumerate(most_sure(calibrated, given, round(PER_ROUND * share), round(PER_ROUND * (1 - share)))):
            given[1 - v] |= found
        models = [fitted(v, models[v]) for v in (0, 1)]
    scales, gains = [], []
    base = -np.log(np.where(y[held] == 1, y[held].mean(), 1 - y[held].mean())).mean()
    for v in (0, 1):
        z = logits(views[v][held], models[v])
        a, b = platt(z, y[held])
        p = sigmoid(a * z + b)
        gains.append(max(1e-6, base + np.log(np.clip(np.where(y[held] == 1, p, 1 - p), 1e-9, 1)).mean()))
        scales.append((a, b))
    parts = np.array(gains) / sum(gains)
    return Model(models[0], models[1], (*scales[0], float(parts[0])), (*scales[1], float(parts[1])), 0.5)


# ---------------------------------------------------------------- Spark


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang"), length_col: str = "n_chars", label_col: str = "quality", *, labelled: int = LABELLED, seed: int = 0) -> DataFrame:
    """(doc_id, text_score, meta_score, score) of every document: probabilities of label 1."""
    meta = tuple(f"m{k}" for k in range(len(meta_cols)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).cast("string").alias(m) for c, m in zip(meta_cols, meta, strict=True)], F.col(length_col).cast("long").alias("n_chars"))
    known = labels.select(F.col(labels.columns[0]).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))

    def drawn(t: DataFrame, most: int) -> DataFrame:
        n = t.count()
        return t.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(1, n))))

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    chosen = drawn(known.join(ids, "doc_id", "left_semi"), labelled)
    picked = {r["doc_id"]: r["y"] for r in chosen.toArrow().to_pylist()}  # bounded by the sample
    kinds = [("doc_id", pa.int64()), ("text_x", pa.binary()), ("meta_x", pa.binary())]

    def features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return text_view(b["text"]), meta_view([b[m] for m in meta], b["n_chars"])

    def viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[packed(x) for x in features(b)]], names=[n for n, _ in kinds])

    def taken(ids: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Both views' features of the rows of a few doc_ids; of rows that share one, the least."""
        got = views.where(F.col("doc_id").isin(ids)).toArrow()
        one = {}
        for i, *x in sorted(zip(*(got[n].to_pylist() for n, _ in kinds), strict=True), reverse=True):
            one[i] = tuple(np.frombuffer(raw, np.float32) for raw in x)
        return one

    def most_sure(models: list[np.ndarray], given: list[dict], n_good: int, n_bad: int) -> list[dict]:
        """One pass over all documents; those without a label that each view is most sure of."""

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z = [np.where(np.isin(b["doc_id"].to_numpy(), list(given[1 - v])), 0.0, logits(unpacked(b[c], dims), models[v])) for v, (c, dims) in enumerate((("text_x", TEXT_DIMS), ("meta_x", META_DIMS)))]  # each document once
                yield pa.RecordBatch.from_arrays([b["doc_id"], *map(pa.array, z)], names=["doc_id", "z0", "z1"])

        z = views.mapInArrow(both, "doc_id long, z0 double, z1 double").groupBy("doc_id").agg(F.min(F.struct("z0", "z1")).alias("z"))
        z = stage(z.join(known.select("doc_id").hint("merge"), "doc_id", "left_anti").select("doc_id", "z.z0", "z.z1"), "sure")
        sure = []
        for v in (0, 1):
            good = z.where(F.col(f"z{v}") >= SURE_LOGIT).orderBy(F.desc(f"z{v}"), "doc_id").limit(n_good).collect()
            bad = z.where(F.col(f"z{v}") <= -SURE_LOGIT).orderBy(f"z{v}", "doc_id").limit(n_bad).collect()
            sure.append({r.doc_id: 1.0 for r in good} | {r.doc_id: 0.0 for r in bad})
        unstage(z)
        at = taken([*sure[0], *sure[1]]) if any(sure) else {}
        return [{i: (c, at[i][1 - v]) for i, c in sure[v].items()} for v in (0, 1)]

    if picked:  # the rounds need the features again and again, and the texts no more
        views = stage(rows.where("doc_id is not null").mapInArrow(viewed, "doc_id long, text_x binary, meta_x binary"), "views")
    one = taken(list(picked)) if picked else {}
    order = sorted(one, key=lambda i: (zlib.crc32(str(i).encode()), i))
    label = np.array([picked[i] for i in order], np.int64)
    text = np.array([one[i][0] for i in order]).reshape(len(order), TEXT_DIMS)
    info = np.array([one[i][1] for i in order]).reshape(len(order), META_DIMS)
    model = co_train(text, info, (label > 0).astype(np.float64), most_sure)
    if picked:
        unstage(views)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.views(*features(b))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(x.astype(np.float64)) for x in p]], names=["doc_id", "text_score", "meta_score", "score"])

    return rows.mapInArrow(score, "doc_id long, text_score double, meta_score double, score double")
