"""Whitening of embeddings by hierarchical merging of singular value decompositions.

A task reduces its vectors to a summary: their number, their exact sums, and singular values
and right vectors of the centred rows, at full rank. Two summaries merge losslessly: their
scaled right vectors are stacked with one row that corrects for the different means, and the
stack is decomposed again, so that the product of the result with itself is the centred
cross product of all rows. Summaries of tasks are merged ``FAN_IN`` at a time, in as many
levels as there are tasks to merge; a summary is at most d x d numbers, whatever the rows.
The components are the right vectors, and a component's eigenvalue is its squared singular
value over the number of rows.

The fit list has each distinct vector once, after rounding to whole numbers; every row is
whitened, repeated ones too. Vectors of each length are fitted apart. What the driver holds
and tasks get is 17 rows of d numbers a length.

Defined results: rows whose vector is null or has null or non-finite entries are left out;
an entry counts as at most 2**40 in size after rounding; vectors without entries, and
directions in which the fit list doesn't vary (singular values up to 1e-13 times d of the first, as with one
distinct vector), have no components and so no rows; a deviation that a long can't hold is
null. An empty table has no rows. Columns other than those named play no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.staging import stage, unstage

SCALE, OFFSET = 64, 1_000_000
LIMIT = float(1 << 40)  # of an entry after scaling
FAN_IN = 8
BLOCK = 1024  # rows that a task decomposes at once
SUMMARY = "part long, dims long, n long, sums string, s array<double>, v array<double>"


def entries(vector: str) -> Column:
    """The whole numbers that stand for a vector's entries, as longs."""
    return F.transform(vector, lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))), F.lit(int(LIMIT))), F.lit(-int(LIMIT))) + OFFSET)


def finite(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))


class Summary(NamedTuple):
    n: int
    sums: np.ndarray  # of entries less the offset, as Python numbers
    s: np.ndarray
    v: np.ndarray

    def mean(self) -> np.ndarray:
        return np.array([x / self.n for x in self.sums.tolist()])


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values and right vectors, through a triangle where there are more rows than columns."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s, v


def summary(x: np.ndarray) -> Summary:
    """Of rows of whole numbers, less the offset."""
    sums = x.sum(axis=0, dtype=np.int64) if len(x) < 1 << 20 else x.astype(object).sum(axis=0)
    mean = np.array([int(t) / len(x) for t in sums.tolist()])
    return Summary(len(x), sums.astype(object), *_decomposed(x - mean))


def merged(a: Summary, b: Summary) -> Summary:
    """The summary of both lots of rows; the last row of the stack makes up for their means."""
    n = a.n + b.n
    shift = np.sqrt(a.n / n * b.n) * (a.mean() - b.mean())
    return Summary(n, a.sums + b.sums, *_decomposed(np.vstack((a.s[:, None] * a.v, b.s[:, None] * b.v, shift))))


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of each length, less the offset."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, flat[(ends[rows] - d)[:, None] + np.arange(d)] - OFFSET


def _row(part: int, d: int, x: Summary) -> dict:
    return {"part": part, "dims": d, "n": x.n, "sums": json.dumps(x.sums.tolist()), "s": x.s, "v": x.v.ravel()}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Summary] = {}
    for b in batches:
        for d, _, x in _matrices(b["x"]):
            for lo in range(0, len(x), BLOCK):
                own = summary(x[lo : lo + BLOCK])
                held[d] = merged(held[d], own) if d in held else own
    for d, x in held.items():
        yield pa.RecordBatch.from_pylist([_row(TaskContext.get().partitionId(), d, x)], schema=_schema())


def _schema() -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("dims", pa.int64()), ("n", pa.int64()), ("sums", pa.string()), ("s", pa.list_(pa.float64())), ("v", pa.list_(pa.float64()))])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One summary of a few of the same length, in the order of their parts."""
    d, out = int(pdf["dims"].iloc[0]), None
    for _, r in pdf.sort_values("part").iterrows():
        x = Summary(int(r["n"]), np.array(json.loads(r["sums"]), object), np.asarray(r["s"], float), np.asarray(r["v"], float).reshape(-1, d))
        out = merged(out, x) if out else x
    return pd.DataFrame([_row(int(pdf["part"].min()), d, out)])


class Model(NamedTuple):
    """Of one length: rows, sums less the offset, eigenvalues, components, the variance of all."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times the entries less their sums, exact: longs, or Python numbers where those are too small."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums.tolist()))
        if most < 1 << 62:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def whitened(self, c: np.ndarray) -> np.ndarray:
        return (c / self.n).astype(float) @ self.components.T / np.sqrt(self.values)

    def deviation(self, c: np.ndarray) -> list[int | None]:
        most = max(abs(int(c.max(initial=0))), abs(int(c.min(initial=0))))
        if c.dtype != object and most * most * c.shape[1] < 1 << 63:
            return (c * c).sum(axis=1).tolist()
        return [t if t < 1 << 63 else None for t in (c.astype(object) ** 2).sum(axis=1).tolist()]


def fit(vectors: DataFrame, most: int = 16) -> dict[int, Model]:
    """The model of each length, of a staged table of distinct vectors ``x``; components with variance, at most ``most``."""
    parts = stage(vectors.select("x").mapInArrow(_summaries, SUMMARY), "summaries")
    last = parts.agg(F.max("part")).first()[0]
    level = parts
    while last:
        last //= FAN_IN
        level = level.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("dims", "part").applyInPandas(_merge, SUMMARY)
    # only what is used goes to the driver
    used = F.slice("s", 1, most), F.slice("v", 1, (most * F.col("dims")).cast("int")), F.aggregate("s", F.lit(0.0), lambda t, s: t + s * s)
    rows = level.select("dims", "n", "sums", used[0].alias("s"), used[1].alias("v"), used[2].alias("squares")).collect()
    unstage(parts)
    out = {}
    for r in rows:
        s, v = np.array(r["s"]), np.array(r["v"]).reshape(-1, r["dims"])
        kept = (s > 0) & (s > 1e-13 * s.max(initial=0) * max(r["dims"], 1))
        out[r["dims"]] = Model(r["n"], np.array(json.loads(r["sums"]), object), s[kept] ** 2 / r["n"], v[kept], r["squares"] / r["n"])
    return out


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """By length, the largest absolute entry of the whitened fit list's covariance minus the identity."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _matrices(b["x"]):
                w = models[d].whitened(models[d].centred(x))
                w = np.hstack((w, np.ones((len(w), 1))))
                held[d] = held.get(d, 0) + w.T @ w
        for d, x in held.items():
            yield pa.RecordBatch.from_pydict({"dims": pa.array([d] * x.size), "at": pa.array(range(x.size)), "v": pa.array(x.ravel())})

    rows = vectors.select("x").mapInArrow(sums, "dims long, at long, v double").groupBy("dims", "at").agg(F.sum("v").alias("v")).collect()
    out = {}
    for d, m in models.items():
        k = len(m.values)
        if k:
            x = np.zeros((k + 1) ** 2)
            for r in rows:
                if r["dims"] == d:
                    x[r["at"]] = r["v"]
            x = x.reshape(k + 1, k + 1) / m.n
            out[d] = float(np.abs(x[:k, :k] - np.outer(x[k, :k], x[k, :k]) - np.eye(k)).max())
    return out


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every finite row and component."""
    rows = embeddings.where(finite(vec_col)).select(F.col(id_col).alias("vec_id"), entries(vec_col).alias("x"))
    vectors = stage(rows.select("x").distinct(), "vectors")
    models = fit(vectors, most)
    errors = identity_errors(vectors, models)
    kind = rows.schema["vec_id"].dataType
    schema = pa.schema([("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in _matrices(b["x"]):
                m = models[d]
                k = len(m.values)
                if not k:
                    continue
                c = m.centred(x)
                columns = [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), m.n)), pa.array(m.deviation(c), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(m.whitened(c).ravel()), pa.array(np.tile(m.values / m.trace, len(x))), pa.array(np.full(k * len(x), errors[d])),
                ]
                yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(np.repeat(at, k))), *columns], names=["vec_id", *schema.names])

    return rows.mapInArrow(score, f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
