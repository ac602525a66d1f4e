"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are taken relative to the nearest of a few centres, turned by ``TURNS`` random
rotations side by side and kept as packed sign bits with correction scalars: the
residual's length, and the cosine between the residual and its code. The inner product of
a query with a vector is estimated from the packed bits alone: the turned query is rounded
to 4 bits a dimension, and the bits of each of its 4 planes that a code shares are
counted. The code's cosine gives an error bound that grows as 1 / sqrt(bits). A vector is
reranked with its original numbers when its estimate plus bound reaches the query's
threshold, a score that twice as many vectors as are asked for are known to reach.

Layout: the index is a staged table of blocks of one centre with about ``BLOCK`` vectors
each: ids, codes, scalars, and the original numbers for the rerank. Queries are in chunks
of ``CHUNK``; a chunk meets a block only if the centre's bound, <query, centre> + |query| *
(largest residual), reaches the threshold of one of its queries. The blocks that a chunk meets lie in ``STRIPES`` tasks, each of which raises
the chunk's thresholds from block to block. A stated query set meets all rows in blocks; no
row is a key, and equal vectors spread over blocks. The centres, whose number grows with
the square root of the vectors up to ``CENTRES``, and the first thresholds come from a
bounded sample (``SAMPLE`` vectors by hash of the id); every vector is indexed.

Defined results: vectors that are null, zero, or hold null or non-finite numbers take no
part, and neither do those of another length than most, whose inner product with the rest
is not defined; a query's own id is never its neighbour; rows with one id are one
candidate each, equal rows once; ties go to the smaller id; with fewer than ``k``
candidates all are returned; columns other than the two named play no part, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions.staging import stage, stage_counted

SAMPLE = 16_384  # vectors to fit centres and first thresholds
CENTRES = 256  # at most
TURNS = 4  # rotations side by side, each of as many bits as dimensions
PLANES = 4  # bits of a query's turned dimensions
BLOCK = 4096
CHUNK = 1024
STRIPES = 8  # tasks of a chunk
ERROR = 2.5  # standard deviations in the error bound


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of vectors that take part; v is an array of doubles."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)).withColumn("n", F.size("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products; equal rows give equal sums wherever they stand."""
    return (a * b).sum(axis=1)


def centres(sample: np.ndarray, n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(8):
        near = ((sample**2).sum(1)[:, None] - 2 * sample @ c.T + (c**2).sum(1)).argmin(1)
        c = np.array([sample[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def rotation(dims: int, seed: int, turns: int = TURNS) -> np.ndarray:
    """Random orthogonal matrices side by side, scaled so that lengths are kept; columns fill whole 64-bit words."""
    rng = np.random.default_rng(seed + 1)
    wide = -(-turns * dims // 64) * 64
    parts = []
    for _ in range(-(-wide // dims)):
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        parts.append(q * np.sign(np.diag(r)))
    out = np.hstack(parts)[:, :wide]
    return out / np.sqrt(wide / dims)


class Codes:
    """Packed sign bits and correction scalars of vectors around one centre."""

    def __init__(self, bits: np.ndarray, length: np.ndarray, cosine: np.ndarray):
        self.bits, self.length, self.cosine = bits, length, cosine
        self.ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        wide = 64 * bits.shape[1]
        self.factor = length / cosine
        self.spread = length * np.sqrt((1 - np.minimum(1, cosine) ** 2) / (cosine**2 * max(1, wide - 1)))

    @classmethod
    def of(cls, v: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> "Codes":
        r = v - centre
        length = np.sqrt(dots(r, r))
        unit = r / np.maximum(length, 1e-300)[:, None] @ turn
        bits = np.packbits(unit > 0, axis=1, bitorder="little").view(np.uint64)
        return cls(bits, length, np.maximum(np.abs(unit).sum(axis=1) / np.sqrt(unit.shape[1]), 1e-6))

    def estimate(self, q: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, bounds), queries x vectors; q is turned, base its product with the centre.

        With x the unit residual and c its code, <q, x> is estimated by <q, c> / <c, x>;
        the part of q across x errs by about |q| sqrt((1 - <c, x>^2) / (<c, x>^2 (bits - 1))).
        """
        wide = q.shape[1]
        low = q.min(axis=1)
        step = np.maximum((q.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
        shared = np.zeros((len(q), len(self.bits)), np.int32)
        for plane in range(PLANES):
            mask = np.packbits((level >> plane) & 1, axis=1, bitorder="little").view(np.uint64)
            count = np.bitwise_count(mask[:, :1] & self.bits[:, 0]).astype(np.int32)
            for word in range(1, mask.shape[1]):
                count += np.bitwise_count(mask[:, word : word + 1] & self.bits[:, word])
            shared += count << plane
        total = low * wide + step * level.sum(axis=1)
        product = (2 * (step[:, None] * shared + low[:, None] * self.ones) - total[:, None]) / np.sqrt(wide)
        norm = np.sqrt(dots(q, q))
        rounding = step * np.sqrt(1 / 12)  # of a unit code with the rounded query
        bound = ERROR * np.sqrt((norm[:, None] * self.spread) ** 2 + (rounding[:, None] * self.factor) ** 2)
        return base[:, None] + product * self.factor, bound + 1e-9 * norm[:, None] * (1 + self.length)


def _search(dims: int, k: int, turn: np.ndarray, mid: np.ndarray):
    """Scores of the pairs of chunks and blocks that may be among the query's k nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # of each chunk here: the k largest scores so far of its queries
        for batch in batches:
            for row in batch.to_pylist():
                ids, v = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, dims)
                codes = Codes(np.frombuffer(row["bits"], np.uint64).reshape(len(ids), -1), np.frombuffer(row["length"]), np.frombuffer(row["cosine"]))
                qid, q, floor = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["queries"]).reshape(-1, dims), np.frombuffer(row["floors"])
                at = np.frombuffer(row["places"], np.int32)
                top = best.setdefault(row["chunk"], np.full((row["size"], k), -np.inf))
                out_q, out_v, out_s = [], [], []
                for lo in range(0, len(q), 64):
                    part, own = q[lo : lo + 64], at[lo : lo + 64]
                    least = np.maximum(floor[lo : lo + 64], top[own].min(axis=1))
                    guess, bound = codes.estimate(part @ turn, part @ mid[row["cell"]])
                    i, j = np.nonzero(guess + bound >= least[:, None])
                    other = ids[j] != qid[lo + i]
                    i, j = i[other], j[other]
                    score = dots(part[i], v[j])
                    good = score >= least[i]
                    i, j, score = i[good], j[good], score[good]
                    order = np.lexsort((ids[j], -score, i))
                    i, j, score = i[order], j[order], score[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    keep = place < k
                    i, j, score, place = i[keep], j[keep], score[keep], place[keep]
                    new = np.full((len(part), k), -np.inf)
                    new[i, place] = score
                    top[own] = np.partition(np.hstack((top[own], new)), k, axis=1)[:, k:]
                    out_q.append(qid[lo + i])
                    out_v.append(ids[j])
                    out_s.append(score)
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])

    return run


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 20, every: int = 20, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose id is divisible by ``every``.

    Vectors of different lengths have no inner product; those of each length are searched apart.
    """
    rows = stage(usable(df, id_col, vec_col).distinct(), "usable")
    lengths = [r["n"] for r in rows.groupBy("n").count().where("count > 1").orderBy("n").collect()]  # a row a length
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dims in lengths:
        out = out.unionByName(_of_length(rows.where(F.col("n") == dims).drop("n"), dims, k, every, seed))
    return out


def _of_length(rows: DataFrame, dims: int, k: int, every: int, seed: int) -> DataFrame:
    """The search among vectors of one length."""
    rows, total = stage_counted(rows, "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).toArrow()
    ids, sampled = sample["vec_id"].to_numpy(), matrix(sample["v"].combine_chunks(), dims)
    mid, turn = centres(sampled, min(CENTRES, max(16, int(total**0.5 / 8))), seed), rotation(dims, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b["v"], dims)
            near = ((mid**2).sum(1) - 2 * v @ mid.T).argmin(1) if len(v) else np.zeros(0, np.int64)
            r = v - mid[near]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(near.astype(np.int32)), pa.array(np.sqrt(dots(r, r)))], names=["vec_id", "v", "cell", "length"])

    placed = stage(rows.mapInArrow(place, "vec_id long, v array<double>, cell int, length double"), "placed")
    cells = {r["cell"]: (r["n"], r["reach"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("length").alias("reach")).collect()}  # at most CENTRES rows
    parts = F.create_map(*[F.lit(x) for c, (n, _) in cells.items() for x in (c, -(-n // BLOCK))])

    def pack(t: pa.Table) -> pa.Table:
        cell = t["cell"][0].as_py()
        order = np.argsort(t["vec_id"].to_numpy(), kind="stable")
        v = matrix(t["v"].combine_chunks(), dims)[order]
        codes = Codes.of(v, mid[cell], turn)
        blobs = {"ids": t["vec_id"].to_numpy()[order], "bits": codes.bits, "length": codes.length, "cosine": codes.cosine, "vectors": v}
        return pa.table({"cell": pa.array([cell], pa.int32())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in blobs.items()})

    blocks = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts[F.col("cell")]))
    index = stage(blocks.groupBy("cell", "part").applyInArrow(pack, "cell int, ids binary, bits binary, length binary, cosine binary, vectors binary"), "index")

    names = ("cell", "chunk", "size", "places", "qids", "queries", "floors")

    def chunk(t: pa.Table) -> pa.Table:
        """The chunk with its first thresholds, once for each cell that it must meet."""
        order = np.argsort(t["vec_id"].to_numpy(), kind="stable")
        qid, q = t["vec_id"].to_numpy()[order], matrix(t["v"].combine_chunks(), dims)[order]
        floor = np.full(len(q), -np.inf)
        for lo in range(0, len(q) if len(ids) > 2 * k else 0, 64):
            own = q[lo : lo + 64] @ sampled.T
            own[qid[lo : lo + 64, None] == ids] = -np.inf
            floor[lo : lo + 64] = np.partition(own, len(ids) - 2 * k, axis=1)[:, len(ids) - 2 * k]
        norm = np.sqrt(dots(q, q))
        floor -= 1e-12 * norm * np.abs(sampled).max() * dims  # these products are rounded in another order
        out = []
        for c, (_, reach) in cells.items():
            meet = q @ mid[c] + norm * reach * (1 + 1e-9) + 1e-9 >= floor
            if meet.any():
                out.append((c, t["chunk"][0].as_py(), len(q), np.flatnonzero(meet).astype(np.int32).tobytes(), qid[meet].tobytes(), q[meet].tobytes(), floor[meet].tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
        return pa.table({n: pa.array(x, kind) for n, x, kind in zip(names, zip(*out, strict=True) if out else ((),) * 7, kinds, strict=True)})

    asked = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    n_chunks = max(1, -(-asked.count() // CHUNK))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_chunks)))
    chunks = stage(asked.groupBy("chunk").applyInArrow(chunk, "cell int, chunk long, size int, places binary, qids binary, queries binary, floors binary"), "chunks")

    met = chunks.join(index, "cell").repartition("chunk", F.pmod(F.xxhash64("ids"), F.lit(STRIPES)))
    found = met.mapInArrow(_search(dims, k, turn, mid), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
