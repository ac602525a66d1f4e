"""Pairs of records by the tokens that they share, without a row a pair on the way.

1. A batch of records sends its tokens in ranges of their hashes, sorted and packed: some 8
   bytes a token of a record. A partition of tokens keeps those of 2 to ``most`` records.
2. Tokens of the same records, as often in each, are one: a passage that the same records
   hold makes one list of records, with a weight, and not one a word. Lists are known by a
   64-bit sum of hashes of their records.
3. A list goes to each block of records of which it holds one. A block's task adds up the
   weights of the lists of its records, a few records at a time, and streams the pairs: none
   is shuffled or stored, however many there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD_TOKENS, HELD_RECORDS = 4_000_000, 60_000  # that are packed at once
BUCKET_TOKENS = 2_000_000  # about the tokens of a partition of tokens
BLOCK_TOKENS = 4_000_000  # about the tokens of the records of a block
CELLS = 4_000_000  # pairs that are added up at once


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, so that equal ones follow each other."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def unplaned(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(kind).ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _named(kind: tuple[str | None, bool]) -> int:
    return int.from_bytes(hashlib.blake2b(repr(kind).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Kinds:
    """Numbers of (collection, whether the record has no name) in a task."""

    def __init__(self) -> None:
        self.all: dict[tuple[str | None, bool], int] = {}

    def of(self, sources: list[str | None], unnamed: list[bool]) -> np.ndarray:
        return np.array([self.all.setdefault(k, len(self.all)) for k in zip(sources, unnamed, strict=True)], np.int64)

    def hashes(self) -> np.ndarray:
        return np.array([_named(k) for k in self.all], np.uint64)


def _groups(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The values of a sorted column and where each lies."""
    cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else np.zeros(1, np.int64)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(of[lo]), slice(lo, hi)


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k] .. starts[k] + sizes[k] - 1 of all k."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _coded(kind: np.ndarray, every: list[tuple[str | None, bool]]) -> tuple[bytes, list[str | None], list[bool]]:
    """Numbers of kinds, and those that occur, to send along."""
    some, at = np.unique(kind, return_inverse=True)
    return planes(at.astype(np.uint32)), [every[k][0] for k in some.tolist()], [every[k][1] for k in some.tolist()]


SENT = "bucket int, tokens binary, at binary, n binary, ids binary, kind binary, sources array<string>, unnamed array<boolean>"
LISTS = "place int, fp binary, weight binary, size binary, ids binary, n binary, kind binary, sources array<string>, unnamed array<boolean>"
_KINDS = {"sources": pa.list_(pa.string()), "unnamed": pa.list_(pa.bool_())}


def _table(columns: str, rows: list[tuple]) -> dict[str, pa.Array]:
    names = [c.split()[0] for c in columns.split(", ")]
    made = zip(*rows, strict=True) if rows else [[] for _ in names]
    return {c: pa.array(list(x), _KINDS.get(c, pa.binary() if k else pa.int32())) for k, (c, x) in enumerate(zip(names, made, strict=True))}


def windows(h: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k`` words in a row of each record, and how many it has; h: of its words, size: how many."""
    count = np.maximum(size - (k - 1), 0)
    at = _flat(np.cumsum(size) - size, count)
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total = mixed(total * np.uint64(0xD1342543DE82EF95) + h[at + j])
    return total, count


def _sent(bits: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kinds = Kinds()

        def packed() -> pa.RecordBatch:
            ids, kind, size, tok = (np.concatenate(c) for c in zip(*held, strict=True))
            every = list(kinds.all)
            row = np.repeat(np.arange(len(ids), dtype=np.uint32), size)
            order = np.argsort(tok, kind="stable")
            t, r = tok[order], row[order]
            at = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (r[1:] != r[:-1]))))
            n, t, r = np.diff(np.append(at, len(t))).astype(np.uint32), t[at], r[at]
            out = []
            for bucket, s in _groups((t >> np.uint64(64 - bits)).astype(np.int64)):
                there = np.zeros(len(ids), bool)
                there[r[s]] = True
                own = np.cumsum(there) - 1
                out.append((bucket, planes(t[s]), planes(own[r[s]].astype(np.uint16)), planes(n[s]), planes(ids[there]), *_coded(kind[there], every)))
            return pa.RecordBatch.from_pydict(_table(SENT, out))

        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                size = pc.fill_null(pc.list_value_length(b["words"]), 0).to_numpy().astype(np.int64)
                ids, source = pc.fill_null(b["id"], 0).to_numpy(), b["source"].dictionary_encode()
                unnamed = b["id"].is_null().to_numpy(zero_copy_only=False)
                names = [*source.dictionary.to_pylist(), None]
                code = pc.fill_null(source.indices, len(names) - 1).to_numpy()
                kind = np.stack((kinds.of(names, [False] * len(names)), kinds.of(names, [True] * len(names))))[unnamed.astype(np.int64), code]
                tok, size = windows(b["words"].flatten().to_numpy().view(np.uint64), size, k)
                held.append((ids, kind, size, tok))
                if sum(len(x[3]) for x in held) > HELD_TOKENS or sum(len(x[0]) for x in held) > HELD_RECORDS:
                    yield packed()
                    held, kinds = [], Kinds()
        if sum(len(x[3]) for x in held):
            yield packed()

    return run


def _lists(most: int | None, places: int):
    """The lists of the tokens of one bucket, packed by their fingerprint."""

    def run(t: pa.Table) -> pa.Table:
        kinds, parts = Kinds(), []
        for row in t.to_pylist():
            at = unplaned(row["at"], np.uint16)
            own = kinds.of(row["sources"], row["unnamed"])[unplaned(row["kind"], np.uint32)]
            parts.append((unplaned(row["tokens"], np.uint64), unplaned(row["ids"], np.int64)[at], own[at], unplaned(row["n"], np.uint32)))
        tok, ids, kind, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(tok, kind="stable")
        s = tok[order]
        same = s[1:] == s[:-1]
        order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        tok, ids, kind, n = tok[order], ids[order], kind[order], n[order].astype(np.int64)
        order = np.lexsort((kind, ids, tok))
        tok, ids, kind, n = tok[order], ids[order], kind[order], n[order]
        # rows of one record count as one
        at = np.flatnonzero(np.concatenate(([True], (tok[1:] != tok[:-1]) | (ids[1:] != ids[:-1]) | (kind[1:] != kind[:-1])))) if len(tok) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, at) if len(at) else n
        tok, ids, kind = tok[at], ids[at], kind[at]
        starts = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1]))) if len(tok) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(tok)))
        keep = (size > 1) & (size <= (most or len(tok)))
        starts, size = starts[keep], size[keep]
        at = _flat(starts, size)
        ids, kind, n = ids[at], kind[at], n[at]
        starts = np.cumsum(size) - size
        if not len(size):
            return pa.table(_table(LISTS, []))
        each = mixed(mixed(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ kinds.hashes()[kind] + n.view(np.uint64) * np.uint64(0xD1342543DE82EF95))
        fp = mixed(np.add.reduceat(each, starts) + size.astype(np.uint64))
        return pa.table(_table(LISTS, _by_place((fp % np.uint64(places)).astype(np.int64), fp, np.ones(len(fp), np.int64), starts, size, ids, n, kind, list(kinds.all))))

    return run


def _by_place(place: np.ndarray, fp: np.ndarray, weight: np.ndarray, starts: np.ndarray, size: np.ndarray, ids: np.ndarray, n: np.ndarray, kind: np.ndarray, every: list) -> list[tuple]:
    """Rows of LISTS: the lists that go to each place."""
    order = np.lexsort((fp, place))
    out = []
    for p, s in _groups(place[order]):
        own = order[s]
        at = _flat(starts[own], size[own])
        out.append((p, planes(fp[own]), planes(weight[own]), planes(size[own]), planes(ids[at]), planes(n[at]), *_coded(kind[at], every)))
    return out


def _once(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Each list of some rows of LISTS once, its weight summed: (fp, weight, starts, size, ids, n, kind, kinds)."""
    kinds, parts = Kinds(), []
    for row in t.to_pylist():
        parts.append((unplaned(row["fp"], np.uint64), unplaned(row["weight"], np.int64), unplaned(row["size"], np.int64), unplaned(row["ids"], np.int64), unplaned(row["n"], np.int64), kinds.of(row["sources"], row["unnamed"])[unplaned(row["kind"], np.uint32)]))
    fp, weight, size, ids, n, kind = (np.concatenate(c) for c in zip(*parts, strict=True))
    fp, first, back = np.unique(fp, return_index=True, return_inverse=True)
    starts = np.cumsum(size) - size
    return fp, np.bincount(back, weight, len(fp)).astype(np.int64), starts[first], size[first], ids, n, kind, list(kinds.all)


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(blocks)).astype(np.int64)


def _routed(blocks: int):
    """The lists of one part of fingerprints, for each block that holds one of their records."""

    def run(t: pa.Table) -> pa.Table:
        fp, weight, starts, size, ids, n, kind, every = _once(t)
        which = np.repeat(np.arange(len(fp)), size)
        both = np.unique(_block_of(ids[_flat(starts, size)], blocks) * len(fp) + which)
        place, own = np.divmod(both, len(fp))
        return pa.table(_table(LISTS, _by_place(place, fp[own], weight[own], starts[own], size[own], ids, n, kind, every)))

    return run


PAIRS = "qt string, tt string, query long, target long, score long"


def _paired(blocks: int):
    """The pairs of the records of a partition's blocks with all records of their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            for k, block in enumerate(b["place"].to_pylist()):
                held.setdefault(block, []).append(b.slice(k, 1))
        for block in sorted(held):
            yield from pairs(block, pa.Table.from_batches(held.pop(block)))

    def pairs(block: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        _, weight, starts, size, ids, n, kind, every = _once(t)
        order = np.lexsort((kind, ids))
        first = np.concatenate(([True], (ids[order][1:] != ids[order][:-1]) | (kind[order][1:] != kind[order][:-1])))
        node = np.empty(len(ids), np.int64)
        node[order] = np.cumsum(first) - 1  # of each record that occurs
        ids, kind = ids[order][first], kind[order][first]
        source = pa.array([k[0] for k in every], pa.string())
        unnamed = np.array([k[1] for k in every])

        def columns(at: np.ndarray) -> tuple[pa.Array, pa.Array]:
            return source.take(pa.array(kind[at])), pa.array(ids[at], pa.int64(), mask=unnamed[kind[at]])

        at = _flat(starts, size)
        which = np.repeat(np.arange(len(size)), size)
        own = np.flatnonzero(_block_of(ids[node[at]], blocks) == block)
        own = own[np.argsort(node[at[own]], kind="stable")]
        query, score, which = node[at[own]], n[at[own]] * weight[which[own]], which[own]
        ends = np.cumsum(size[which])
        firsts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1], [True])))
        k = 0
        while k + 1 < len(firsts):
            lo = firsts[k]
            before = ends[lo - 1] if lo else 0
            k = max(k + 1, int(np.searchsorted(ends[firsts[k + 1 :] - 1], before + CELLS, "right")) + k)
            hi = firsts[k]
            long, local = size[which[lo:hi]], np.cumsum(np.concatenate(([False], query[lo + 1 : hi] != query[lo : hi - 1])))
            cell, value = np.repeat(local, long) * len(ids) + node[_flat(starts[which[lo:hi]], long)], np.repeat(score[lo:hi], long)
            if (local[-1] + 1) * len(ids) <= 4 * len(cell):
                total = np.bincount(cell, value, (local[-1] + 1) * len(ids))
                cell = np.flatnonzero(total)
                total = total[cell]
            else:
                cell, back = np.unique(cell, return_inverse=True)
                total = np.bincount(back, value, len(cell))
            q, target = np.divmod(cell, len(ids))
            names = query[lo:hi][np.searchsorted(local, np.arange(local[-1] + 1))]
            for x in range(0, len(cell), 100_000):
                (qt, a), (tt, b) = columns(names[q[x : x + 100_000]]), columns(target[x : x + 100_000])
                yield pa.RecordBatch.from_arrays([qt, tt, a, b, pa.array(total[x : x + 100_000].astype(np.int64))], names=["qt", "tt", "query", "target", "score"])

    return run


def shared_pairs(rows: DataFrame, tokens: int, most: int | None = None, k: int = 1) -> DataFrame:
    """(qt, tt, query, target, score) of all ordered pairs of records that share a token of 2 to ``most`` records, each with itself too.

    ``rows`` are (id, source, words), the words as well-mixed 64-bit hashes; a token is ``k``
    words in a row, of which there are about ``tokens`` in all. Rows of one id and source are
    one record. The score is how often the query has the tokens that both have.
    """
    bits = max(4, int(np.ceil(np.log2(max(1, tokens) / BUCKET_TOKENS))))
    blocks = max(12, tokens // BLOCK_TOKENS)
    sent = rows.select(F.col("id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), "words").mapInArrow(_sent(bits, k), SENT)
    lists = sent.groupBy("bucket").applyInArrow(_lists(most, blocks), LISTS)
    routed = lists.groupBy("place").applyInArrow(_routed(blocks), LISTS)
    return routed.repartition(blocks, "place").mapInArrow(_paired(blocks), PAIRS)
