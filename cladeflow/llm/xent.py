"""Document scores by cross-entropy difference of two n-gram models.

A target model (words of chosen documents, such as those labelled good) and a background
model (words of all documents) share one vocabulary: every word of the corpus (or, where
``vocabulary`` is given, that many most frequent ones), the unknown word and an end mark.
Both are bigram models with Dirichlet smoothing towards their own unigrams, which are
smoothed by one count:

    p(w | h) = (c(h, w) + MU p(w)) / (c(h) + MU),   p(w) = (c(w) + 1) / (N + V)

A document's score is the mean over its tokens (words and the end mark) of the target's
loss less the background's: the lower, the more like the target.

Counts cover every document and grow with the corpus: neither words nor bigrams are cut
off. Words are 64-bit hashes. A batch of documents sends each of its bigrams once to the
partition of the second word, with the documents that hold it and how often, so that the
same task counts words and bigrams over the corpus and scores all documents that hold
them; a frequent bigram costs two or three bytes a document. The losses of a document hold
log(c(h) + MU) once for its start and each of its words, which are its tokens again (as
many starts as end marks), so that a token's own partition adds it and no unigram count is
needed elsewhere. Bigrams of a word that would fill a partition are dealt by both words;
only the counts of such words (at most 20 for each ``PARTITION_TOKENS``, and ``MOST_DEALT`` in
all, since a word is one of them only if it is more than that part of all tokens), the unknown
word and the end mark go to every task. The sums go back to the batch of documents they came
from, two numbers a document and partition. First words are told apart by 32 bits of their
hash, among those before one second word.

Defined results: a null, empty or blank text has no tokens and a null score; rows with one
doc_id are scored as one document, each text with its own start and end; so are the rows
with a null doc_id, which are never target documents; without target documents the target
model is uniform; without rows there is no result. Columns other than the two named play no
part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.staging import stage, stage_counted, unstage
from cladeflow.llm.tokens import mix, words

MU = 100.0
BATCH_ROWS = 2_500  # places in a batch must fit 16 bits
PARTITION_TOKENS = 3_000_000  # about the tokens of one part, whatever the input
MOST_DEALT = 1_000_000  # words whose counts go to every task, at most
BROADCAST_IDS = 500_000  # target documents of whose ids a copy goes to every task; beyond, texts are joined by merge
END, UNKNOWN = np.uint64(0), np.uint64(1)  # as words; END as a history is the start


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n, target) by word hash, over all rows and over target rows; END counts texts with words."""

    def merged(parts: list[np.ndarray]) -> np.ndarray:
        h, n, t = np.concatenate(parts, axis=1)
        u, back = np.unique(h, return_inverse=True)
        return np.stack((u, *(np.bincount(back, x, len(u)).astype(np.uint64) for x in (n, t))))

    def batch(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in np.ascontiguousarray(x)], names=["word", "n", "target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            chosen = b["target"].to_numpy(zero_copy_only=False)
            for w in words(b["text"]):
                size, own = np.diff(w.bounds), chosen[w.lo : w.hi]
                ends = size > 0
                h = np.concatenate((w.hashes, np.full(ends.sum(), END)))
                t = np.concatenate((np.repeat(own, size), own[ends])).astype(np.uint64)
                if not len(h):
                    continue
                parts.append(merged([np.stack((h, np.ones(len(h), np.uint64), t))]))
                held += parts[-1].shape[1]
                if held > 1_000_000:
                    parts = [merged(parts)]
                    held = parts[0].shape[1]
                    if held > 500_000:
                        yield batch(parts[0])
                        parts, held = [], 0
        if parts:
            yield batch(merged(parts))

    return rows.select("text", "target").mapInArrow(run, "word long, n long, target long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("target").alias("target"))


class Unigrams(NamedTuple):
    """Totals of the unigrams, and the counts of the words that are dealt by both words of a bigram."""

    size: int  # the words of the vocabulary, the unknown word and the end mark
    totals: tuple[int, int]  # tokens of target rows and of all rows
    dealt: np.ndarray  # sorted words
    counts: np.ndarray  # their counts in target rows and in all rows
    known: np.ndarray | None  # the sorted vocabulary where it is bounded

    def encoded(self, h: np.ndarray) -> np.ndarray:
        """Words outside a bounded vocabulary become the unknown word."""
        return h if self.known is None else np.where(found(h, self.known)[0], h, UNKNOWN)


def found(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether words are in a sorted table that is not empty, and their places."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h, at


def unigrams(rows: DataFrame, vocabulary: int | None) -> Unigrams:
    counts = stage(word_counts(rows), "words")
    some = counts.where(F.col("word") != int(END))
    total = counts.agg(F.sum("n"), F.sum("target"), F.count_if(F.col("word") != int(END))).first()
    n, target, distinct = total[0] or 0, total[1] or 0, total[2]
    texts = counts.where(F.col("word") == int(END)).select("n", "target").first() or (0, 0)
    least, known, unknown = max(PARTITION_TOKENS // 20, n // MOST_DEALT), None, (0, 0)
    if vocabulary is not None and vocabulary < distinct:
        got = some.orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()
        known = np.sort(np.append(got["word"].to_numpy().view(np.uint64), (END, UNKNOWN)))
        unknown = (n - texts[0] - int(got["n"].to_numpy().sum()), target - texts[1] - int(got["target"].to_numpy().sum()))
        distinct = vocabulary
        got = got.filter(pc.greater(got["n"], least))
    else:
        got = some.where(F.col("n") > least).toArrow()
    unstage(counts)
    word = np.append(got["word"].to_numpy().view(np.uint64), (END, UNKNOWN))
    both = np.array([np.append(got[c].to_numpy(), (texts[k], unknown[k])) for k, c in ((1, "target"), (0, "n"))], np.int64)
    order = np.argsort(word)
    return Unigrams(distinct + 2, (target, n), word[order], both[:, order], known)


FIELDS = ("own", "target", "words", "pairs", "histories", "holders", "docs", "count", "large")


def cuts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def pack_bigrams(rows: DataFrame, table: Unigrams, parts: int) -> DataFrame:
    """Distinct bigrams of a batch of documents with their holders, a row for each part.

    A row holds the batch's name, the places in the batch of the documents that it has
    (``own``) with their target flags; the second words, for each the number of its first
    words (``pairs``); of each pair the 32 bits of the first word and the number of its
    holders; and of each holder its place in ``own`` and its count (those from 255 on are
    in ``large``). The batch's first row also has the doc_ids, which of them are null, and
    the tokens of the whole batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(lo, BATCH_ROWS) for x in batches for lo in range(0, x.num_rows, BATCH_ROWS)):
            ids, chosen = b["doc_id"].fill_null(0).to_numpy(), b["target"].to_numpy(zero_copy_only=False)
            null = b["doc_id"].is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            firsts, seconds, docs, tokens = [], [], [], np.zeros(len(ids), np.int32)
            for some in words(b["text"]):
                n = np.diff(some.bounds)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                # each document as start, words, end: histories and words side by side
                x = table.encoded(some.hashes)
                size = n[full] + 1
                tokens[full + some.lo] = size
                first = np.cumsum(size) - size
                prior, following = np.full(size.sum(), END), np.full(size.sum(), END)
                inner = np.ones(size.sum(), bool)
                inner[first] = False
                prior[inner] = x
                inner[:] = True
                inner[first + size - 1] = False
                following[inner] = x
                firsts.append(prior)
                seconds.append(following)
                docs.append(np.repeat(full + some.lo, size).astype(np.uint16))
            if not docs:
                continue
            h, w, doc = np.concatenate(firsts), np.concatenate(seconds), np.concatenate(docs)
            key = mix(w)
            key = np.where(found(w, table.dealt)[0], mix(key ^ h), key)
            part = (key % np.uint64(parts)).astype(np.int32)
            h = (mix(h ^ np.uint64(0x3C79AC492BA7B653)) >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((doc, h, w, part))
            h, w, doc, part = h[order], w[order], doc[order], part[order]
            new = cuts(part, w, h, doc)
            count = np.diff(np.append(new, len(h))).astype(np.int32)
            h, w, doc, part = h[new], w[new], doc[new], part[new]
            name = int.from_bytes(hashlib.blake2b(ids.tobytes() + null.tobytes(), digest_size=8).digest(), "little", signed=True)
            out, edge = [], np.append(cuts(part), len(part))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                own, at = np.unique(doc[lo:hi], return_inverse=True)
                n, ww, hh = count[lo:hi], w[lo:hi], h[lo:hi]
                pair = cuts(ww, hh)
                word = cuts(ww[pair])
                sizes = (np.diff(np.append(word, len(pair))).astype(np.uint32), np.diff(np.append(pair, hi - lo)).astype(np.uint16))
                packed = (own, chosen[own].astype(np.uint8), ww[pair][word], sizes[0], hh[pair], sizes[1], at.astype(np.uint16), np.minimum(n, 255).astype(np.uint8), n[n >= 255])
                head = (b"", b"", b"") if out else (ids.tobytes(), null.tobytes(), tokens.tobytes())
                out.append((int(part[lo]), name, *head, *[x.tobytes() for x in packed]))
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * (3 + len(FIELDS)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "batch", "ids", "null", "tokens", *FIELDS])

    return rows.mapInArrow(run, "part int, batch long, " + ", ".join(f"{c} binary" for c in ("ids", "null", "tokens", *FIELDS)))


def _score(table: Unigrams):
    """Counts the words and bigrams of one part over the corpus and scores what each batch has of them."""

    def run(t: pa.Table) -> pa.Table:
        kinds = dict(zip(FIELDS, (np.uint16, np.uint8, np.uint64, np.uint32, np.uint32, np.uint16, np.uint16, np.uint8, np.int32), strict=True))
        blobs = [{c: np.frombuffer(t[c][x].as_py(), kind) for c, kind in kinds.items()} for x in range(t.num_rows)]
        word, history, counts, spans, at = [], [], [], [], 0
        for r in blobs:
            n = r["count"].astype(np.int32)
            n[n == 255] = r["large"]
            r["n"] = n
            first = np.cumsum(r["holders"], dtype=np.int64) - r["holders"]
            word.append(np.repeat(r["words"], r["pairs"]))
            history.append(r["histories"])
            counts.append(np.stack([np.add.reduceat(x, first) for x in (r["target"][r["docs"]] * n, n)]))
            spans.append((at, at + len(first)))
            at += len(first)
        w, h, n = np.concatenate(word), np.concatenate(history), np.concatenate(counts, axis=1)
        order = np.lexsort((h, w))
        w, h = w[order], h[order]
        pair, of = cuts(w, h), cuts(w)
        back = np.empty(len(w), np.int64)
        back[order] = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(w))))
        dealt, place = found(w[of], table.dealt)
        of = np.searchsorted(of, pair, "right") - 1  # the word of each bigram
        loss = []
        for k in (0, 1):
            c = np.bincount(back, n[k], len(pair))
            u = np.where(dealt, table.counts[k][place], np.bincount(of, c, len(dealt)))
            loss.append((np.log(u + MU)[of] - np.log(c + (MU * (u + 1) / (table.totals[k] + table.size))[of]))[back])
        out: dict[str, list] = {c: t[c].to_pylist() for c in ("batch", "ids", "null", "tokens", "own")} | {"target": [], "background": []}
        for r, (lo, hi) in zip(blobs, spans, strict=True):
            for name, x in zip(("target", "background"), loss, strict=True):
                sums = np.bincount(r["docs"], np.repeat(x[lo:hi], r["holders"]) * r["n"], len(r["own"]))
                out[name].append(sums.tobytes())
        return pa.table({k: pa.array(v, pa.int64() if k == "batch" else pa.binary()) for k, v in out.items()})

    return run


PARTIAL = "batch long, ids binary, null binary, tokens binary, own binary, target binary, background binary"


def _gathered(t: pa.Table) -> pa.Table:
    """One batch's documents with the sums of all parts."""
    rows = t.to_pylist()
    head = next(r for r in rows if r["ids"])
    # batches of equal doc_ids share a name: each of their rows adds to the same documents
    ids, null = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["null"], np.uint8) > 0
    n = sum(np.frombuffer(r["tokens"], np.int32).astype(np.int64) for r in rows if r["ids"])
    sums = np.zeros((2, len(ids)))
    for r in rows:
        own = np.frombuffer(r["own"], np.uint16)
        for k, name in enumerate(("target", "background")):
            sums[k, own] += np.frombuffer(r[name])
    some = n > 0
    return pa.table({"doc_id": pa.array(ids[some], mask=null[some]), "target": pa.array(sums[0, some]), "background": pa.array(sums[1, some]), "n": pa.array(n[some])})


def cross_entropy_difference(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every document.

    ``chosen`` has the doc_id of each target document. ``vocabulary`` bounds the words that
    are told apart; without it all are.
    """
    good = chosen.select(F.col(chosen.columns[0]).cast("long").alias("doc_id"), F.lit(True).alias("target")).where("doc_id is not null").distinct()
    good, n = stage_counted(good, "target")
    good = F.broadcast(good) if n <= BROADCAST_IDS else good.hint("merge")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = base.join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    table = unigrams(rows, vocabulary)
    parts = max(1, -(-table.totals[1] // PARTITION_TOKENS))
    packed = pack_bigrams(rows, table, parts)
    partial = packed.groupBy("part").applyInArrow(_score(table), PARTIAL)
    scored = partial.groupBy("batch").applyInArrow(_gathered, "doc_id long, target double, background double, n long")
    scored = scored.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("target").alias("t"), F.sum("background").alias("b"))
    out = base.select("doc_id").distinct()
    out = out.hint("merge").join(scored.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    n = F.col("n")
    return out.select("doc_id", F.coalesce(n, F.lit(0)).alias("n_tokens"), (F.col("t") / n).alias("target_loss"), (F.col("b") / n).alias("background_loss"), ((F.col("t") - F.col("b")) / n).alias("score"))
