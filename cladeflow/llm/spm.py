"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Text is cut into words (a run of word marks and what follows it, which no piece crosses);
distinct words of a batch are encoded once. Words of equal length advance together, one
character at a time: for every end and length the substring's hash probes the sorted keys
of the pieces, admissible arcs are scored, and the vectorised maximum stores a back
pointer.

For a unigram model an arc's score is the best score at its start plus the piece's score.
For a byte-pair model scores are merge ranks, not log-probabilities, and a maximum of
their sums would not be the model's encoding. There an arc is admissible when its piece
may follow the last piece at its start: the byte-pair encoding of a prefix is the only
chain of admissible arcs, which is tested by undoing the merges on both sides of the
boundary, latest first, and asking whether a merge across it would have come before. So
ids equal those of the library for both kinds.

Words of more than ``LONG`` characters, such as sentences of scripts without blanks, are
cut between two characters that stand side by side in no piece, where neither an arc nor a
merge can cross. Parts that are still longer advance together with their like, filled up
to one length. Only a part of over ``LONGEST`` characters without such a place takes the
sequential merge (or Viterbi), with the same results.

Defined results: a null text has null ids, an empty one none; a character without a piece
becomes its UTF-8 bytes' pieces, or the unknown piece where the model has no bytes; a byte
that is no UTF-8 counts as U+FFFD, and the text doesn't come back.
Decoding restores the text unless it holds the word mark U+2581 itself or characters that
became the unknown piece. Each row has a row, repeated rows equal ones, empty tables none;
columns other than those named play no part, whatever their names.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.llm.tokens import BASE, INVERSE, mix, pieces, powers

MARK = 0x2581
LONG = 48
LONGEST = 4096
CHUNK_CHARS = 1_000_000
KNOWN_WORDS = 500_000  # distinct words that a Python worker remembers between batches
BATCH_BYTES = 3_000_000  # of texts that are encoded together, unless one text is longer
SLOTS = 20  # bits of the index into the tables of piece keys
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Known:
    """Encoded words of a process by their hash; emptied when it holds too many."""

    def __init__(self) -> None:
        self.h, self.at, self.n, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, h: np.ndarray, at: np.ndarray, n: np.ndarray, tokens: np.ndarray) -> None:
        if len(self.h) + len(h) > KNOWN_WORDS:
            self.__init__()
        h, at, n = np.concatenate((self.h, h)), np.concatenate((self.at, at + len(self.tokens))), np.concatenate((self.n, n))
        self.tokens = np.concatenate((self.tokens, tokens.astype(np.int32)))
        order = np.argsort(h, kind="stable")
        self.h, self.at, self.n = h[order], at[order], n[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return i, self.h[i] == h


_known: dict[tuple, Known] = {}  # by model, for the life of a worker


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """The pieces of a SentencePiece model, as arrays."""

    def __init__(self, data: bytes, kind: int | None = None):
        self.kind, self.dummy, self.squeeze, charsmap = UNIGRAM, True, True, b""
        pieces: list[str] = []
        scores, types = [], []
        for field, value in fields(data):
            if field == 1:
                own = dict(fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                types.append(own.get(3, NORMAL))
            elif field == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif field == 3:
                own = dict(fields(value))
                charsmap, self.dummy, self.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        self.kind = kind or self.kind
        if charsmap or self.squeeze or USER in types or self.kind not in (UNIGRAM, BPE):
            raise ValueError("models with a character map, squeezed spaces or user-defined pieces are not supported")
        self.pieces, self.scores = pieces, np.array(scores)
        self.unknown = types.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t == BYTE}
        self.id = {p: i for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t == NORMAL}
        mark = chr(MARK)
        if any(mark in p.lstrip(mark) for p in self.id):
            raise ValueError("a piece holds a word mark after other characters")
        # pieces of several marks only: tried on runs of marks, apart from the words
        words = {p: i for p, i in self.id.items() if len(p) == 1 or p.strip(mark)}
        self.low = float(self.scores[list(words.values())].min())
        if self.kind == BPE:
            if any(mark * 2 in p for p in words) or any(self.scores[i] >= min(self.scores[words[q]] for q in words if len(q) > 1) for p, i in self.id.items() if p not in words):
                raise ValueError("runs of word marks do not come last in this model")
            reach = {p: s for p in words if (s := self._split(p)) is not None}
        else:
            reach = dict.fromkeys(self.id)
        self.longest = max(map(len, reach))
        self.beside = np.array(sorted({ord(a) << 32 | ord(b) for p in reach for a, b in zip(p, p[1:])}), np.uint64)
        keys = np.array([self._key(p) for p in reach], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([self.id[p] for p in reach], np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        v = len(pieces)
        self.rank = np.full(v, -1, np.int64)  # of merges; single characters are never made by one
        self.left, self.right = np.zeros(v, np.int64), np.zeros(v, np.int64)
        if self.kind == BPE:
            many = sorted((p for p in words if len(p) > 1), key=lambda p: -self.scores[words[p]])
            at, last = -1, None
            for p in many:
                if self.scores[words[p]] != last:
                    at, last = at + 1, self.scores[words[p]]
                self.rank[words[p]] = at
            for p, s in reach.items():
                if s:
                    self.left[self.id[p]], self.right[self.id[p]] = self.id[s[0]], self.id[s[1]]
            pairs = {(words[p[:k]] * v + words[p[k:]]): self.rank[words[p]] for p in many for k in range(1, len(p)) if p[:k] in words and p[k:] in words}
            self.pair_keys = np.array(sorted(pairs), np.int64)
            self.pair_rank = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self._tables()
        self.name = (zlib.crc32(data), len(data), self.kind)
        raw = [(p.replace(mark, " ").encode() if t == NORMAL else bytes((int(p[3:5], 16),)) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else b"") for p, t in zip(pieces, types, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.runs: dict[int, list[int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache_key": None, "cache_ok": None, "slot_a": None, "slot_b": None, "runs": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._tables()

    def _tables(self) -> None:
        """The memory of pairs, and two tables of places in the sorted keys."""
        self.cache_key, self.cache_ok = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.slot_a, self.slot_b = np.zeros(1 << SLOTS, np.int32), np.zeros(1 << SLOTS, np.int32)
        own = np.arange(len(self.keys), dtype=np.int32)
        a = self.keys >> np.uint64(64 - SLOTS)
        self.slot_a[a] = own
        lost = own[self.slot_a[a] != own]
        b = (self.keys[lost] >> np.uint64(64 - 2 * SLOTS)) & np.uint64((1 << SLOTS) - 1)
        self.slot_b[b] = lost
        self.crowded = bool((self.slot_b[b] != lost).any())

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether found) of hashes in the sorted keys."""
        if self.crowded:
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            return at, self.keys[at] == h
        at = self.slot_a[h >> np.uint64(64 - SLOTS)]
        hit = self.keys[at] == h
        miss = np.flatnonzero(~hit)
        other = self.slot_b[(h[miss] >> np.uint64(64 - 2 * SLOTS)) & np.uint64((1 << SLOTS) - 1)]
        found = self.keys[other] == h[miss]
        at[miss[found]] = other[found]
        hit[miss[found]] = True
        return at, hit

    @staticmethod
    def _key(piece: str) -> int:
        total = 0
        for k, c in enumerate(piece):
            total += (ord(c) + 1) * int(powers(BASE, 64)[k])
        return int(mix(np.array([total & (1 << 64) - 1], np.uint64))[0])

    def _split(self, piece: str) -> tuple | None:
        """The last merge that makes a piece; () for a character; None if merges end elsewhere."""
        if len(piece) == 1:
            return ()
        last: list[tuple] = []
        return last[-1] if self.merge(piece, last) == [piece] else None

    def merge(self, word: str, trace: list | None = None) -> list[str]:
        """Byte-pair merges of one word, best score first, then leftmost."""
        sym: list[str | None] = list(word)
        before, after = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if (t := self.id.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-self.scores[t], i, j, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue
            if trace is not None:
                trace.append((a, b))
            sym[i], sym[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(sym):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in sym if s is not None]

    def best(self, word: str) -> list[str]:
        """Sequential Viterbi over piece scores; an unknown character costs 10 below the least."""
        n = len(word)
        top, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for i in range(1, n + 1):
            for k in range(1, min(i, self.longest) + 1):
                t = self.id.get(word[i - k : i])
                s = top[i - k] + (self.scores[t] if t is not None else self.low - 10 if k == 1 else -np.inf)
                if s > top[i]:
                    top[i], back[i] = s, k
        out = []
        while n:
            out.append(word[n - back[n] : n])
            n -= back[n]
        return out[::-1]

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether byte-pair encoding leaves the boundary between pieces a and b alone."""
        v = len(self.pieces)
        key = a * v + b
        slot = (mix(key.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
        known = self.cache_key[slot] == key
        out = self.cache_ok[slot] & known
        miss = np.flatnonzero(~known)
        if len(miss):
            x, y = a[miss], b[miss]
            limit = np.full(len(miss), np.iinfo(np.int64).max)
            ok, live = np.ones(len(miss), bool), np.arange(len(miss))
            while len(live):
                p = x[live] * v + y[live]
                at = np.minimum(np.searchsorted(self.pair_keys, p), len(self.pair_keys) - 1)
                across = (self.pair_keys[at] == p) & (self.pair_rank[at] < limit[live])
                ok[live[across]] = False
                rx, ry = self.rank[x[live]], self.rank[y[live]]
                on = ~across & ((rx >= 0) | (ry >= 0))
                live, rx, ry = live[on], rx[on], ry[on]
                undo = rx > ry  # equal merges go from left to right, so the right one is undone first
                limit[live] = np.where(undo, rx, ry + 1)
                x[live] = np.where(undo, self.right[x[live]], x[live])
                y[live] = np.where(undo, y[live], self.left[y[live]])
            out[miss] = ok
            self.cache_key[slot[miss]], self.cache_ok[slot[miss]] = -1, False
            self.cache_key[slot[miss]] = key[miss]
            same = self.cache_key[slot[miss]] == key[miss]
            self.cache_ok[slot[miss][same]] = ok[same]
        return out

    def parts(self, codes: np.ndarray, core: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end) of the parts of words: long ones are cut where no piece has both characters side by side."""
        word, start, stop = [np.flatnonzero(end - core <= LONG)], [], []
        start.append(core[word[0]])
        stop.append(end[word[0]])
        for i in np.flatnonzero(end - core > LONG).tolist():
            c = codes[core[i] : end[i]].astype(np.uint64)
            pair = c[:-1] << np.uint64(32) | c[1:]
            at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
            cut = core[i] + 1 + np.flatnonzero(self.beside[at] != pair)
            start.append(np.concatenate(([core[i]], cut)))
            stop.append(np.concatenate((cut, [end[i]])))
            word.append(np.full(len(cut) + 1, i))
        return np.concatenate(word), np.concatenate(start), np.concatenate(stop)

    def lattice(self, codes: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, ends) of words of one length, or of ``sizes`` where they are filled up: by row, from the last token backwards; -2 fills up."""
        w, n = codes.shape
        sums = np.zeros((n + 1, w), np.uint64)
        np.cumsum((codes.T.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:, None], axis=0, dtype=np.uint64, out=sums[1:])
        last = np.full((n + 1, w), -1, np.int64)
        back = np.ones((n + 1, w), np.int64)
        total = np.zeros((n + 1, w))
        # the pieces of each length at all places, by one probe a length
        arcs, some = [], []
        for k in range(1, min(n, self.longest) + 1):
            at, hit = self.probe(mix((sums[k:] - sums[:-k]) * powers(INVERSE, n)[: n - k + 1, None]).ravel())
            arcs.append(np.where(hit, self.ids[at], -1).astype(np.int32).reshape(n - k + 1, w))
            some.append(hit.reshape(n - k + 1, w).any(axis=1))
        for i in range(1, n + 1):
            if self.kind == BPE:  # of the admissible arcs that end here the longest counts
                for k in range(1, min(i, self.longest) + 1):
                    if some[k - 1][i - k]:
                        token = arcs[k - 1][i - k]
                        own = np.flatnonzero(token >= 0)
                        before, token = last[i - k][own], token[own].astype(np.int64)
                        ok = before < 0
                        check = np.flatnonzero(~ok)
                        if len(check):
                            ok[check] = self.follows(before[check], token[check])
                        last[i, own[ok]], back[i, own[ok]] = token[ok], k
                continue
            best = np.full(w, -np.inf)
            for k in range(1, min(i, self.longest) + 1):
                token = arcs[k - 1][i - k]
                score = total[i - k] + np.where(token >= 0, self.scores[token], self.low - 10 if k == 1 else -np.inf)
                better = score > best
                best = np.where(better, score, best)
                last[i], back[i] = np.where(better, token, last[i]), np.where(better, k, back[i])
            total[i] = best
        tokens, ends = [], []
        at, row = np.full(w, n) if sizes is None else sizes.copy(), np.arange(w)
        while (at > 0).any():
            tokens.append(np.where(at > 0, last[at, row], -2))
            ends.append(at)
            at = np.maximum(0, at - back[at, row])
        return np.array(tokens).T, np.array(ends).T

    def run(self, n: int) -> list[int]:
        """Pieces of n word marks."""
        if n not in self.runs:
            text = chr(MARK) * n
            self.runs[n] = self.spelled(self.merge(text) if self.kind == BPE else self.best(text))
        return self.runs[n]

    def spelled(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            if (t := self.id.get(s)) is not None:
                out.append(t)
            elif self.byte:
                out += [self.byte[b] for b in s.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids)."""
        flat, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < CHUNK_CHARS):
                size += len(texts[hi])
                hi += 1
            ids, n = self._encode(texts[lo:hi])
            flat.append(ids)
            ends.append(n)
            lo = hi
        return np.concatenate(flat), np.cumsum(np.concatenate(ends))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        mark = chr(MARK)
        parts = [(mark * self.dummy + t.replace(" ", mark)) if t else "" for t in texts]
        joined = "".join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        first = np.cumsum([0] + [len(p) for p in parts])
        ws = codes == MARK
        begins = ws.copy()
        begins[1:] &= ~ws[:-1]
        begins[first[:-1][first[:-1] < len(codes)]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(codes))
        text_at = np.flatnonzero(~ws)
        nth = np.searchsorted(text_at, start)
        mark_end = np.minimum(np.append(text_at, len(codes))[nth], end)
        marks = mark_end - start
        if self.kind == UNIGRAM:
            marks = np.minimum(marks, 1)
        core = start + np.maximum(0, marks - 1)
        if self.kind == UNIGRAM:
            core = start
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(codes)), dtype=np.uint64)))
        h = mix((sums[end] - sums[core]) * powers(INVERSE, len(codes))[core] + np.uint64(0x51) * np.maximum(marks, 1).astype(np.uint64))
        distinct, pick, back = np.unique(h, return_index=True, return_inverse=True)
        known = _known.setdefault(self.name, Known())
        new = pick[~known.find(distinct)[1]]
        if len(known.h) + len(new) > KNOWN_WORDS:
            known.__init__()
            new = pick
        if len(new):
            known.add(h[new], *self._words(codes, joined, core[new], end[new], marks[new]))
        i, _ = known.find(distinct)
        at, length, token = known.at[i], known.n[i], known.tokens
        size = length[back]
        index = np.repeat(at[back] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ends = np.concatenate(([0], np.cumsum(size)))
        return token[index], np.diff(ends[np.searchsorted(start, first)])

    def _words(self, codes: np.ndarray, joined: str, core: np.ndarray, end: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, number of tokens, all tokens) of words."""
        n = end - core
        token_of, word_of, place_of = [], [], []
        of, start, stop = self.parts(codes, core, end)
        length = stop - start

        def advance(own: np.ndarray, size: int) -> None:
            """Parts ``own``, filled up to ``size`` characters."""
            step = max(1, min(20_000, 2_000_000 // size))
            for s in range(0, len(own), step):
                rows = own[s : s + step]
                inside = np.arange(size) < length[rows][:, None]
                tokens, ends = self.lattice(np.where(inside, codes[np.minimum(start[rows][:, None] + np.arange(size), len(codes) - 1)], 0), None if inside.all() else length[rows])
                r, c = np.nonzero(tokens > -2)
                t, e = tokens[r, c], ends[r, c] + start[rows[r]]
                lost = np.flatnonzero(t == -1)
                value = t.copy()
                value[lost] = -2 - codes[e[lost] - 1].astype(np.int64)
                token_of.append(value)
                word_of.append(of[rows[r]])
                place_of.append(e)

        for size in np.unique(length[length <= LONG]).tolist():
            advance(np.flatnonzero(length == size), size)
        wide = np.flatnonzero((length > LONG) & (length <= LONGEST))
        for power in np.unique(np.ceil(np.log2(length[wide]))).tolist():
            own = wide[np.ceil(np.log2(length[wide])) == power]
            advance(own, int(length[own].max()))
        for x in np.flatnonzero(length > LONGEST).tolist():
            part = joined[start[x] : stop[x]]
            ids = np.array(self.spelled(self.merge(part) if self.kind == BPE else self.best(part)), np.int64)
            token_of.append(ids)
            word_of.append(np.full(len(ids), of[x]))
            place_of.append(np.full(len(ids), start[x]))  # sorted as they are, at their part's place
        token = np.concatenate(token_of) if token_of else np.zeros(0, np.int64)
        word = np.concatenate(word_of) if word_of else np.zeros(0, np.int64)
        order = np.lexsort((np.concatenate(place_of) if place_of else word, word))
        token, word = token[order], word[order]
        lost = token < -1
        if lost.any():  # characters without a piece become bytes
            points, at = np.unique(-2 - token[lost], return_inverse=True)
            spelled = [self.spelled([chr(p)]) for p in points]
            size = np.ones(len(token), np.int64)
            size[lost] = np.array([len(s) for s in spelled])[at]
            shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wide = np.zeros((len(points), 4), np.int64)
            for k, s in enumerate(spelled):
                wide[k, : len(s)] = s
            index = np.zeros(len(token), np.int64)
            index[lost] = at
            token = np.where(np.repeat(lost, size), wide[np.repeat(index, size), shift], np.repeat(token, size))
            word = np.repeat(word, size)
        at = np.searchsorted(word, np.arange(len(n) + 1))
        length = np.diff(at)
        extra, where = [token], len(token)
        at = at[:-1].copy()
        for i in np.flatnonzero(marks > 1).tolist():
            ids = token[at[i] : at[i] + length[i]].tolist()
            alone = ids and ids[0] == self.id.get(chr(MARK))
            ids = self.run(int(marks[i]) - (not alone)) + list(ids[1:] if alone else ids)
            at[i], length[i] = where, len(ids)
            extra.append(np.array(ids, np.int64))
            where += len(ids)
        return at, length, np.concatenate(extra)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each text."""
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        index = np.repeat(self.raw_at[ids] - ends[:-1], size) + np.arange(ends[-1])
        data = self.raw[index].tobytes()
        cut = ends[bounds]
        out = [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return [t[1:] if self.dummy and t[:1] == b" " else t for t in out]


def load(spark: SparkSession, path: str) -> Model:
    """A model file, by any path that Spark reads or a local one."""
    if "://" in path and not path.startswith("file:"):
        return Model(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    with open(path.removeprefix("file://"), "rb") as f:
        return Model(f.read())


def encode_column(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, round_trip) of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(b["_text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
            for lo, hi in pieces(ends, BATCH_BYTES):
                part = b.slice(lo, hi - lo)
                texts = part["_text"].to_pylist()
                ids, bounds = model.encode([(t or b"").decode("utf-8", "replace") for t in texts])
                back = model.decode(ids, bounds)
                null = np.array([t is None for t in texts])
                same = [None if t is None else t == r for t, r in zip(texts, back, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null)) if len(texts) else pa.array([], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part["_id"], pa.array(np.diff(bounds), pa.int64(), mask=null), lists, pa.array(same, pa.bool_())], names=["_id", "n_tokens", "ids", "round_trip"])

    out = rows.mapInArrow(run, f"_id {kind}, n_tokens long, ids array<int>, round_trip boolean")
    return out.withColumnRenamed("_id", id_col)


def decode_column(df: DataFrame, model: Model, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; invalid UTF-8 is replaced."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [None if x is None else np.array([i for i in x if i is not None], np.int64) for x in b["_ids"].to_pylist()]
            bounds = np.cumsum([0] + [0 if x is None else len(x) for x in lists])
            flat = np.concatenate([np.zeros(0, np.int64), *[x for x in lists if x is not None]])
            if len(flat) and (flat.min() < 0 or flat.max() >= len(model.pieces)):
                raise ValueError("an id is not in the model")
            texts = [None if x is None else t.decode("utf-8", "replace") for x, t in zip(lists, model.decode(flat, bounds), strict=True)]
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array(texts, pa.string())], names=["_id", "text"])

    return rows.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)
