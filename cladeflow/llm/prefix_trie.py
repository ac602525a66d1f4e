"""Prefix trie of conversations by chained cryptographic digests.

Every turn has a SHA-256 digest of its role and text; the digest of a conversation's first
d turns is the SHA-256 of that of its first d - 1 turns followed by the d-th turn's. A
conversation is exploded to all its prefixes, and prefixes grouped by (depth, digest) are
the nodes. A node is named by its smallest member and its depth, and sums over subtrees come
from sending each node to all its ancestors. The nodes that one conversation names form the
lower end of its path, so what they send to a common ancestor is summed before it is sent:
work and rows grow with the prefixes and not with their square, however long the path.

Only digests and lengths are shuffled, never texts. A path is chained by a stream over
sorted rows that holds one digest; a hot node (the root has every conversation) is counted
with map-side combining and joined to its prefixes by a sort-merge join, whose large
partitions Spark splits; the list of the conversations that end at a node is joined to
chunks in ranges of (node, conversation), which are hashed one after the other.

Defined results: rows without a conversation's id belong to none and are left out; a null
role or text is empty; turns are ordered by turn, null first, then by role and digest;
repeated rows are repeated turns; a conversation may have turns of any number and length; a
table without conversations has no nodes, not even a root. Columns other than those named
play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions.staging import stage

ROOT = hashlib.sha256(b"").digest()
CHUNK = 1 << 16  # characters of a list of ids that a row holds
STEP, HEADS = 5, 9  # a conversation begins with crc32 modulo HEADS turns of the multiple of STEP before it


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, digest, bytes): a row a turn, without its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(whole, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.where("conv_id is not null")


def rebuilt(rows: DataFrame, step: int = STEP, heads: int = HEADS) -> DataFrame:
    """Turns of conversations that take the place of their own first turns by another one's.

    ``part`` is 0 for the first h turns of conversation c - c % step, where h is crc32 of the
    decimal c, modulo ``heads``; of c's own turns (``part`` 1) the first h are skipped later.
    Only heads, at most ``heads`` - 1 rows a conversation, are sent to others.
    """
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % heads
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    first = rows.where(F.col("conv_id") % step == 0).withColumn("place", F.row_number().over(order)).where(F.col("place") < heads)
    near = F.explode(F.transform(F.sequence(F.lit(1 - step), F.lit(step - 1)), lambda k: F.try_add("conv_id", k.cast("long"))))
    first = first.withColumn("member", near).where((F.col("member") - F.col("member") % step == F.col("conv_id")) & (F.col("place") <= h("member")))
    shared = first.select(F.col("member").alias("conv_id"), F.lit(0).alias("part"), "turn", "role", "digest", "bytes", F.lit(0).cast("long").alias("skip"))
    return shared.unionByName(rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "bytes", h("conv_id").cast("long").alias("skip")))


def as_they_are(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"part": F.lit(1), "skip": F.lit(0).cast("long")})


PREFIXES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("bytes", pa.int64()), ("ends", pa.int64())])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of conversations whose turns come in order; a path's state is one digest."""
    conv, own, skipped, held, depth, digest, last = None, False, 0, [], 0, ROOT, None
    out: list[tuple] = []

    def add(turn: bytes, size: int) -> None:
        nonlocal depth, digest, last
        digest = hashlib.sha256(digest + turn).digest()
        depth += 1
        out.append(last)
        last = (conv, depth, digest, size, 0)

    for b in batches:
        for c, part, turn, size, skip in zip(*(b[k].to_pylist() for k in ("conv_id", "part", "digest", "bytes", "skip")), strict=True):
            if c != conv:
                if last:
                    out.append((*last[:4], 1))
                conv, own, skipped, held, depth, digest, last = c, False, 0, [], 0, ROOT, None
            if part == 0:  # heads come first; they count if the conversation is there
                held.append((turn, size))
                continue
            if not own:
                own, last = True, (conv, 0, ROOT, 0, 0)
                for x in held:
                    add(*x)
            if skipped < skip:
                skipped += 1
            else:
                add(turn, size)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), PREFIXES.types, strict=True)], schema=PREFIXES)
            out.clear()
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*last[:4], 1), PREFIXES.types, strict=True)], schema=PREFIXES)


def prefixes(parts: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, bytes, ends) of every prefix of every conversation, depth 0 included."""
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")
    return rows.select("conv_id", "part", "digest", "bytes", "skip").mapInArrow(_chained, "conv_id long, depth long, digest binary, bytes long, ends long")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, depth, conv_id) as chunks of comma-joined ids, with their first id."""
    key, first, ids, size = None, None, [], 0
    out: list[tuple] = []
    schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    for b in batches:
        for n, d, c in zip(*(b[k].to_pylist() for k in ("node", "depth", "conv_id")), strict=True):
            if (n, d) != key or size > CHUNK:
                if ids:
                    out.append((*key, first, ",".join(ids)))
                key, first, ids, size = (n, d), c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out.clear()
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, first, ",".join(ids)), schema.types, strict=True)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's chunks, which come in order."""
    key, state = None, None
    out: list[tuple] = []
    schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    for b in batches:
        for n, d, ids in zip(*(b[k].to_pylist() for k in ("node", "depth", "ids")), strict=True):
            if (n, d) != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (n, d), hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out.clear()
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, state.hexdigest()), schema.types, strict=True)], schema=schema)


def trie(found: DataFrame) -> DataFrame:
    """The nodes of ``prefixes``.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256): smallest member, depth, the parent's smallest member, members, children,
    childless nodes of the subtree, the subtree's sum of (members - 1) times the bytes of the
    last text, and the SHA-256 of the ids of the conversations that end here.
    """
    found = stage(found, "prefixes")
    nodes = stage(found.groupBy("depth", "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.sum("ends").alias("n_ends")), "nodes")
    paths = stage(found.join(nodes.hint("merge"), ["depth", "digest"]).select("conv_id", "depth", "node", "n", "n_ends", "bytes", "ends"), "paths")

    # each path from its lower end up: what the nodes that it names send to the row's node
    own = F.col("node") == F.col("conv_id")
    path = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    upwards = path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sent = paths.select(
        "node", "depth", "n", own.alias("own"),
        F.first(own).over(upwards).alias("names"),
        F.sum(F.when(own, (F.col("n") - 1) * F.col("bytes")).otherwise(0)).over(upwards).alias("saved"),
        F.sum(F.when(own & (F.col("n") == F.col("n_ends")), 1).otherwise(0)).over(upwards).alias("leaves"),
        F.coalesce(F.lag(own.cast("long")).over(path), F.lit(0)).alias("child"),
        F.lead("node").over(path).alias("parent"),
    ).where("names")
    totals = sent.groupBy("node", "depth").agg(F.max(F.when(F.col("own"), F.col("parent"))).alias("parent"), F.max("n").alias("n"), F.sum("child").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    ends = paths.where("ends = 1").select("node", "depth", "conv_id")
    chunks = ends.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id").mapInArrow(_listed, "node long, depth long, first long, ids string")
    hashes = chunks.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(_hashed, "node long, depth long, ends_sha256 string")
    out = totals.join(hashes, ["node", "depth"], "left")
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, rebuild: bool = False, **columns: str) -> DataFrame:
    """The trie of a table of turns, as they are or rebuilt; ``columns`` name its columns as in ``turns``."""
    rows = turns(conversations, **columns)
    return trie(prefixes(rebuilt(rows) if rebuild else as_they_are(rows)))
