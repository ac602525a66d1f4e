import hashlib
import random
import zlib
from collections import defaultdict

from cladeflow.llm import prefix_trie
from cladeflow.llm.queries import oracle_sql

SCHEMA = "conv_id long, turn long, role string, text string, digest string, node int"


def brute(rows, rebuild):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            whole = f"{len(r.encode())}:{r}{x}".encode()
            own[c].append((t is not None, t or 0, r, hashlib.sha256(whole).digest(), x))
    convs = {}
    for c in own:
        turns = [(r, x) for *_, r, _, x in sorted(own[c])]
        if rebuild:
            h = zlib.crc32(str(c).encode()) % 9
            base = c - (c % 5 if c >= 0 else -(-c % 5))
            head = [(r, x) for *_, r, _, x in sorted(own.get(base, []))][:h]
            turns = head + turns[h:]
        convs[c] = tuple(turns)
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []

    def walk(p):
        n, below = len(members[p]), [walk(k) for k in kids[p]]
        leaves = sum(b[0] for b in below) or 1
        saved = sum(b[1] for b in below) + (n - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, n, len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return sorted(map(repr, out))


def talks(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 90), n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 12])):
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, 1]), rng.choice(["user", "bot", None]), rng.choice(["a", "é", "", None, "b c"]), "x", 1))
    return rows + rows[:5] + [(None, 1, "user", "lost", "x", 1), (200, 0, "user", "w" * 200_000, "x", 1)]


def check(spark, rows, rebuild):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = prefix_trie.conversation_trie(docs, rebuild=rebuild)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, rebuild)


def test_against_brute_force(spark):
    for seed in (1, 2):
        check(spark, talks(seed), True)
    check(spark, talks(3), False)


def test_deep_paths_and_many_copies(spark):
    deep = [(c, t, "user", f"{t}" if t < 150 else f"{t} {c}", "", 0) for c in (0, 1, 7) for t in range(400)]
    copies = [(c, t, "user", f"same {t}", "", 0) for c in range(100, 160) for t in range(3)]
    check(spark, deep + copies, True)
    prefix_trie.CHUNK, old = 20, prefix_trie.CHUNK
    try:
        check(spark, copies, False)
    finally:
        prefix_trie.CHUNK = old


def test_empty_and_turnless(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA), rebuild=True).count() == 0
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    check(spark, [(c, 0, "user", "gone", "", 0)], True)  # rebuilt without a turn: the root's one member


def test_sql_orders_nulls_first():
    assert "nulls first" in oracle_sql()["op11_prefix_trie"]
