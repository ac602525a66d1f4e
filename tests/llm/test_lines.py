import random
import re
from collections import defaultdict

import pytest

from cladeflow.llm import line_dedup


def brute(rows, least):
    docs = []
    for d, t in sorted(rows):
        lines = [(i, x.strip(line_dedup.TRIMMED)) for i, x in enumerate(t.split("\n"))]
        docs.append((d, t, [(i, x, len(re.findall(line_dedup.WORD, x))) for i, x in lines if x]))
    where = defaultdict(list)
    for a, (_, _, q) in enumerate(docs):
        for j, (_, x, _) in enumerate(q):
            where[x].append((a, j))
    out = {}
    for a, (d, t, q) in enumerate(docs):
        cut = set()
        for j in range(len(q)):
            best = 0
            for b, k in where[q[j][1]]:
                if (b, k) >= (a, j):
                    break
                n, other = 0, docs[b][2]
                while j + n < len(q) and k + n < len(other) and q[j + n][1] == other[k + n][1]:
                    n += 1
                best = max(best, n)
            if best and sum(x[2] for x in q[j : j + best]) >= least:
                cut |= set(range(q[j][0], q[j + best - 1][0] + 1))
        out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut)
    return out


@pytest.mark.parametrize("least", [1, 3, 8])
def test_against_brute_force(spark, least):
    rng = random.Random(least)
    rows = [(d, "\n".join(" ".join(rng.choices("abc", k=rng.choice([0, 1, 1, 2]))) for _ in range(rng.randrange(14)))) for d in range(50)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, h string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_words=least).collect()}
    solid = lambda t: {d: [x for x in v.split("\n") if x.strip()] for d, v in t.items()}
    assert solid(got) == solid(brute(rows, least))


def test_long_runs_are_one_interval(spark):
    shared = [f"line {k} of a passage that two documents share" for k in range(140)]
    hot = "the same short line"
    rows = [(1, "\n".join(shared)), (2, "\n".join(["before", *shared[:100], "after", hot])), (3, "\n".join([hot, *shared[20:140], "x"]))]
    rows += [(10 + k, "\n".join([f"own {k}", hot, f"own too {k}", hot])) for k in range(200)] + [(500, "w " * 30_000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, d long, runs long")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    runs = {i: [tuple(x) for x in r.deleted_runs] for i, r in got.items() if r.deleted_runs}
    assert runs == {2: [(1, 100)], 3: [(1, 120)]} and got[3].text == hot + "\nx" and got[500].text == "w " * 30_000
    assert all((r.d, r.runs) == (1, 2) for r in got.values())


def test_edge_cases(spark):
    passage = "\n".join(f"{k} one two three four five six seven eight nine ten" for k in range(6))
    rows = [(1, passage), (2, "own\n" + passage + "\r\nmore"), (2, "own\n" + passage + "\r\nmore"), (3, None), (4, ""), (None, passage), (5, "own")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(1, passage), (2, "own\nmore"), (2, "own\nmore"), (3, None), (4, ""), (0, passage), (5, "own")], key=repr)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_runs_in_one_text(spark):
    """Deleting takes time in proportion to the lines, and not to lines times runs."""
    passage = [[f"{k} passage {j} of several words that come again" for j in range(2)] for k in range(3000)]
    first = "\n".join(x for p in passage for x in [*p, f"own {p[0]}"])
    later = "\n".join(x for k, p in enumerate(passage) for x in [f"new {k}", *p])
    docs = spark.createDataFrame([(1, first), (2, later)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, min_words=10).collect()}
    assert got[1].text == first and got[2].text == "\n".join(f"new {k}" for k in range(3000)) and len(got[2].deleted_runs) == 3000
