import re

import pytest

from cladeflow.llm import license_rules, license_scan

RULES = license_rules.rules()
TEXTS = [None, "", " \n", "MIT License", "cc-by CC BY cc by-nc 4.0", "İ K MIT LICENSE", "x\x00GNU General   Public\nLicense, version 3.0 or later", "Licensed under the Apache License, Version 2.0. All rights reserved", "mit license " * 500, "no licence here", "apache apache license"]


def brute(text):
    words = re.findall(license_scan.WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    base = [(i, n) for i in range(len(words)) for p, n in license_scan.BASE if words[i : i + len(p.split())] == p.split()]
    found = []
    for i, w in enumerate(words):
        window = " ".join(words[i : i + license_rules.MAX_WORDS])
        for number, label, priority, first, _, pattern in RULES:
            if w == first and (m := re.match(f"(?:{pattern})(?= |$)", window)):
                found.append((i, i + len(m[0].split()), priority, number, label))
    stands = [x for x in found if not any(o[0] <= x[0] and o[1] >= x[1] and (o[2] > x[2] or o[2] == x[2] and (o[1] - o[0] > x[1] - x[0] or o[1] - o[0] == x[1] - x[0] and o[3] < x[3])) for o in found)]
    labels = sorted({n for _, n in base})
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(labels), ",".join(sorted({*labels, *(x[4] for x in stands)})), pytest.approx(max([0.5 * bool(base)] + [x[2] / 10 for x in stands])))


def test_rules():
    assert len(RULES) > 200
    for _, _, priority, first, keyword, pattern in RULES:
        re.compile(pattern)
        assert priority in (3, 5, 7, 9) and pattern.startswith(first) and keyword in pattern


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(3, "MIT License", 7)], "doc_id long, text string, n_words long")
    got = license_scan.scan_digest(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert tuple(r)[1:8] == brute(TEXTS[r["doc_id"]])


def test_empty_table(spark):
    assert license_scan.scan_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
