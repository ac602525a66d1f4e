"""Licence scan by ordered signature rules, in DataFrame operations only.

Texts without any rule's keyword are dismissed after one pass over their words. In the
others, every word that begins some rule is an anchor; the rules of that word are tried,
anchored, on the next ``MAX_WORDS`` words. A detection is suppressed when its words lie
inside those of a detection of higher priority, or of equal priority and more words, or
are the same words under an earlier rule of equal priority. No detection is longer than
``MAX_WORDS`` words, so only anchors at most that far back are compared, and the work
stays linear in the text. The scan is one projection: nothing is shuffled.

Beside the rules, four base phrases are found at all places where their words stand
consecutively; their labels are never suppressed.

Defined results: a null text counts as empty; without places first and last word are
null, labels are empty strings and the score is 0. Rows stay as they are, repeated or not.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.license_rules import MAX_WORDS, rules

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
BASE_SCORE = 0.5


def words_of(text: Column) -> Column:
    """The words of a text, with A-Z in lower case and nothing else changed."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _part(a: Column, first: Column, last: Column) -> Column:
    """Entries first .. last; slice() would copy the whole array inside a lambda."""
    return F.transform(F.sequence(first, last), lambda j: F.get(a, j))


def _strings(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def _rule_map() -> Column:
    """Rules by first word, as a constant map."""
    by: dict[str, list[dict]] = {}
    for number, label, priority, first, _, pattern in rules():
        by.setdefault(first, []).append({"rule": number, "label": label, "priority": priority, "re": f"^(?:{pattern})(?= |$)"})
    return F.from_json(F.lit(json.dumps(by)), "map<string,array<struct<rule:int,label:string,priority:int,re:string>>>")


def _detections(w: Column) -> Column:
    """For each anchor with matches, its place and the matching rules with their lengths."""
    firsts = _strings(sorted({r[3] for r in rules()}))
    by = _rule_map()
    anchors = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("word"))), lambda a: F.array_contains(firsts, a["word"]))

    def tried(a: Column) -> Column:
        window = F.array_join(_part(w, a["at"], F.least(a["at"] + MAX_WORDS, F.size(w)) - 1), " ")
        hits = F.transform(F.element_at(by, a["word"]), lambda r: F.struct(F.call_function("regexp_extract", window, r["re"], F.lit(0)).alias("m"), r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority")))
        found = F.filter(hits, lambda h: h["m"] != "")
        return F.struct(a["at"].alias("at"), F.transform(found, lambda h: F.struct(a["at"].alias("start"), F.size(F.split(h["m"], " ")).alias("n"), h["rule"].alias("rule"), h["label"].alias("label"), h["priority"].alias("priority"))).alias("found"))

    return F.filter(F.transform(anchors, tried), lambda d: F.size(d["found"]) > 0)


def _survivors(d: Column) -> Column:
    """Detections that no other one suppresses, in order of place and rule."""

    def beats(o: Column, x: Column) -> Column:
        inside = (o["start"] <= x["start"]) & (o["start"] + o["n"] >= x["start"] + x["n"])
        same = o["priority"] == x["priority"]
        longer = (o["n"] > x["n"]) | ((o["n"] == x["n"]) & (o["rule"] < x["rule"]))
        return inside & ((o["priority"] > x["priority"]) | (same & longer))

    def kept(a: Column, k: Column) -> Column:
        near = F.flatten(F.transform(_part(d, F.greatest(k + 1 - MAX_WORDS, F.lit(0)), k), lambda b: b["found"]))
        return F.filter(a["found"], lambda x: ~F.exists(near, lambda o: beats(o, x)))

    return F.flatten(F.transform(d, kept))


def _places(w: Column) -> Column:
    """(start, label) of every place of a base phrase, in order of place."""
    at = F.transform(w, lambda x, i: F.struct(i.alias("start"), x.alias("word")))
    heads = F.filter(at, lambda x: F.array_contains(_strings([p.split()[0] for p, _ in BASE]), x["word"]))

    def label(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, name in BASE:
            own = reduce(Column.__and__, [F.get(w, x["start"] + k) == p for k, p in enumerate(phrase.split())])
            out = F.when(own, F.lit(name)).otherwise(out)
        return out

    return F.filter(F.transform(heads, lambda x: F.struct(x["start"].alias("start"), label(x).alias("label"))), lambda x: x["label"].isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, places, detections) of every row.

    ``places``: (start, label) of base phrases; ``detections``: (start, n, rule, label,
    priority) of the rules' detections that stand.
    """
    keywords = _strings(sorted({r[4] for r in rules()} | {"license", "cc"}))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    # lower() also changes letters beyond ASCII, but neither the number of words nor any ASCII word
    rough = rows.withColumn("_r", F.regexp_extract_all(F.lower("_t"), F.lit(WORD), F.lit(0)))
    gated = rough.select(id_col, "_t", F.size("_r").cast("long").alias("n_words"), F.arrays_overlap("_r", keywords).alias("_g"))
    exact = gated.withColumn("_w", F.when(F.col("_g"), words_of(F.col("_t"))))
    w = F.col("_w")
    found = exact.select(id_col, "n_words", F.when(F.col("_g"), _places(w)).alias("_p"), F.when(F.col("_g"), _detections(w)).alias("_d"))
    none = "array<struct<start:int,label:string>>", "array<struct<start:int,n:int,rule:int,label:string,priority:int>>"
    return found.select(id_col, "n_words", F.coalesce("_p", F.array().cast(none[0])).alias("places"), F.coalesce(F.when(F.size("_d") > 0, _survivors(F.col("_d"))), F.array().cast(none[1])).alias("detections"))


def scan_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: words, base places, labels and a score.

    The score is a tenth of the highest priority that stands, and at least ``BASE_SCORE``
    with a base phrase.
    """
    s = scan(docs, id_col, text_col)
    base, more = F.transform("places", lambda p: p["label"]), F.transform("detections", lambda d: d["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    top = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])) / 10.0, F.lit(0.0))
    return s.select(
        F.col(id_col).alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0))["start"].cast("long").alias("first_word"),
        F.get("places", F.size("places") - 1)["start"].cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.greatest(top, F.when(F.size("places") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
