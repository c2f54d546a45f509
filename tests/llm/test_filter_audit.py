"""The filter audit against plain simulation of every order, and its defined results."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from quillgraph.llm import audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def failed(text, ident, least):
    words = SPACE.findall(text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return out + ("E" if ident is not None and least[text] is not None and ident > least[text] else "")


def brute(docs, labels):
    """Applies the filters one after another, document by document."""
    least = {}
    for ident, text, _ in docs:
        text = text or ""
        known = least.get(text)
        least[text] = ident if known is None else known if ident is None else min(known, ident)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    parts = defaultdict(list)
    for ident, text, source in docs:
        parts[source or ""].append((failed(text or "", ident, least), ident in good, ident in toxic))
    out = []
    for part, found in parts.items():
        total = Counter()
        rows = []
        for order in permutations("ABCDE"):
            left = found
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                rows.append((f, [part, "".join(order), step, len(left), len(gone), sum(f in d[0] for d in found) - len(gone), sum(d[0] == f for d in found), sum(d[1] for d in gone), sum(d[2] for d in gone)]))
        out += [(*row, total[f]) for f, row in rows]
    return sorted(out)


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"n": F.lit("x"), "mask": F.lit(1), "h": F.lit(0), "good": F.lit(True)})
    la = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit("clash"))
    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return sorted(tuple(r) for r in audit.audit(d, la, audit.failures(F.col("text")), "E", marks).select(*COLUMNS).collect())


def test_every_order_equals_a_simulation(spark):
    rng = random.Random(5)
    texts = ["", None, "one", "Ab C", " ".join(f"w{i}" for i in range(250)), "same " * 300, "a # b", "A" * 50 + " x", "  été", " ".join(f"W{i}" for i in range(240)) + " |", "long " * 20_000]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "s1", "s2", "only"])) for _ in range(300)]
    docs += [(7, "one", "s1")] * 40 + [(None, "one", "s1")] * 40  # repeated rows, also without ids
    labels = [(rng.choice([None, *range(80)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(90)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", "s")], []) == brute([(1, "a", "s")], [])


def test_other_numbers_of_filters(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 7), "s") for i in range(50)], "doc_id long, text string, source string")
    got = audit.audit(docs, spark.createDataFrame([], "doc_id long"), {"P": F.length("text") > 3}, "Q").select("filter_order", "step", "kept", "removed", "shapley").collect()
    by = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in got}
    assert by == {("PQ", 1): (29, 21, 24), ("PQ", 2): (4, 25, 68), ("QP", 1): (7, 43, 68), ("QP", 2): (4, 3, 24)}
