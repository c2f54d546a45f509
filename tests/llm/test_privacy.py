"""PII spans against the plain patterns and a plain count of co-occurrences, and the defined results of odd rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from quillgraph.llm import privacy

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
ORDER = {k: i for i, k in enumerate(["email", "ip", "card", "phone", "generalised", "removed"])}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 if d > 4 else 2 * d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN:
        for m in regex.finditer(pattern, text):
            digits = regex.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            value = m.group().lower() if kind == "email" else m.group() if kind == "ip" else digits
            out.append((m.start(), kind, m.end(), (kind, value)))
    return out


def brute(texts, window, support, generalise_at, remove_at):
    texts = [t or "" for t in texts]
    found, n_t, n_e, n_et, seen = {}, Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        if t not in found:
            base = base_spans(t)
            terms = [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"\p{L}[\p{L}\p{M}\p{N}]{2,}", t)]
            free = [x for x in terms if not any(s < x[1] and x[0] < e for s, _, e, _ in base)]
            near = set()
            for s, _, _, who in base:
                at = sum(x[0] < s for x in free)
                near |= {(who, w) for _, _, w in free[max(0, at - window) : at + window]}
            found[t] = base, free, near, {w for _, _, w in terms}
        base, free, near, words = found[t]
        n_t.update(words)
        n_e.update({who for *_, who in base})
        n_et.update(near)
        for pair in near:
            seen[pair].add(t)
    told = {}
    for (who, w), n in n_et.items():
        if len(seen[who, w]) >= support and n_e[who] < len(texts):
            d = round(math.log(n * len(texts) / (n_e[who] * n_t[w])) / math.log(len(texts) / n_e[who]), 9)
            if d >= generalise_at:
                told[who, w] = "removed" if d >= remove_at else "generalised"
    out = []
    for t in texts:
        base, free, _, _ = found[t]
        mine = {who for *_, who in base}
        more = [(s, k, e) for s, e, w in free for k in sorted({told[who, w] for who in mine if (who, w) in told}, key=ORDER.get)[-1:]]
        text = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], ORDER[x[1]], x[2])))
        plain = [x[:3] for x in base]
        counts = [sum(k == kind for _, k, _ in plain) for kind, _ in PLAIN]
        out.append((*counts, hashlib.sha256(text(plain).encode()).hexdigest(), text(plain + more)))
    return out


def run(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"h": F.lit(1), "row": F.lit("x"), "n": F.lit(2)}).repartition(3)
    got = privacy.digest(privacy.find(docs, ["doc_id"], **options)).orderBy("row.doc_id").collect()
    return [(r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got]


def near_people(rng, n):
    """Texts about people with an address each, whose nicknames stand near it."""
    common = [f"wort{i}" for i in range(60)] + ["été", "日本語文", "The", "naïve"]
    out = []
    for i in range(n):
        words = rng.choices(common, k=rng.randint(3, 60))
        if i % 3 == 0:
            p = rng.randint(0, 8)
            at = rng.randint(0, len(words))
            words[at:at] = [f"Nick{p}", rng.choice([f"person{p}@mail.example.com", f"Person{p}@mail.example.com.", f"+1 (20{p}) 555-0{p}99", f"10.0.{p}.7"]), f"alias{p}"]
        if i % 7 == 0:
            words.append(f"Nick{rng.randint(0, 8)}")
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("window, support", [(10, 2), (2, 3)])
def test_spans_equal_brute_force(spark, window, support):
    rng = random.Random(3)
    texts = near_people(rng, 300)
    texts += [texts[0]] * 50 + [None, "", "  ", "no data at all", "é" * 50 + "x.y@z.de" + "ö" * 3]
    texts += ["Nick1 " * 3000 + "person1@mail.example.com"]
    got = run(spark, texts, window=window, support=support)
    assert got == brute(texts, window, support, privacy.GENERALISE_AT, privacy.REMOVE_AT)
    kinds = Counter(s.split(":")[0] for *_, spans in got for s in spans.split(",") if s)
    assert kinds["removed"] and kinds["email"] and kinds["phone"] and kinds["ip"]


def test_patterns_equal_the_plain_ones_on_hostile_texts(spark):
    rng = random.Random(4)
    parts = ["a", "B_", "@", "@@", ".", "..", "1", "22", "255", "256", "00", "-", " ", "+", "+1", "(", ")", "é", "\n", "4539578763621486", "4539 5787 6362 1486", "a@b.c", "c_d@e.f", "1.2.3.4", "%", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "a@b.c@d.e", "x@y", "@y.z", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "0001.2.3.255", "1.2.3.999 9.9.9.9", "4111-1111-1111-1111", "4111 1111 1111 1112", "+49 (30) 1234-567 8"]
    got = run(spark, texts, support=99)
    expected = brute(texts, 10, 99, 2, 2)
    assert got == expected and sum(x[0] > 0 for x in got) > 100 and sum(x[1] > 0 for x in got) > 50


def test_very_long_runs_end(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "a@" + "b." * 100_000, "+1" + " " * 200_000, "1.2.3" * 60_000, "x@y.z " * 20_000, "x" * 200_000 + "@y.z"]
    got = run(spark, texts)
    assert [x[0] for x in got] == [0, 0, 0, 1, 0, 0, 20_000, 1] and got[6][5].endswith("email:119994:119999")


def test_copies_are_no_evidence(spark):
    texts = ["hush zebra person@mail.example.com quagga"] * 30 + ["other words entirely"] * 30
    assert all("removed" not in x[5] for x in run(spark, texts))
    twice = [*texts, "elsewhere zebra person@mail.example.com"]
    assert "removed:5:10" in run(spark, twice)[0][5]


def test_sanitised_texts(spark):
    texts = ["Call Zebra at zebra@mail.example.com now", "ask Zebra via zebra@mail.example.com soon", "no data", None, "", "card 4111 1111 1111 1111 end", "é😀 1.2.3.4 é"] + [f"filler {i}" for i in range(30)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string")
    got = {r.doc_id: r.text for r in privacy.sanitised(docs).select("doc_id", "text", "h").collect()}
    assert [got[i] for i in range(7)] == ["Call  at [email] now", "ask  via [email] soon", "no data", None, "", "card [card] end", "é😀 [ip] é"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert privacy.digest(privacy.find(docs, ["doc_id"])).collect() == []
    assert privacy.sanitised(docs).collect() == []
