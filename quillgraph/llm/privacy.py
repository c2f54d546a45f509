"""PII by patterns and by information-theoretic sanitisation. Everything is DataFrame code.

Patterns find the protected entities: addresses, numbers and cards. What they leave can still reveal them: a term that is met near an entity far more often
than chance would have it tells a reader which entity stood there. For entity e and term t, with counts of documents over the whole table,

    disclosure(e, t) = log(n_et * N / (n_e * n_t)) / log(N / n_e)

is the pointwise mutual information as a share of the information that e itself has: 0 for chance, 1 for a term that is found nowhere but near e. ``n_et``
counts documents with t within ``WINDOW`` terms of e, ``n_e`` and ``n_t`` documents with e and with t. In a document that holds e, a term whose disclosure
reaches ``GENERALISE_AT`` is generalised (to its class: code, name or word), and from ``REMOVE_AT`` on it is removed, wherever in the document it
stands. Evidence takes ``SUPPORT`` different texts: copies of one text are no evidence that a term belongs to an entity, though they count as documents.

Only documents with an entity are split to terms with positions; the terms of all documents are counted. Equal texts are worked on once (by SHA-256, with their
number, counted before the shuffle), so copies make no hot key; what is left of them is one narrow row each, joined from written
tables, which adaptive execution may split. A pair of entity and term comes from a window, so their number is linear in the entities' occurrences.

Defined results: a null text is empty and has no spans; positions are code points, ends exclusive; spans of one kind never overlap, those of
different kinds may; terms that touch a span of a pattern are not terms; an entity that every document holds is no secret and nothing discloses it;
rows with null or repeated ids are documents of their own; the empty table gives an empty table; further columns are passed on by ``sanitised`` and ignored else.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table, written

#: Terms on either side of an entity that count as near it; different texts that make evidence; the two thresholds of disclosure.
WINDOW, SUPPORT, GENERALISE_AT, REMOVE_AT = 10, 2, 0.75, 0.9
#: Kinds in the order in which spans with one start are listed.
EMAIL, IP, CARD, PHONE, GENERALISED, REMOVED = range(6)
KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
PLACEHOLDERS = ("[email]", "[ip]", "[card]", "[phone]")

# Each finds what the plain pattern in the comment finds. A match begins where its run of characters does, or after the match before, and runs are
# taken whole, so that time is linear in the text and nested repetition needs no stack.
PATTERNS = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    IP: r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    CARD: r"[0-9](?:[\x20-]?[0-9])++",  # [0-9]([\x20-]?[0-9])+
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text has if a pattern finds something that may pass.
HINTS = {**PATTERNS, CARD: r"[0-9](?:[\x20-]?[0-9]){13}"}
TERM = r"\p{L}[\p{L}\p{M}\p{N}]{2,}+"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def passes_luhn(digits: Column) -> Column:
    """Of a string of digits, from the last: every second one doubled, and 9 less where that is more than 9."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    values = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10 == 0


def is_valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == IP, value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == CARD, F.when(F.length(digits).between(14, 19), passes_luhn(digits)).otherwise(False))
        .when(kind == PHONE, F.length(digits).between(10, 15))
        .otherwise(True)
    )


def entity(kind: Column, value: Column) -> Column:
    """One name for all ways to write an entity."""
    return F.concat(kind.cast("string"), F.lit(":"), F.when(kind == EMAIL, F.lower(value)).when(kind == IP, value).otherwise(F.regexp_replace(value, "[^0-9]", "")))


def _matches(text: str, patterns: dict[int, str]) -> Column:
    """An array of all matches: ``kind, i, gap`` (characters since the match before) and ``value``."""

    def of(kind: int, pattern: str) -> Column:
        both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
        return F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["value"].alias("value")))

    return F.filter(F.concat(*[of(k, p) for k, p in patterns.items()]), lambda x: x["value"].isNotNull())


def located(texts: DataFrame, patterns: dict[int, str]) -> DataFrame:
    """``h, kind, i, start, end, value`` of all matches in column ``text``."""
    rows = texts.select("h", F.explode(_matches("text", patterns)).alias("x")).select("h", "x.*")
    before = Window.partitionBy("h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(before)
    return rows.withColumn("end", end).select("h", "kind", "i", (F.col("end") - F.length("value")).alias("start"), "end", "value")


class Found(NamedTuple):
    """``rows``: all documents, ``h`` where they have spans to look for; ``texts``: each such text once, with its number ``n``;
    ``spans``: ``h, kind, start, end, value`` of patterns and method; ``disclosing``: ``e, word, kind, disclosure``."""

    rows: DataFrame
    texts: DataFrame
    spans: DataFrame
    disclosing: DataFrame


def find(
    docs: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW, support: int = SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT
) -> Found:
    """Looks at column ``text``; ``rows`` has the columns ``keep`` in a struct ``row``."""
    plain = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hint = F.lit(False)
    for pattern in HINTS.values():
        hint = hint | F.col("text").rlike(pattern)
    rows = written(plain.withColumn("h", F.when(hint, F.unhex(F.sha2("text", 256)))).select("row", "h", F.when(F.col("h").isNotNull(), F.col("text")).alias("text")), "privacy-rows")
    texts = rows.where(F.col("h").isNotNull()).groupBy("h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    texts = written(texts, "privacy-texts")

    base = located(texts, PATTERNS).where(is_valid(F.col("kind"), F.col("value")))
    base = written(base.select("h", "kind", "start", "end", "value", entity(F.col("kind"), F.col("value")).alias("e")), "privacy-base")
    tokens = written(_tokens(located(texts.join(base, "h", "left_semi"), {-1: TERM}), base), "privacy-tokens")

    terms = tokens.where("idx is not null and e is null").select("h", F.col("idx").alias("at"), F.lower("value").alias("word"))
    near = F.explode(F.sequence(F.col("before") - window + 1, F.col("before") + window))
    windows = tokens.where("e is not null").select("h", "e", near.alias("at")).where("at > 0")
    pairs = windows.join(terms, ["h", "at"]).select("h", "e", "word").distinct().join(texts.select("h", "n"), "h")
    pairs = pairs.groupBy("e", "word").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n_et")).where(F.col("texts") >= support)
    held = base.select("h", "e").distinct()
    n_e = held.join(texts.select("h", "n"), "h").groupBy("e").agg(F.sum("n").alias("n_e"))
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    n_t = plain.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_t"))
    total = rows.count()
    joined = pairs.join(n_e, "e").join(n_t, "word").where(F.col("n_e") < total)
    share = F.round(F.ln(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t"))) / F.ln(F.lit(float(total)) / F.col("n_e")), 9)
    told = joined.withColumn("disclosure", share).where(F.col("disclosure") >= generalise_at)
    told = written(told.select("e", "word", F.when(F.col("disclosure") >= remove_at, REMOVED).otherwise(GENERALISED).alias("kind"), "disclosure"), "privacy-disclosing")

    # a text's words that disclose an entity which the text holds
    spoken = tokens.where("idx is not null and e is null").select("h", F.lower("value").alias("word"), "start", "end", "value")
    risky = spoken.select("h", "word").distinct().join(told.select("word", "e", "kind"), "word").join(held, ["h", "e"], "left_semi")
    risky = written(risky.groupBy("h", "word").agg(F.max("kind").alias("kind")), "privacy-risky")
    more = spoken.join(risky, ["h", "word"]).select("h", "kind", "start", "end", "value")
    return Found(rows, texts, written(base.drop("e").unionByName(more), "privacy-spans"), told)


def _tokens(terms: DataFrame, base: DataFrame) -> DataFrame:
    """Terms and entities of each text in order. ``idx`` numbers the terms that no entity touches; ``before`` counts them up to a row."""
    none = F.lit(None).cast("string")
    events = terms.select("h", "start", "end", "value", none.alias("e")).unionByName(base.select("h", "start", "end", "value", "e"))
    order = Window.partitionBy("h").orderBy("start", F.col("e").isNull(), "end", "e")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.coalesce(F.max(F.when(F.col("e").isNotNull(), F.col("end"))).over(so_far) > F.col("start"), F.lit(False))
    # terms do not overlap, so what begins inside a term is the next event, an entity
    cut = F.coalesce(F.lead(F.when(F.col("e").isNotNull(), F.col("start"))).over(order) < F.col("end"), F.lit(False))
    free = events.withColumn("free", F.col("e").isNull() & ~inside & ~cut)
    counted = free.withColumn("before", F.sum(F.col("free").cast("int")).over(so_far))
    return counted.select("h", "start", "end", "value", "e", F.when(F.col("free"), F.col("before")).alias("idx"), "before")


def digest(found: Found) -> DataFrame:
    """``row, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each document."""
    def listed(kept: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    spans = found.spans.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"), *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])])
    by_text = spans.select(
        F.col("h").alias("text_h"), *[f"n_{k}" for k in KINDS[:4]],
        F.sha2(listed(F.filter("s", lambda x: x["kind"] < GENERALISED)), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"),
    )
    by_text = written(by_text, "privacy-digest")
    # documents without hints are not joined: their missing keys would be one hot key
    looked = found.rows.where(F.col("h").isNotNull()).select("row", "h").join(by_text, F.col("h") == F.col("text_h"), "left").drop("h", "text_h")
    clean = found.rows.where(F.col("h").isNull()).select("row", *[F.lit(None).cast("long").alias(f"n_{k}") for k in KINDS[:4]], F.lit(None).cast("string").alias("base_sha256"), F.lit(None).cast("string").alias("spans"))
    empty = {**{f"n_{k}": F.lit(0).cast("long") for k in KINDS[:4]}, "base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    return looked.unionByName(clean).withColumns({c: F.coalesce(c, v) for c, v in empty.items()})


def sanitised(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with its texts rewritten: entities become placeholders, disclosing terms their class or nothing.

    Spans that overlap become one, with what the first stands for.
    """
    found = find(docs.select(F.struct("*").alias("doc"), F.col(text).alias("text")), ["doc"], **options)
    shape = F.when(F.col("value").rlike(r"\p{N}"), "[code]").when(F.col("value").rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
    instead = F.when(F.col("kind") == REMOVED, "").when(F.col("kind") == GENERALISED, shape).otherwise(F.get(F.array(*[F.lit(p) for p in PLACEHOLDERS]), F.col("kind")))
    before = Window.partitionBy("h").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.spans.withColumn("new", instead).withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    spans = spans.withColumn("run", F.sum((F.col("start") >= F.col("reached")).cast("int")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = spans.groupBy("h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("new", F.struct("start", "kind", "end")).alias("new"))
    cuts = runs.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("start", "end", "new"))).alias("cuts"))
    both = found.texts.join(cuts, "h")
    # what stands before each cut since the one before, then what the cut becomes
    kept = F.transform("cuts", lambda x, i: F.concat(F.substring("text", F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0)) + 1, x["start"] - F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0))), x["new"]))
    tail = F.substring("text", F.element_at("cuts", -1)["end"] + 1, F.length("text"))
    new = written(both.select(F.col("h").alias("text_h"), F.concat(F.array_join(kept, ""), tail).alias("new")), "privacy-texts-new")
    looked = found.rows.where(F.col("h").isNotNull()).join(new, F.col("h") == F.col("text_h"), "left").select("row", F.coalesce("new", "text").alias("new"))
    clean = found.rows.where(F.col("h").isNull()).select("row", F.col(f"row.doc.{text}").alias("new"))
    out = looked.unionByName(clean)
    return out.select(*[F.col("new").alias(c) if c == text else F.col("row.doc").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents"), ["doc_id"])).select("row.doc_id", *[f"n_{k}" for k in KINDS[:4]], "base_sha256", "spans")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
raw AS (
  SELECT r, 0 AS kind, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS g, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS v FROM d
  UNION ALL SELECT r, 1, string_split_regex(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM d
  UNION ALL SELECT r, 2, string_split_regex(t, '[0-9](?:[\x20-]?[0-9])+'), regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+') FROM d
  UNION ALL SELECT r, 3, string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
  UNION ALL SELECT r, -1, string_split_regex(t, '\p{L}[\p{L}\p{M}\p{N}]{2,}'), regexp_extract_all(t, '\p{L}[\p{L}\p{M}\p{N}]{2,}') FROM d),
m AS (SELECT r, kind, generate_subscripts(v, 1) AS i, unnest(g[1:len(v)]) AS gap, unnest(v) AS v FROM raw WHERE len(v) > 0),
pos AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits, (sum(length(gap) + length(v)) OVER (PARTITION BY r, kind ORDER BY i))::BIGINT AS e FROM m),
base AS (SELECT r, kind, e - length(v) AS s, e, kind || ':' || CASE kind WHEN 0 THEN lower(v) WHEN 1 THEN v ELSE digits END AS who FROM pos
  WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN list_max([x::HUGEINT FOR x IN string_split(v, '.')]) <= 255 WHEN 3 THEN len(digits) BETWEEN 10 AND 15
    WHEN 2 THEN len(digits) BETWEEN 14 AND 19 AND list_sum([CASE WHEN i % 2 = 0 THEN substr(reverse(digits), i + 1, 1)::INT
      ELSE 2 * substr(reverse(digits), i + 1, 1)::INT - CASE WHEN substr(reverse(digits), i + 1, 1)::INT > 4 THEN 9 ELSE 0 END END FOR i IN range(len(digits))]) % 10 = 0 ELSE false END),
free AS (SELECT r, s, e, word, row_number() OVER (PARTITION BY r ORDER BY s) AS idx FROM (SELECT r, e - length(v) AS s, e, lower(v) AS word FROM pos WHERE kind = -1 AND r IN (SELECT r FROM base)) x
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.s < x.e AND x.s < b.e)),
placed AS (SELECT b.r, b.who, (SELECT count(*) FROM free f WHERE f.r = b.r AND f.s < b.s) AS before FROM base b),
near AS (SELECT DISTINCT p.r, who, word FROM placed p JOIN free f ON f.r = p.r AND f.idx > p.before - 10 AND f.idx <= p.before + 10),
pairs AS (SELECT who, word, count(*) AS n_et FROM near JOIN d USING (r) GROUP BY who, word HAVING count(DISTINCT t) >= 2),
n_e AS (SELECT who, count(DISTINCT r) AS n_e FROM base GROUP BY who),
n_t AS (SELECT lower(v) AS word, count(DISTINCT r) AS n_t FROM pos WHERE kind = -1 GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
told AS (SELECT who, word, CASE WHEN x >= 0.9 THEN 5 ELSE 4 END AS kind
  FROM (SELECT who, word, round(ln(n_et * n / (n_e * n_t)) / ln(n / n_e), 9) AS x FROM pairs JOIN n_e USING (who) JOIN n_t USING (word), n WHERE n_e < n) y WHERE x >= 0.75),
more AS (SELECT f.r, max(told.kind) AS kind, f.s, f.e FROM free f JOIN told USING (word) JOIN (SELECT DISTINCT r, who FROM base) h ON h.r = f.r AND h.who = told.who GROUP BY f.r, f.s, f.e),
spans AS (SELECT r, kind, s, e FROM base UNION ALL SELECT r, kind, s, e FROM more),
named AS (SELECT *, ['email', 'ip', 'card', 'phone', 'generalised', 'removed'][1 + kind] || ':' || s || ':' || e AS x FROM spans)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
  sha256(coalesce(string_agg(x, ',' ORDER BY s, kind, e) FILTER (kind < 4), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, kind, e), '') AS spans
FROM d LEFT JOIN named USING (r) GROUP BY r, doc_id
"""
