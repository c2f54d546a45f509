"""Vector search, fuzzy name matching and semantic dedupe of entities."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from . import vector_index
from .graph import connected_components, settled, shared_folder

#: Rows of a group of vectors that are compared at once.
BLOCK_ROWS = 1024
#: Characters of the contexts of merged entities.
CONTEXT_CHARS = 500


def nearest(df: DataFrame, query: list[float], k: int, label: object = None, embedding: str = "embedding", key: str = "id") -> DataFrame:
    """``key, score`` of the k rows closest to the query by cosine; other lengths are refused. The query travels as a literal."""
    rows = df if label is None else df.where(F.col("label") == label)
    rows = rows.where(F.size(embedding) == len(query))
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, v.cosine(F.col(embedding), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hybrid(df: DataFrame, query: list[float], terms: list[str], k: int, vector_weight: float = 0.7, text_weight: float = 0.3, min_score: float = 0.3, text: str = "text", embedding: str = "embedding", key: str = "id") -> DataFrame:
    """An extension: the weighted sum of cosine and the share of the terms found in the text. Weights are brought to a sum of one (both 0: 0.7 and 0.3)."""
    total = vector_weight + text_weight
    wv, wt = (vector_weight / total, text_weight / total) if total else (0.7, 0.3)
    q = F.array(*[F.lit(float(x)) for x in query])
    found = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    share = F.size(F.array_intersect(found, F.array(*[F.lit(x.lower()) for x in terms]))) / max(1, len(set(terms)))
    scored = df.select(key, (wv * v.cosine(F.col(embedding), q) + wt * share).alias("score"))
    return scored.where(F.col("score") >= min_score).orderBy(F.desc("score"), key).limit(k)


def similar_pairs(df: DataFrame, threshold: float, block: list[str] | None = None, embedding: str = "embedding", key: str = "id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b, score`` of pairs a < b with a cosine of at least the threshold, within each block (all rows form one if none is given).

    Without blocks the vectors are indexed by cells, and only cells that may hold such a pair meet (``vector_index``); vectors that have no clusters
    at all still meet all others. With blocks, a block of more than ``block_rows`` is dealt to groups of about so many, of which every pair is one task's
    work, and small blocks are dealt to tasks together. No task holds more than two groups.
    """
    if not block:
        kind = df.schema[key].dataType.simpleString()
        return _by_length(df, lambda index: vector_index.close_pairs(index, df.sparkSession, threshold), f"a {kind}, b {kind}, score double", embedding, key)
    rows = df.where((F.size(embedding) > 0) & F.col(key).isNotNull())
    return _pairs_in_blocks(rows.select(F.col(key).alias("id"), v.unit(F.col(embedding)).alias("u"), *block), threshold, block, block_rows)


def similar_links(df: DataFrame, threshold: float, block: list[str] | None = None, embedding: str = "embedding", key: str = "id") -> DataFrame:
    """``a, b``: pairs of ``similar_pairs``, enough of them that the same rows hang together; without blocks they are no more than the rows times the tiles they lie in."""
    if block:
        return similar_pairs(df, threshold, block, embedding, key).select("a", "b")
    kind = df.schema[key].dataType.simpleString()
    return _by_length(df, lambda index: vector_index.close_links(index, df.sparkSession, threshold), f"a {kind}, b {kind}", embedding, key)


def _by_length(df: DataFrame, search: Callable[[vector_index.Index], DataFrame], schema: str, embedding: str, key: str) -> DataFrame:
    """What is found among the vectors of each length."""
    rows = df.where((F.size(embedding) > 0) & F.col(key).isNotNull()).select(key, embedding)
    spark = df.sparkSession
    found = []
    for dim in sorted(r.n for r in rows.select(F.size(embedding).alias("n")).distinct().collect()):  # lengths, of which there are few
        found.append(search(vector_index.build(rows, f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}", dim, embedding=embedding, key=key)))
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], schema)) if len(found) != 1 else found[0]


def _pairs_in_blocks(rows: DataFrame, threshold: float, block: list[str], block_rows: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    sizes = settled(rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n")))
    tasks = max(1, -(-(sizes.where(F.col("n") <= block_rows).agg(F.sum("n")).first()[0] or 0) // block_rows))
    same = reduce(and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in block])
    counted = rows.alias("r").join(sizes.alias("s"), same).select("r.*", F.ceil(F.col("n") / block_rows).cast("long").alias("groups"))
    counted = counted.withColumn("g", F.pmod(F.xxhash64("id"), F.col("groups")))
    # a large block: each row goes once to every group it meets. Small ones: a hash of the block says to which task they go
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("lo"), F.pmod(F.xxhash64(*block), F.lit(tasks)).alias("hi")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1), lambda o: F.struct(F.least("g", o).alias("lo"), F.greatest("g", o).alias("hi")))
    spread = counted.withColumn("x", F.explode(F.when(F.col("groups") == 1, alone).otherwise(others))).withColumns({"lo": F.col("x.lo"), "hi": F.col("x.hi")})
    spread = spread.withColumn("part", F.when(F.col("lo") < 0, F.lit(None)).otherwise(F.xxhash64(*block))).select("part", "lo", "hi", "g", "id", "u", *block)

    def meet(two: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"a": two["id"].iloc[:0], "b": two["id"].iloc[:0], "score": np.empty(0)})]
        one_group = two["lo"].iloc[0] == two["hi"].iloc[0] or two["lo"].iloc[0] < 0
        two = two.sort_values("id", ignore_index=True)
        for _, alike in two.groupby([*(two[c].astype(object) for c in block), two["u"].map(len)], sort=False, dropna=False):
            if len(alike) < 2:
                continue
            ids, g, u = alike["id"].to_numpy(), alike["g"].to_numpy(), np.stack(alike["u"].to_list())
            for first in range(0, len(u), 512):
                i, j = np.nonzero(u[first : first + 512] @ u.T >= threshold - 1e-9)
                i += first
                met = (ids[i] < ids[j]) & (one_group | (g[i] != g[j]))  # two rows of one group meet in that group's own task
                i, j = i[met], j[met]
                if len(i):
                    score = np.cumsum(u[i] * u[j], axis=1)[:, -1]
                    found.append(pd.DataFrame({"a": ids[i], "b": ids[j], "score": score})[score >= threshold])
        return pd.concat(found[1:] or found, ignore_index=True)

    return spread.groupBy("part", "lo", "hi").applyInPandas(meet, f"a {kind}, b {kind}, score double")


def merged_entities(entities: DataFrame, pairs: DataFrame, contexts: int | None = None, sum_mentions: bool = True) -> tuple[DataFrame, DataFrame]:
    """Canonical entities and the alias map ``id, canonical_id`` for ``id, name, definition, confidence, context, mention_count, ord``.

    Of each component the most certain entity (the first of equals) stays, with the first non-empty definition in order, up to 500
    characters of contexts (100 of each, the first ``contexts`` of them) and the sum of mentions. Others pass unchanged.
    """
    labels = connected_components(pairs)
    rows = entities.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = F.max_by("id", F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("ord")))
    filled = F.when(F.coalesce(F.trim("definition"), F.lit("")) != "", F.col("definition"))
    # so many contexts fill the 500 characters, whatever the component's size
    most = CONTEXT_CHARS // 6 + 2 if contexts is None else min(contexts, CONTEXT_CHARS // 6 + 2)
    early = Window.partitionBy("component").orderBy("ord", "_c")
    told = rows.where(F.coalesce("context", F.lit("")) != "").select("component", "ord", F.substring("context", 1, 100).alias("_c")).withColumn("_r", F.row_number().over(early)).where(F.col("_r") <= most)
    told = told.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_c"))), lambda x: x["_c"]), " ... ").alias("_told"))
    grouped = rows.groupBy("component").agg(
        best.alias("canonical_id"),
        F.min_by(filled, F.when(filled.isNotNull(), F.col("ord"))).alias("_definition"),
        F.sum(F.coalesce("mention_count", F.lit(1))).alias("_mentions"),
        F.count(F.lit(1)).alias("_n"),
    )
    grouped = grouped.join(told, "component", "left").withColumn("_context", F.substring(F.coalesce("_told", F.lit("")), 1, CONTEXT_CHARS))
    joined = rows.join(grouped, "component")
    aliases = joined.select("id", "canonical_id")
    canonical = joined.where(F.col("id") == F.col("canonical_id")).withColumns({
        "definition": F.when(F.col("_n") > 1, F.coalesce("_definition", "definition")).otherwise(F.col("definition")),
        "context": F.when(F.col("_n") > 1, F.col("_context")).otherwise(F.col("context")),
        "mention_count": F.when((F.col("_n") > 1) & F.lit(sum_mentions), F.col("_mentions")).otherwise(F.coalesce("mention_count", F.lit(1)).cast("long")),
    })
    return canonical.select(*entities.columns), aliases


def semantic_dedupe(entities: DataFrame, threshold: float = 0.85, block: list[str] | None = None, minimum: int = 3, contexts: int | None = None, sum_mentions: bool = True) -> tuple[DataFrame, DataFrame]:
    """Merges entities whose vectors are alike. With fewer than ``minimum`` vectors, or no pair, the input is returned unchanged."""
    same = entities.select("id", F.col("id").alias("canonical_id"))
    if entities.where(F.size("embedding") > 0).limit(minimum).count() < minimum:
        return entities, same
    pairs = similar_links(entities, threshold, block)
    return merged_entities(entities, pairs, contexts, sum_mentions)


def exact_dedupe(entities: DataFrame, keys: list[str]) -> DataFrame:
    """The most certain entity for each normalised name and keys (the first of equals); contexts of the others are appended to its own."""
    w = Window.partitionBy("_n", *keys).orderBy(F.desc("confidence"), "ord")
    named = entities.withColumn("_n", F.lower(F.trim("name")))
    ranked = named.withColumn("_r", F.row_number().over(w))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("context", F.lit("")) != "", F.struct("_r", "context")))), lambda x: x["context"]), " ... ")
    contexts = ranked.groupBy("_n", *keys).agg(told.alias("_all"))
    return ranked.where("_r = 1").join(contexts, ["_n", *keys]).withColumn("context", F.col("_all")).select(*entities.columns)


def repoint(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """``chunk_id, entity_id`` through the alias map, each link once."""
    joined = links.join(aliases.select(F.col("id").alias("entity_id"), "canonical_id"), "entity_id", "left")
    return joined.select("chunk_id", F.coalesce("canonical_id", "entity_id").alias("entity_id")).distinct()


def acronym(name: Column) -> Column:
    initials = F.transform(F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1))
    return F.array_join(initials, "")


def fuzzy_match(mentions: DataFrame, entities: DataFrame, block: str = "doc_id") -> DataFrame:
    """``block, mention, id, rule``: of the entities of one block the best match of each mention: the same name (1), one within the
    other (2), initials (3), or an abbreviation whose letters occur in order, beginning with the first (4); the first by ``ord`` of equals.

    The join is by block, which is one document: both sides are small there.
    """
    m = F.lower(F.trim("mention"))
    n = F.lower(F.trim("name"))
    letters = F.regexp_replace(m, r"[^\p{L}\p{N}]", "")
    pattern = F.concat(F.lit("^"), F.array_join(F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.concat(c, F.lit(".*"))), ""))
    rule = (
        F.when(m == n, 1)
        .when((m != "") & (n != "") & (n.contains(m) | m.contains(n)), 2)
        .when((F.length(m) > 1) & ((acronym(F.col("name")) == m) | (acronym(F.col("mention")) == n)), 3)
        .when((F.length(letters) > 1) & (F.length(letters) <= 6) & (F.length(letters) < F.length(n)) & F.regexp_like(n, pattern), 4)
    )
    pairs = mentions.join(entities, block).withColumn("rule", rule).where(F.col("rule").isNotNull())
    w = Window.partitionBy(block, "mention").orderBy("rule", "ord")
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(block, "mention", "id", "rule")
