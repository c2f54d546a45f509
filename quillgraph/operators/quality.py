"""Data quality: coverage counters, joins along documents, schema differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import SCHEMAS


def document_entities(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """``document_id, entity_id``, each once: two hops."""
    return chunks.select(F.col("id").alias("chunk_id"), "document_id").join(mentions, "chunk_id").select("document_id", "entity_id").distinct()


def document_relations(chunks: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """How many edges of each type leave a document's entities."""
    found = document_entities(chunks, mentions).withColumnRenamed("entity_id", "src_id")
    # an entity's edges are counted first: a document meets one row for each entity, and its types come together once
    each = edges.groupBy("src_id", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("src_id").agg(F.collect_list(F.struct("type", "n")).alias("types"))
    met = found.join(each, "src_id").select("document_id", "types").repartition("document_id").select("document_id", F.explode("types").alias("t"))
    return met.groupBy("document_id", "t.type").agg(F.sum("t.n").alias("n"))


def document_coverage(documents: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each document's stored and real number of chunks, and its number of entities; both sides are counted before joining."""
    c = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    e = document_entities(chunks, mentions).groupBy("document_id").agg(F.count(F.lit(1)).alias("entities"))
    zero = F.lit(0)
    joined = documents.select(F.col("id").alias("document_id"), "chunk_count").join(c, "document_id", "left").join(e, "document_id", "left")
    return joined.select("document_id", F.col("chunk_count").alias("stored"), F.coalesce("chunks", zero).alias("chunks"), F.coalesce("entities", zero).alias("entities"))


def document_content(documents: DataFrame, chunks: DataFrame, mentions: DataFrame, names: DataFrame) -> DataFrame:
    """A document's text with the texts of its chunks in order and the names of its entities."""
    c = chunks.groupBy(F.col("document_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("chunk_texts"))
    e = document_entities(chunks, mentions).join(names, "entity_id").groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("entity_names"))
    empty = F.array().cast("array<string>")
    return documents.select("id", "content").join(c, "id", "left").join(e, "id", "left").withColumns({"chunk_texts": F.coalesce("chunk_texts", empty), "entity_names": F.coalesce("entity_names", empty)})


def selected_text(chunks: DataFrame, ids: DataFrame, joiner: str = "\n\n") -> DataFrame:
    """The texts of selected chunks in order of id, one string a document."""
    kept = chunks.join(ids, "id", "left_semi")
    return kept.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), joiner).alias("text"))


def entity_frequency(documents: DataFrame, entities: str = "entities", limit: int = 20) -> DataFrame:
    """In how many documents of a module each entity occurs (once each); the first five of a module are its themes."""
    named = documents.select("module_id", F.explode(F.array_distinct(entities)).alias("name"))
    counted = named.groupBy("module_id", "name").agg(F.count(F.lit(1)).alias("documents"))
    rank = F.row_number().over(Window.partitionBy("module_id").orderBy(F.desc("documents"), "name"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit).withColumn("theme", F.col("rank") <= 5)


def problem_counts(documents: DataFrame, chunks: DataFrame, mentions: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``check, n``: the seven counters of incomplete or unconnected rows."""
    c_docs = chunks.select(F.col("document_id").alias("id"))
    e_docs = document_entities(chunks, mentions).select(F.col("document_id").alias("id"))
    linked = mentions.select(F.col("entity_id").alias("id"))
    ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id"))
    blank = F.col("definition").isNull() | (F.trim("definition") == "")
    bare = F.col("embedding").isNull() | (F.size("embedding") == 0)

    def counter(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))

    unlinked = entities.join(linked, "id", "left_anti")
    parts = [
        counter("documents_without_chunks", documents.join(c_docs, "id", "left_anti")),
        counter("documents_without_entities", documents.join(e_docs, "id", "left_anti")),
        counter("chunks_without_embedding", chunks.where(bare)),
        counter("entities_without_definition", entities.where(blank)),
        counter("entities_without_embedding", entities.where(bare)),
        counter("entities_without_chunk", unlinked),
        counter("orphans", unlinked.join(ends, "id", "left_anti")),
    ]
    return reduce(DataFrame.unionByName, parts)


def schema_difference(expected: DataFrame, present: DataFrame) -> DataFrame:
    """``kind, name, state``: elements (``kind, name``) that are missing or extra."""
    e, p = expected.select("kind", "name").distinct(), present.select("kind", "name").distinct()
    return e.exceptAll(p).withColumn("state", F.lit("missing")).unionByName(p.exceptAll(e).withColumn("state", F.lit("extra")))


def table_elements(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables and columns as ``kind, name``."""
    spark = next(iter(tables.values())).sparkSession
    rows = [("table", t) for t in tables] + [("column", f"{t}.{f.name}:{f.dataType.simpleString()}") for t, df in tables.items() for f in df.schema]
    return spark.createDataFrame(rows, "kind string, name string")


def ddl_script(names: list[str] | None = None) -> list[str]:
    """Statements that create the model's tables; nothing is executed."""
    return [f"CREATE TABLE IF NOT EXISTS {name} ({' '.join(SCHEMAS[name].split())}) USING parquet" for name in names or SCHEMAS]


def apply_ddl(spark: SparkSession, statements: list[str], dry_run: bool = True) -> list[str]:
    if not dry_run:
        for s in statements:
            spark.sql(s)
    return statements
