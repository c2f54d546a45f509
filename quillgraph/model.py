"""The data model: schemas, vocabularies and the rules for ids and missing values that all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabularies and weights that results depend on.
ENTITY_TYPES = ("Topic", "Concept", "Methodology", "Finding", "Definition", "Citation")
ANALYTIC_TYPES = ("Topic", "Concept", "Methodology", "Finding")
EDGE_WEIGHTS = {
    "DEFINES": 1.0,
    "DEPENDS_ON": 0.9,
    "USES": 0.8,
    "SUPPORTS": 0.8,
    "EXTENDS": 0.7,
    "IMPLEMENTS": 0.7,
    "CONTRADICTS": 0.6,
    "REFERENCES": 0.5,
    "RELATED_TO": 0.4,
}
DEFAULT_EDGE_TYPE, DEFAULT_EDGE_WEIGHT = "RELATED_TO", 0.4

SCHEMAS = {
    "entities": """id STRING NOT NULL, label STRING NOT NULL, name STRING NOT NULL, definition STRING, category STRING, module_id STRING,
        document_id STRING, confidence DOUBLE, mention_count INT, embedding ARRAY<FLOAT>, context_snippet STRING, created_at TIMESTAMP,
        updated_at TIMESTAMP""",
    "edges": """src_id STRING NOT NULL, dst_id STRING NOT NULL, type STRING NOT NULL, confidence DOUBLE, evidence STRING,
        relevance_score DOUBLE, module_id STRING, created_at TIMESTAMP""",
    "documents": """id STRING NOT NULL, title STRING, content STRING, module_id STRING, user_id STRING, chunk_count INT, status STRING,
        word_count INT, updated_at TIMESTAMP""",
    "parent_chunks": "id STRING NOT NULL, document_id STRING, module_id STRING, idx INT, text STRING, token_count INT, embedding ARRAY<FLOAT>",
    "chunks": """id STRING NOT NULL, document_id STRING, parent_chunk_id STRING, module_id STRING, idx INT, text STRING, token_count INT,
        chunk_labels ARRAY<STRING>, section_path ARRAY<STRING>, embedding ARRAY<FLOAT>""",
    "feedback": """id STRING, query STRING, query_hash STRING, result_id STRING, result_rank INT, answer_hash STRING, relevance_score DOUBLE,
        helpful BOOLEAN, accuracy_score DOUBLE, feedback_type STRING, dwell_time_ms BIGINT, user_id STRING, session_id STRING,
        module_ids ARRAY<STRING>, comment STRING, is_positive BOOLEAN, ts TIMESTAMP""",
    "usage": """ts TIMESTAMP, session_id STRING, provider STRING, model STRING, input_tokens BIGINT, output_tokens BIGINT,
        thinking_tokens BIGINT, cost_usd DOUBLE""",
    "departments": "id STRING, name STRING, code STRING",
    "semesters": "id STRING, name STRING, semester_number INT, department_id STRING",
    "subjects": "id STRING, name STRING, code STRING, semester_id STRING",
    "modules": "id STRING, name STRING, module_number INT, subject_id STRING",
    "notes": "id STRING, title STRING, pdf_url STRING, module_id STRING, kg_status STRING, kg_progress INT, created_at TIMESTAMP",
    "users": """uid STRING, email STRING, display_name STRING, role STRING, status STRING, department_id STRING,
        subject_ids ARRAY<STRING>, created_at TIMESTAMP, updated_at TIMESTAMP, v INT""",
}
HIERARCHY = (("departments", None), ("semesters", "department_id"), ("subjects", "semester_id"), ("modules", "subject_id"), ("notes", "module_id"))


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def entity_id(name: Column, module_id: Column) -> Column:
    """The one id scheme used throughout: a hash of the normalised name and the module."""
    return F.concat(F.lit("entity_"), F.substring(F.md5(F.concat(normal_name(name), F.lit(":"), module_id)), 1, 16))


def edge_weight(kind: Column) -> Column:
    pairs = [F.lit(x) for item in EDGE_WEIGHTS.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[kind], F.lit(DEFAULT_EDGE_WEIGHT))


def certain(confidence: Column) -> Column:
    """Missing and zero confidence both count as certain."""
    return F.when(confidence.isNull() | (confidence == 0), 1.0).otherwise(confidence)


def by_confidence(column: str = "confidence") -> Column:
    """Descending, with unknown confidence first."""
    return F.col(column).desc_nulls_first()


def of_types(entities: DataFrame, types: tuple[str, ...] | None = None, modules: list[str] | None = None) -> DataFrame:
    """Entities that analytics look at; a requested type outside of these gives nothing."""
    rows = entities.where(F.col("label").isin(*ANALYTIC_TYPES))
    if types is not None:
        rows = rows.where(F.col("label").isin(*types))
    if modules is not None:
        rows = rows.where(F.col("module_id").isin(*modules))
    return rows
