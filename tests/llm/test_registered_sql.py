"""The registered queries that have SQL are held against it; all of them run on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from quillgraph.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    expected = con.sql(registry.ORACLES[name])
    columns = sorted(expected.columns)
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    place = [expected.columns.index(c) for c in columns]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(tuple(r[i] for i in place) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_has_a_row_for_each_document_or_page(spark, name):
    table = "pages" if name in ("op3_url_filter", "op6_html_extraction") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    got = sorted(r[0] for r in registry.QUERIES[name](spark, SF).select(key).collect())
    assert (sorted(set(got)) if name == "op2_packing" else got) == ids


def test_sizes_and_checksums_equal_sql(spark):
    con = duckdb.connect()
    sql = f"SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM read_parquet('{SF}/documents.parquet')"
    expected = {i: (size, words) for i, size, words in con.sql(sql).fetchall()}
    sizes = {r.doc_id: r["size"] for r in registry.QUERIES["op5_sharding"](spark, SF).collect()}
    words = {r.doc_id: r["size"] for r in registry.QUERIES["op9_mixing"](spark, SF).collect()}
    assert {i: (sizes[i], words[i]) for i in sizes} == expected
