"""Graph export. Each format is a table of lines (or records) that Spark writes in parallel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(c: Column) -> Column:
    """Text for XML attributes and elements."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def quoted(c: Column) -> Column:
    """A CSV field with quotes doubled."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def _document(nodes: DataFrame, parts: list[tuple[int, DataFrame]], fixed: list[tuple[int, str]]) -> DataFrame:
    """Lines in order of (part, id). ``fixed`` are lines around the parts."""
    spark = nodes.sparkSession
    around = [spark.range(1).select(F.lit(p).alias("part"), F.lit("").alias("id"), F.lit(text).alias("line")) for p, text in fixed]
    return reduce(DataFrame.unionByName, [*around, *[df.select(F.lit(p).alias("part"), "id", "line") for p, df in parts]])


def _edge_key() -> Column:
    return F.concat_ws("|", "src_id", "dst_id", "type")


def csv_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Two sections in one file: nodes, a blank line, edges."""
    n = nodes.select("id", F.concat_ws(",", quoted(F.col("id")), quoted(F.col("name")), quoted(F.col("label"))).alias("line"))
    e = edges.select(_edge_key().alias("id"), F.concat_ws(",", quoted(F.col("src_id")), quoted(F.col("dst_id")), quoted(F.col("type"))).alias("line"))
    return _document(nodes, [(2, n), (5, e)], [(0, "# Nodes"), (1, "id,name,type"), (3, ""), (4, "source,target,type")])


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select("id", F.concat(F.lit('<node id="'), escaped(F.col("id")), F.lit('"><data key="name">'), escaped(F.col("name")), F.lit('</data><data key="type">'), escaped(F.col("label")), F.lit("</data></node>")).alias("line"))
    e = edges.select(_edge_key().alias("id"), F.concat(F.lit('<edge source="'), escaped(F.col("src_id")), F.lit('" target="'), escaped(F.col("dst_id")), F.lit('"><data key="kind">'), escaped(F.col("type")), F.lit("</data></edge>")).alias("line"))
    head = (
        '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="name" for="node" attr.name="name" attr.type="string"/>'
        '<key id="type" for="node" attr.name="type" attr.type="string"/><key id="kind" for="edge" attr.name="kind" attr.type="string"/><graph edgedefault="directed">'
    )
    return _document(nodes, [(1, n), (2, e)], [(0, head), (3, "</graph></graphml>")])


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select("id", F.concat(F.lit('<node id="'), escaped(F.col("id")), F.lit('" label="'), escaped(F.col("name")), F.lit('"/>')).alias("line"))
    e = edges.select(_edge_key().alias("id"), F.concat(F.lit('<edge source="'), escaped(F.col("src_id")), F.lit('" target="'), escaped(F.col("dst_id")), F.lit('" label="'), escaped(F.col("type")), F.lit('"/>')).alias("line"))
    return _document(
        nodes, [(1, n), (3, e)],
        [(0, '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")],
    )


def json_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON record a line, ``kind`` tells nodes from edges."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "name", "label")).alias("line"), "id")
    e = edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), "src_id", "dst_id", "type")).alias("line"), _edge_key().alias("id"))
    return _document(nodes, [(0, n), (1, e)], [])


FORMATS = {"csv": csv_lines, "graphml": graphml_lines, "gexf": gexf_lines, "json": json_records}


def export(nodes: DataFrame, edges: DataFrame, kind: str, path: str) -> None:
    """Writes the graph's lines in order, in as many files as there is data for; names sort in the order of their lines."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    FORMATS[kind](nodes, edges).repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("line").write.mode("overwrite").text(path)
