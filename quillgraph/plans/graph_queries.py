"""Graph queries: suppliers and parts are entities, order lines are edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from .registry import query
from .roles import GRAPH, edges, nodes

_KNOWN = "type IN (SELECT type FROM weights)"
_SURE = "CASE WHEN coalesce(confidence, 0) = 0 THEN 1.0 ELSE confidence END"
_BOTH = """both_ways AS (SELECT src_id AS id, dst_id AS other, type, confidence, true AS is_outgoing FROM edges
  UNION ALL SELECT dst_id, src_id, type, confidence, false FROM edges)"""
_STEP = "step AS (SELECT DISTINCT id, other FROM both_ways)"


def _levels(start: str, depth: int) -> str:
    parts = [f"l0 AS (SELECT '{start}' AS id, 0 AS hops)", "s0 AS (SELECT * FROM l0)"]
    for h in range(1, depth + 1):
        parts.append(f"l{h} AS (SELECT DISTINCT other AS id, {h} AS hops FROM l{h - 1} JOIN step USING (id) WHERE other NOT IN (SELECT id FROM s{h - 1}))")
        parts.append(f"s{h} AS (SELECT * FROM s{h - 1} UNION ALL SELECT * FROM l{h})")
    return ", ".join(parts)


@query("s01_label_scan_s03_counts", f"WITH {GRAPH} SELECT label, count(*) AS n FROM nodes GROUP BY label")
def _(spark, d):
    return g.counts_by_label(nodes(spark, d))


@query("s02_point_lookup", f"WITH {GRAPH} SELECT * FROM nodes WHERE id = 'p17'")
def _(spark, d):
    return g.by_id(nodes(spark, d), "p17")


@query("f07_name_search", f"WITH {GRAPH} SELECT id, name, label, length(name) AS mention_count FROM nodes WHERE contains(lower(name), '1') ORDER BY length(name) DESC, name, id LIMIT 20")
def _(spark, d):
    return g.by_name(nodes(spark, d).withColumn("mention_count", F.length("name").cast("long")), "1").drop("module_id")


@query("f08_prefix", f"WITH {GRAPH} SELECT id, name FROM nodes WHERE starts_with(name, 'Supplier') OR starts_with(name, 'Part#1')")
def _(spark, d):
    return nodes(spark, d).where(F.col("name").startswith("Supplier") | F.col("name").startswith("Part#1")).select("id", "name")


@query("a02_edges_by_type", f"WITH {GRAPH} SELECT type, count(*) AS n FROM edges GROUP BY type")
def _(spark, d):
    return g.counts_by_type(edges(spark, d))


@query("a03_module_stats", f"""WITH {GRAPH}, m AS (SELECT * FROM nodes WHERE module_id = 'm2'), e AS (SELECT * FROM edges WHERE src_id IN (SELECT id FROM m) AND dst_id IN (SELECT id FROM m)),
  p AS (SELECT 'node' AS kind, label AS type, count(*) AS n FROM m GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY type)
  SELECT * FROM p UNION ALL SELECT kind, NULL, sum(n)::BIGINT FROM p GROUP BY kind""")
def _(spark, d):
    return g.module_stats(nodes(spark, d), edges(spark, d), "m2")


@query("a05_degrees", f"WITH {GRAPH}, x AS (SELECT src_id AS id FROM edges UNION ALL SELECT dst_id FROM edges) SELECT id, count(*) AS degree FROM x GROUP BY id ORDER BY degree DESC, id LIMIT 20")
def _(spark, d):
    return g.degrees(edges(spark, d))


@query("a06_duplicate_names", f"WITH {GRAPH}, x AS (SELECT id, module_id || label AS name FROM nodes) SELECT name, string_agg(id, ',' ORDER BY id) AS ids FROM x GROUP BY name HAVING count(*) > 1")
def _(spark, d):
    return g.duplicates(nodes(spark, d).withColumn("name", F.concat("module_id", "label"))).withColumn("ids", F.array_join("ids", ","))


@query("f13_f14_a04_filtered_graph", f"""WITH {GRAPH}, n AS (SELECT * FROM nodes WHERE label IN ('Topic','Finding','Concept') AND label <> 'Concept' ORDER BY id LIMIT 1040)
  SELECT type, count(*) AS n FROM edges WHERE type NOT IN ('USES') AND src_id IN (SELECT id FROM n) AND dst_id IN (SELECT id FROM n) GROUP BY type""")
def _(spark, d):
    n = g.filter_nodes(nodes(spark, d), ["Topic", "Finding", "Concept"], ["Concept"], max_nodes=1040)
    return g.counts_by_type(g.filter_edges(edges(spark, d), n, exclude=["USES"]))


@query("j09_induced_subgraph", f"WITH {GRAPH}, m AS (SELECT id FROM nodes WHERE module_id IN ('m0','m1')) SELECT src_id, dst_id, type, evidence FROM edges WHERE src_id IN (SELECT id FROM m) AND dst_id IN (SELECT id FROM m)")
def _(spark, d):
    return g.induced(edges(spark, d), nodes(spark, d).where(F.col("module_id").isin("m0", "m1"))).drop("confidence")


_KINDS = "uses AS (SELECT * FROM edges WHERE type = 'USES'), refs AS (SELECT * FROM edges WHERE type = 'REFERENCES')"


@query("j08_g12_orphans", f"""WITH {GRAPH}, {_KINDS} SELECT id, label FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM uses WHERE n.id IN (src_id)) AND NOT EXISTS (SELECT 1 FROM uses WHERE dst_id = n.id)
  AND NOT EXISTS (SELECT 1 FROM refs WHERE src_id = n.id) AND NOT EXISTS (SELECT 1 FROM refs WHERE dst_id = n.id)""")
def _(spark, d):
    e = edges(spark, d)
    return g.orphans(nodes(spark, d), e.where("type = 'USES'"), e.where("type = 'REFERENCES'")).select("id", "label")


@query("g01_neighbours", f"""WITH {GRAPH}, {_BOTH} SELECT n.id, n.name, n.label, b.type, confidence, w AS weight, is_outgoing FROM both_ways b JOIN nodes n ON n.id = b.other JOIN weights USING (type)
  WHERE b.id = 's3' ORDER BY confidence DESC NULLS FIRST, n.id, b.type, is_outgoing DESC LIMIT 50""")
def _(spark, d):
    return g.neighbours(nodes(spark, d), edges(spark, d), "s3")


@query("g01_incoming_neighbours", f"""WITH {GRAPH}, {_BOTH} SELECT n.id, n.name, n.label, b.type, confidence, w AS weight, is_outgoing FROM both_ways b JOIN nodes n ON n.id = b.other JOIN weights USING (type)
  WHERE b.id = 's5' AND NOT is_outgoing AND b.type IN ('USES','SUPPORTS') ORDER BY confidence DESC NULLS FIRST, n.id, b.type LIMIT 50""")
def _(spark, d):
    return g.neighbours(nodes(spark, d), edges(spark, d), "s5", ["USES", "SUPPORTS"], "incoming")


@query("g02_path_weight", f"WITH {GRAPH} SELECT e.type, round(sum(coalesce(w, 0.4) * 0.5 * {_SURE}), 4) AS weight FROM edges e LEFT JOIN weights USING (type) GROUP BY e.type")
def _(spark, d):
    return edges(spark, d).groupBy("type").agg(F.round(F.sum(g.path_weight(F.col("type"), F.lit(2), F.col("confidence"))), 4).alias("weight"))


@query("g05_w03_j10_u02_expand_context", f"""WITH {GRAPH}, known AS (SELECT * FROM edges WHERE {_KNOWN}), one AS (SELECT * FROM known WHERE src_id IN ('s1','p9')),
  ways AS (SELECT dst_id AS id, type, confidence, 1 AS hops FROM one UNION ALL SELECT dst_id, type, confidence, 2 FROM known WHERE src_id IN (SELECT dst_id FROM one) AND dst_id NOT IN ('s1','p9')),
  best AS (SELECT DISTINCT ON (n.id) n.id, n.name, n.label, type, hops, confidence FROM ways JOIN nodes n ON n.id = ways.id WHERE module_id IN ('m1','m2','m3') OR module_id IS NULL ORDER BY n.id, hops, confidence DESC NULLS FIRST, type)
  SELECT id, name, label, best.type, hops, round(w * (1.0 / hops) * {_SURE}, 4) AS relevance FROM best JOIN weights ON weights.type = best.type ORDER BY relevance DESC, id LIMIT 20""")
def _(spark, d):
    return g.expand_context(nodes(spark, d), edges(spark, d), ["s1", "p9"], depth=3, modules=["m1", "m2", "m3"])


@query("g03_j12_shortest_path", f"""WITH {GRAPH}, {_BOTH}, {_STEP},
  p0 AS (SELECT 'p1' AS id, ['p1'] AS path), q0 AS (SELECT id FROM p0),
  p1 AS (SELECT other AS id, min(list_append(path, other)) AS path FROM p0 JOIN step USING (id) WHERE other NOT IN (SELECT id FROM q0) GROUP BY other), q1 AS (SELECT id FROM q0 UNION SELECT id FROM p1),
  p2 AS (SELECT other AS id, min(list_append(path, other)) AS path FROM p1 JOIN step USING (id) WHERE other NOT IN (SELECT id FROM q1) GROUP BY other), q2 AS (SELECT id FROM q1 UNION SELECT id FROM p2),
  p3 AS (SELECT other AS id, min(list_append(path, other)) AS path FROM p2 JOIN step USING (id) WHERE other NOT IN (SELECT id FROM q2) GROUP BY other), q3 AS (SELECT id FROM q2 UNION SELECT id FROM p3),
  p4 AS (SELECT other AS id, min(list_append(path, other)) AS path FROM p3 JOIN step USING (id) WHERE other NOT IN (SELECT id FROM q3) GROUP BY other),
  f AS (SELECT path FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) WHERE id = 'p77'),
  h AS (SELECT unnest(range(1, len(path))) AS i, path FROM f), z AS (SELECT i - 1 AS step, path[i] AS a, path[i + 1] AS b, len(path) - 1 AS hops FROM h),
  r AS (SELECT z.*, e.type, e.confidence, row_number() OVER (PARTITION BY z.step ORDER BY coalesce(w, 0.4) DESC, coalesce(e.confidence, 2.0) DESC, e.type DESC) AS n FROM z JOIN both_ways e ON e.id = z.a AND e.other = z.b LEFT JOIN weights w USING (type))
  SELECT step::INT AS step, a, b, type, confidence, hops::INT AS hops, (SELECT name FROM nodes WHERE id = 'p1') AS source_name, (SELECT name FROM nodes WHERE id = 'p77') AS target_name FROM r WHERE n = 1""")
def _(spark, d):
    return g.shortest_path(nodes(spark, d), edges(spark, d), "p1", "p77")


@query("g04_j11_subgraph_nodes", f"WITH {GRAPH}, {_BOTH}, {_STEP}, {_levels('p5', 2)} SELECT n.id, n.name, n.label, n.module_id, hops FROM s2 JOIN nodes n ON n.id = s2.id WHERE hops = 0 OR module_id IN ('m1','m4')")
def _(spark, d):
    return g.subgraph(nodes(spark, d), edges(spark, d), ["p5"], 2, ["m1", "m4"])[0]


_WALKS = f"""WITH RECURSIVE {GRAPH}, e AS (SELECT DISTINCT src_id, dst_id, type FROM edges WHERE src_id IN (SELECT id FROM nodes) AND dst_id IN (SELECT id FROM nodes)),
  ways AS (SELECT src_id AS id, dst_id AS other, type, true AS o, {{'a': src_id, 'b': dst_id, 't': type}} AS e FROM e UNION ALL SELECT dst_id, src_id, type, false, {{'a': src_id, 'b': dst_id, 't': type}} FROM e WHERE src_id <> dst_id),
  walk AS (SELECT id AS seed, id AS fin, []::STRUCT(other VARCHAR, type VARCHAR, o BOOLEAN)[] AS names, []::STRUCT(a VARCHAR, b VARCHAR, t VARCHAR)[] AS used, 0 AS hops FROM ways WHERE id IN ('p5', 's7') GROUP BY id
    UNION ALL SELECT seed, other, list_append(names, {{'other': other, 'type': type, 'o': o}}), list_append(used, e), hops + 1 FROM walk JOIN ways ON ways.id = fin WHERE hops < 2 AND NOT list_contains(used, e))"""


@query("g04_paths", f"""{_WALKS}, r AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY hops, names)::INT AS rank, hops, names FROM walk WHERE hops > 0) SELECT seed, rank, hops::INT AS hops, array_to_string([x.other || '|' || x.type || '|' || x.o FOR x IN names], ' ') AS path FROM r WHERE rank <= 100""")
def _(spark, d):
    p = g.paths(nodes(spark, d), edges(spark, d), ["p5", "s7"], 2)
    return p.select("seed", "rank", "hops", F.array_join(F.transform("steps", lambda x: F.concat_ws("|", x["other"], x["type"], x["is_outgoing"].cast("string"))), " ").alias("path"))


@query("g04_path_subgraph_of_modules", f"""{_WALKS}, r AS (SELECT seed, names, used, row_number() OVER (PARTITION BY seed ORDER BY hops, names) AS rank FROM walk JOIN nodes ON nodes.id = fin WHERE hops > 0 AND module_id IN ('m1', 'm4'))
  SELECT DISTINCT x.a AS src_id, x.b AS dst_id, x.t AS type FROM (SELECT unnest(used) AS x FROM r WHERE rank <= 100) y""")
def _(spark, d):
    return g.path_subgraph(nodes(spark, d), edges(spark, d), ["p5", "s7"], 2, ["m1", "m4"])[1]


@query("g06_neighbourhood_edges", f"""WITH {GRAPH}, {_BOTH}, {_STEP}, {_levels('p5', 2)} SELECT DISTINCT src_id, dst_id, type FROM edges JOIN s2 a ON a.id = src_id JOIN s2 b ON b.id = dst_id WHERE least(a.hops, b.hops) < 2""")
def _(spark, d):
    return g.subgraph(nodes(spark, d), edges(spark, d), ["p5"], 2)[1]


@query("g07_module_graph", f"""WITH {GRAPH}, m AS (SELECT * FROM nodes WHERE module_id = 'm3' ORDER BY id LIMIT 200)
  SELECT id AS src_id, 'm3' AS dst_id, 'BELONGS_TO_MODULE' AS type FROM m UNION ALL SELECT DISTINCT src_id, dst_id, type FROM edges WHERE src_id IN (SELECT id FROM m) AND dst_id IN (SELECT id FROM m)""")
def _(spark, d):
    return g.module_graph(nodes(spark, d), edges(spark, d), "m3")[1]


@query("g09_cross_module_graph", f"""WITH {GRAPH}, m AS (SELECT * FROM nodes WHERE module_id IN ('m0','m1'))
  SELECT id AS src_id, module_id AS dst_id, 'BELONGS_TO_MODULE' AS type FROM m
  UNION ALL SELECT DISTINCT src_id, dst_id, e.type FROM edges e JOIN m a ON a.id = src_id JOIN m b ON b.id = dst_id WHERE a.module_id <> b.module_id""")
def _(spark, d):
    return g.cross_module_graph(nodes(spark, d), edges(spark, d), ["m0", "m1"])[1]


@query("g10_preview", f"""WITH {GRAPH}, m AS (SELECT * FROM nodes WHERE module_id = 'm1' ORDER BY id LIMIT 500)
  SELECT src_id, dst_id, type, evidence, 'edge_' || (row_number() OVER (ORDER BY src_id, dst_id, type, evidence) - 1) AS edge_id FROM edges WHERE src_id IN (SELECT id FROM m) AND dst_id IN (SELECT id FROM m)""")
def _(spark, d):
    return g.preview(nodes(spark, d), edges(spark, d), "m1", limit=500)[1].drop("confidence")


@query("g13_levels", f"WITH {GRAPH}, {_BOTH}, {_STEP}, {_levels('s1', 8)} SELECT n.id, coalesce(hops, (SELECT max(hops) + 1 FROM s8))::INT AS level FROM nodes n LEFT JOIN s8 ON s8.id = n.id")
def _(spark, d):
    return g.levels(nodes(spark, d), edges(spark, d), "s1")


def _relations(spark, d):
    n = nodes(spark, d)
    return edges(spark, d).join(n.select(F.col("id").alias("src_id"), F.upper("name").alias("source")), "src_id").join(n.select(F.col("id").alias("dst_id"), F.concat(F.lit(" "), "name").alias("target")), "dst_id").select(
        "source", "target", "type", (F.col("confidence") * 2).alias("confidence"), "evidence"
    )


_RELATIONS = "relations AS (SELECT upper(a.name) AS source, ' ' || b.name AS target, e.type, e.confidence * 2 AS confidence, e.evidence FROM edges e JOIN nodes a ON a.id = src_id JOIN nodes b ON b.id = dst_id)"


@query("j15_x25_valid_relations", f"""WITH {GRAPH}, {_RELATIONS}, ids AS (SELECT lower(trim(name)) AS n, max(id) AS id FROM nodes GROUP BY 1)
  SELECT type, count(*) AS n, round(sum(least(1.0, greatest(0.0, confidence))), 4) AS confidence, count(DISTINCT a.id) AS sources, count(DISTINCT b.id) AS targets FROM relations
  JOIN ids a ON a.n = lower(trim(source)) JOIN ids b ON b.n = lower(trim(target)) WHERE {_KNOWN} AND lower(trim(source)) <> lower(trim(target)) GROUP BY type""")
def _(spark, d):
    valid = g.valid_relations(_relations(spark, d), nodes(spark, d))
    return valid.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"), F.countDistinct("src_id").alias("sources"), F.countDistinct("dst_id").alias("targets"))


@query("w01_strongest_relations", f"""WITH {GRAPH}, {_RELATIONS}, x AS (SELECT *, split_part(evidence, '-', 1) AS document FROM relations),
  r AS (SELECT *, row_number() OVER (PARTITION BY document, lower(source) ORDER BY confidence DESC NULLS LAST, target, type, evidence) AS n FROM x),
  q AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY confidence DESC, source, target, type, evidence) AS m FROM r WHERE n <= 10 AND confidence >= 0.3)
  SELECT document, source, confidence FROM q WHERE m <= 50""")
def _(spark, d):
    by_document = _relations(spark, d).withColumn("document", F.substring_index("evidence", "-", 1))
    return g.strongest_relations(by_document, document="document").select("document", "source", "confidence")


@query("w02_best_per_key", f"WITH {GRAPH} SELECT DISTINCT ON (src_id, dst_id) src_id, dst_id, type, confidence, evidence FROM edges ORDER BY src_id, dst_id, confidence DESC NULLS LAST, evidence, type")
def _(spark, d):
    return g.best_per_key(edges(spark, d), ["src_id", "dst_id"], "evidence")


@query("s17_upsert_relations", f"""WITH {GRAPH}, x AS (SELECT src_id, dst_id, type, confidence, evidence, 0 AS ord FROM edges WHERE {_KNOWN} AND evidence LIKE '%-1'
  UNION ALL SELECT src_id, dst_id, CASE WHEN {_KNOWN} THEN type ELSE 'RELATED_TO' END, confidence, evidence, 1 + length(evidence) FROM edges)
  SELECT DISTINCT ON (src_id, type, dst_id) src_id, dst_id, type, confidence, evidence FROM x ORDER BY src_id, type, dst_id, ord DESC, confidence DESC NULLS LAST, evidence DESC""")
def _(spark, d):
    e = edges(spark, d)
    old = e.where(F.col("evidence").endswith("-1") & F.col("type").isin(*g.EDGE_WEIGHTS))
    return g.upsert_relations(old, e.withColumn("ord", F.length("evidence").cast("long")))


def _least_reachable(rounds: int) -> str:
    """The least id within so many hops, round by round; enough rounds reach all of a component, as the last two must agree."""
    steps = ["s AS (SELECT DISTINCT src_id AS a, dst_id AS b FROM edges UNION SELECT DISTINCT dst_id, src_id FROM edges)", "c0 AS (SELECT DISTINCT a AS id, a AS c FROM s)"]
    for i in range(1, rounds + 1):
        steps.append(f"c{i} AS MATERIALIZED (SELECT x.id, least(x.c, min(y.c)) AS c FROM c{i - 1} x JOIN s ON s.a = x.id JOIN c{i - 1} y ON y.id = s.b GROUP BY x.id, x.c)")
    return f"WITH {GRAPH}, {', '.join(steps)} SELECT id, CASE WHEN (SELECT count(*) FROM c{rounds} JOIN c{rounds - 1} z USING (id) WHERE z.c <> c{rounds}.c) = 0 THEN c END AS component FROM c{rounds}"


@query("g17_components", _least_reachable(8))
def _(spark, d):
    return g.connected_components(edges(spark, d).select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")))
