"""Graph operators over ``nodes (id, label, name, module_id)`` and ``edges (src_id, dst_id, type, confidence)``.

Traversals are frontier joins: each round joins the frontier with the edges, and depth is at most four. Results of a round are
cut off from their lineage by a table in the session's shared folder.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import DEFAULT_EDGE_TYPE, EDGE_WEIGHTS, by_confidence, certain, edge_weight

MAX_DEPTH = 4


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine, whose master is ``local``, may do without: it gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quillgraph-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: later rounds and lost executors read it instead of repeating what led to it.

    Written once; a checkpoint would compute ``df`` a second time.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    """``id, other, type, confidence, is_outgoing``: each edge seen from either end."""
    out = edges.select(F.col("src_id").alias("id"), F.col("dst_id").alias("other"), "type", "confidence", F.lit(True).alias("is_outgoing"))
    back = edges.select(F.col("dst_id").alias("id"), F.col("src_id").alias("other"), "type", "confidence", F.lit(False).alias("is_outgoing"))
    return out.unionByName(back)


# --- look-ups and membership --------------------------------------------------------------------------------------


def by_id(nodes: DataFrame, ident: str) -> DataFrame:
    """The entity of this id (the smallest label, should several have it)."""
    return nodes.where(F.col("id") == ident).orderBy("label").limit(1)


def by_name(nodes: DataFrame, text: str, module: str | None = None, limit: int = 20) -> DataFrame:
    """Entities whose name contains the text in any case, those mentioned most first (unknown counts before all)."""
    found = nodes.where(F.lower("name").contains(text.lower()))
    if module is not None:
        found = found.where(F.col("module_id") == module)
    return found.orderBy(F.col("mention_count").desc_nulls_first(), "name", "id").limit(limit)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select(*edges.columns)


def orphans(nodes: DataFrame, *edge_tables: DataFrame) -> DataFrame:
    """Nodes that no edge of any of the tables touches."""
    for edges in edge_tables:
        nodes = nodes.join(edges.select(F.col("src_id").alias("id")), "id", "left_anti").join(edges.select(F.col("dst_id").alias("id")), "id", "left_anti")
    return nodes


def duplicates(nodes: DataFrame) -> DataFrame:
    """Names that several nodes have, with their ids."""
    return nodes.groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)


def degrees(edges: DataFrame, limit: int = 20) -> DataFrame:
    ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(limit)


def counts_by_label(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def counts_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def module_stats(nodes: DataFrame, edges: DataFrame, module: str) -> DataFrame:
    """``kind, type, n`` for nodes and (induced) edges of a module, with totals (type null); no rows for a module without nodes."""
    mine = nodes.where(F.col("module_id") == module)
    n = mine.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), F.col("label").alias("type"), "n")
    e = counts_by_type(induced(edges, mine)).select(F.lit("edge").alias("kind"), "type", "n")
    parts = n.unionByName(e)
    totals = parts.groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit(None).cast("string").alias("type"), "n")
    return parts.unionByName(totals)


def filter_nodes(nodes: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, chunks: bool = True, documents: bool = True, max_nodes: int = 500) -> DataFrame:
    keep = F.lit(True)
    if include:
        keep = keep & F.col("label").isin(*include)
    if exclude:
        keep = keep & ~F.col("label").isin(*exclude)
    if not chunks:
        keep = keep & (F.col("label") != "Chunk")
    if not documents:
        keep = keep & (F.col("label") != "Document")
    return nodes.where(keep).orderBy("id").limit(max_nodes)


def filter_edges(edges: DataFrame, nodes: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    kept = edges
    if include:
        kept = kept.where(F.col("type").isin(*include))
    if exclude:
        kept = kept.where(~F.col("type").isin(*exclude))
    return induced(kept, nodes)


# --- neighbours, expansion, paths ---------------------------------------------------------------------------------


def path_weight(kind: Column, hops: Column, confidence: Column) -> Column:
    return edge_weight(kind) * (F.lit(1.0) / hops) * certain(confidence)


def neighbours(nodes: DataFrame, edges: DataFrame, ident: str, types: list[str] | None = None, direction: str = "both", limit: int = 50) -> DataFrame:
    """Neighbours of one entity over the known edge types, unknown confidence first."""
    rows = both_ways(edges.where(F.col("type").isin(*(types or EDGE_WEIGHTS)))).where(F.col("id") == ident)
    if direction != "both":
        rows = rows.where(F.col("is_outgoing") == (direction == "outgoing"))
    named = rows.drop("id").join(nodes.select(F.col("id").alias("other"), "name", "label"), "other")
    ordered = named.orderBy(by_confidence(), "other", "type", F.desc("is_outgoing")).limit(limit)
    return ordered.select(F.col("other").alias("id"), "name", "label", "type", "confidence", edge_weight(F.col("type")).alias("weight"), "is_outgoing")


def expand_context(nodes: DataFrame, edges: DataFrame, seeds: list[str], depth: int = 2, modules: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Targets one or two outgoing hops from the seeds (deeper counts as two), scored by the weight of their last edge.

    A target two hops off is no seed; one hop off it may be one. Of several ways to a target the first counts: fewer hops, then
    confidence (unknown first).
    """
    known = edges.where(F.col("type").isin(*EDGE_WEIGHTS)).select("src_id", "dst_id", "type", "confidence")
    first = known.where(F.col("src_id").isin(*seeds))
    one = first.select(F.col("dst_id").alias("id"), "type", "confidence", F.lit(1).alias("hops"))
    ways = one
    if depth >= 2:
        middle = first.select(F.col("dst_id").alias("src_id")).distinct()
        two = known.join(middle, "src_id").where(~F.col("dst_id").isin(*seeds))
        ways = one.unionByName(two.select(F.col("dst_id").alias("id"), "type", "confidence", F.lit(2).alias("hops")))
    targets = nodes if modules is None else nodes.where(F.col("module_id").isin(*modules) | F.col("module_id").isNull())
    ways = ways.join(targets.select("id", "name", "label"), "id")
    arrival = Window.partitionBy("id").orderBy("hops", by_confidence(), "type")
    best = ways.withColumn("_r", F.row_number().over(arrival)).where("_r = 1")
    score = F.round(path_weight(F.col("type"), F.col("hops"), F.col("confidence")), 4)
    return best.withColumn("relevance", score).orderBy(F.desc("relevance"), "id").limit(limit).select("id", "name", "label", "type", "hops", "relevance")


def steps(edges: DataFrame) -> DataFrame:
    """``id, other``: each pair of neighbours in both directions once, settled: every round of a traversal reads it again."""
    return settled(both_ways(edges).select("id", "other").distinct())


def bfs(edges: DataFrame, start: list[str], depth: int | None = None) -> DataFrame:
    """``id, hops`` of every node within ``depth`` undirected hops of the start (all that can be reached if it is None).

    A node next to one that is ``hops`` off is ``hops - 1`` off at least, so a round needs to leave out the last two frontiers alone.
    """
    spark = edges.sparkSession
    step = both_ways(edges).select("id", "other") if depth == 1 else steps(edges)
    before = spark.createDataFrame([], "id string")
    frontier = spark.createDataFrame([(s,) for s in dict.fromkeys(start)], "id string")
    found, hops = [frontier.withColumn("hops", F.lit(0))], 0
    while depth is None or hops < depth:
        hops += 1
        reached = step.join(frontier, "id", "left_semi").select(F.col("other").alias("id")).distinct()
        last = before.unionByName(frontier)
        before, frontier = frontier, settled(reached.join(last, "id", "left_anti"))
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("hops", F.lit(hops)))
    return union_all(found)


def levels(nodes: DataFrame, edges: DataFrame, centre: str) -> DataFrame:
    """``id, level``: hops from the centre; what cannot be reached lies one level beyond the last."""
    reached = bfs(edges, [centre])
    last = reached.agg((F.max("hops") + 1).alias("_beyond"))
    return nodes.select("id").join(reached, "id", "left").join(F.broadcast(last)).select("id", F.coalesce("hops", "_beyond").alias("level"))


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, max_hops: int = 4) -> DataFrame:
    """The shortest undirected path of four edges at most, one row an edge; of equally short ones that whose ids sort first.

    Both ends are searched in turn, the one with the smaller frontier first, until their frontiers meet. What lies on shortest paths is then found from the
    meeting nodes outwards, and the path that sorts first among these nodes alone; rounds carry ids, no paths.
    """
    spark = edges.sparkSession
    pairs = steps(edges)
    sides = [[spark.createDataFrame([(end,)], "id string")] for end in (source, target)]
    sizes = [1, 1]

    def between(left: DataFrame, right: DataFrame) -> DataFrame:
        """Of ``left`` what has a neighbour in ``right``."""
        near = pairs.join(right.withColumnRenamed("id", "other"), "other", "left_semi").select("id").distinct()
        return settled(left.join(near, "id", "left_semi"))

    layers: list[DataFrame] = []
    for _ in range(min(max_hops, MAX_DEPTH) if source != target else 0):
        at = 0 if sizes[0] <= sizes[1] else 1
        side = sides[at]
        reached = pairs.join(side[-1], "id", "left_semi").select(F.col("other").alias("id")).distinct()
        side.append(settled(reached.join(union_all(side[-2:]), "id", "left_anti")))  # older frontiers are no neighbours of the last
        sizes[at] = side[-1].count()
        meeting = settled(sides[0][-1].join(sides[1][-1], "id", "left_semi"))
        if not meeting.isEmpty():
            layers = [meeting]
            for frontier in sides[0][-2::-1]:
                layers.insert(0, between(frontier, layers[0]))
            for frontier in sides[1][-2::-1]:
                layers.append(between(frontier, layers[-1]))
            break
        if not sizes[at]:
            break
    found = spark.createDataFrame([], "path array<string>")
    if layers:
        best = layers[-1].select("id", F.array("id").alias("path"))
        for layer in layers[-2::-1]:
            on = pairs.join(layer, "id", "left_semi").join(best.withColumnRenamed("id", "other"), "other")
            best = settled(on.groupBy("id").agg(F.min("path").alias("path")).select("id", F.concat(F.array("id"), "path").alias("path")))
        found = best.select("path")
    hops = found.select("path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("step", "a"))
    ends = hops.select("a", F.element_at("path", F.col("step") + 2).alias("b"), "step", (F.size("path") - 1).alias("hops"))
    # of parallel edges the one with the highest weight, and then confidence, stands for the step
    between = both_ways(edges).withColumn("w", edge_weight(F.col("type")))
    best = ends.join(between.select(F.col("id").alias("a"), F.col("other").alias("b"), "type", "confidence", "w"), ["a", "b"])
    chosen = best.groupBy("step", "a", "b", "hops").agg(F.max_by(F.struct("type", "confidence"), F.struct("w", F.coalesce("confidence", F.lit(2.0)), "type")).alias("e"))
    names = nodes.where(F.col("id").isin(source, target)).agg(
        F.max(F.when(F.col("id") == source, F.col("name"))).alias("source_name"), F.max(F.when(F.col("id") == target, F.col("name"))).alias("target_name")
    )
    return chosen.join(F.broadcast(names)).select("step", "a", "b", "e.type", "e.confidence", "hops", "source_name", "target_name")


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: list[str], depth: int = 2, modules: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` hops of the seeds (far ends optionally of some modules only, seeds always) and the distinct edges walked.

    An edge is walked if its nearer end lies less than ``depth`` hops off.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    reached = bfs(edges, seeds, depth)
    far = nodes.join(reached, "id")
    if modules is not None:
        far = far.where((F.col("hops") == 0) | F.col("module_id").isin(*modules))
    ends = reached.select("id", "hops")
    walked = edges.join(ends.select(F.col("id").alias("src_id"), F.col("hops").alias("_s")), "src_id").join(ends.select(F.col("id").alias("dst_id"), F.col("hops").alias("_d")), "dst_id")
    walked = walked.where(F.least("_s", "_d") < depth).select("src_id", "dst_id", "type").distinct()
    return far, induced(walked, far)


def paths(nodes: DataFrame, edges: DataFrame, seeds: list[str], depth: int = 2, modules: list[str] | None = None, limit: int = 100) -> DataFrame:
    """``seed, rank, hops, steps, used``: for each seed its first ``limit`` undirected paths of up to ``depth`` edges without a repeated edge.

    Paths are ordered by length, then step by step by node, type and direction, so that the limit always chooses the same ones. Their far end is one of ``nodes`` (of the
    modules, or of none, if modules are given); what lies between may be anything that the edges touch. ``steps`` holds ``other, type, is_outgoing``, ``used`` the edges.

    Without modules edges are those between ``nodes``. Every path then counts, so a seed's frontier never needs more than ``limit`` paths, and of a node's edges
    only the first ``limit + depth`` can ever be chosen. With modules a path may only count once it is longer: all are carried on, up to the depth of four.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    far = nodes if modules is None else nodes.where(F.col("module_id").isin(*modules) | F.col("module_id").isNull())
    far = far.select(F.col("id").alias("end")).distinct()
    kept = edges.select("src_id", "dst_id", "type")
    known = nodes.select("id").distinct()
    step = F.struct("other", "type", "is_outgoing")
    edge = F.when(F.col("is_outgoing"), F.struct(F.col("id").alias("src_id"), F.col("other").alias("dst_id"), "type")).otherwise(F.struct(F.col("other").alias("src_id"), F.col("id").alias("dst_id"), "type"))

    def ways_from(frontier: DataFrame) -> DataFrame:
        """The different edges at the ends of the frontier's paths: of all others nothing is shuffled or written."""
        at = frontier.select(F.col("end").alias("id")).distinct()
        out = kept.join(at.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select(F.col("src_id").alias("id"), F.col("dst_id").alias("other"), "type", F.lit(True).alias("is_outgoing"))
        back = kept.join(at.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select(F.col("dst_id").alias("id"), F.col("src_id").alias("other"), "type", F.lit(False).alias("is_outgoing"))
        there = out.unionByName(back.where(F.col("id") != F.col("other"))).distinct()
        if modules is None:
            there = there.join(known, "id", "left_semi").join(known.withColumnRenamed("id", "other"), "other", "left_semi")
        there = there.select("id", F.col("other").alias("next"), step.alias("step"), edge.alias("edge"))
        if modules is None:
            first = Window.partitionBy("id").orderBy("step")
            there = there.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limit + depth).drop("_r")
        return there

    spark = edges.sparkSession
    start = spark.createDataFrame([(x,) for x in dict.fromkeys(seeds)], "seed string").join(nodes.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi")
    start = settled(start)
    step_type, edge_type = "struct<other:string,type:string,is_outgoing:boolean>", "struct<src_id:string,dst_id:string,type:string>"
    frontier = start.select("seed", F.col("seed").alias("end"), F.expr(f"cast(array() as array<{step_type}>)").alias("steps"), F.expr(f"cast(array() as array<{edge_type}>)").alias("used"))
    left = start.withColumn("left", F.lit(limit))
    found = []
    for hops in range(1, depth + 1):
        longer = frontier.join(ways_from(frontier), F.col("end") == F.col("id")).where(~F.array_contains("used", F.col("edge")))
        longer = longer.select("seed", F.col("next").alias("end"), F.concat("steps", F.array("step")).alias("steps"), F.concat("used", F.array("edge")).alias("used")).join(left, "seed")
        counted = longer if modules is None else longer.join(far, "end", "left_semi")
        order = Window.partitionBy("seed").orderBy("steps")
        chosen = settled(counted.withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.col("left")))
        found.append(chosen.select("seed", (F.lit(limit) - F.col("left") + F.col("n")).cast("int").alias("rank"), F.lit(hops).alias("hops"), "steps", "used"))
        if hops == depth:
            break
        frontier = (chosen if modules is None else settled(longer)).select("seed", "end", "steps", "used")
        taken = chosen.groupBy("seed").agg(F.count(F.lit(1)).alias("taken"))
        left = settled(left.join(taken, "seed", "left").select("seed", (F.col("left") - F.coalesce("taken", F.lit(0))).cast("int").alias("left")).where("left > 0"))
        if left.isEmpty():
            break
    return union_all(found)


def path_subgraph(nodes: DataFrame, edges: DataFrame, seeds: list[str], depth: int = 2, modules: list[str] | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The distinct nodes and edges (``src_id, dst_id, type``) of the seeds' first paths."""
    chosen = settled(paths(nodes, edges, seeds, depth, modules, limit))
    touched = chosen.select("seed", F.explode("steps.other").alias("id"))
    ids = touched.select("id").unionByName(touched.select(F.col("seed").alias("id"))).distinct()
    return nodes.join(ids, "id", "left_semi"), chosen.select(F.explode("used").alias("e")).select("e.*").distinct()


def preview(nodes: DataFrame, edges: DataFrame, module: str, types: list[str] | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first entities of a module and their edges, numbered for display."""
    from ..model import ANALYTIC_TYPES

    if not 1 <= limit <= 500:
        raise ValueError("a preview has 1 to 500 nodes")
    if unknown := set(types or ()) - set(ANALYTIC_TYPES):
        raise ValueError(f"unknown types: {sorted(unknown)}")
    shown = nodes.where((F.col("module_id") == module) & F.col("label").isin(*(types or ANALYTIC_TYPES))).orderBy("id").limit(limit)
    kept = induced(edges, shown)
    # at most 500 nodes: the numbering is over their edges alone
    number = F.row_number().over(Window.orderBy("src_id", "dst_id", "type", "evidence")) - 1
    return shown, kept.withColumn("edge_id", F.concat(F.lit("edge_"), number.cast("string")))


def module_graph(nodes: DataFrame, edges: DataFrame, module: str, max_entities: int = 200) -> tuple[DataFrame, DataFrame]:
    """The module, its first entities, membership edges and induced edges."""
    members = nodes.where(F.col("module_id") == module).orderBy("id").limit(max_entities)
    head = nodes.sparkSession.range(1).select(F.lit(module).alias("id"), F.lit("Module").alias("label"), F.lit(module).alias("name"), F.lit(module).alias("module_id"))
    belongs = members.select(F.col("id").alias("src_id"), F.lit(module).alias("dst_id"), F.lit("BELONGS_TO_MODULE").alias("type"))
    return head.unionByName(members.select("id", "label", "name", "module_id")), belongs.unionByName(induced(edges, members).select("src_id", "dst_id", "type").distinct())


def cross_module_graph(nodes: DataFrame, edges: DataFrame, modules: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities of several modules, their memberships, and the edges between different modules."""
    members = nodes.where(F.col("module_id").isin(*modules))
    belongs = members.select(F.col("id").alias("src_id"), F.col("module_id").alias("dst_id"), F.lit("BELONGS_TO_MODULE").alias("type"))
    side = members.select("id", "module_id")
    crossing = (
        edges.join(side.select(F.col("id").alias("src_id"), F.col("module_id").alias("_s")), "src_id")
        .join(side.select(F.col("id").alias("dst_id"), F.col("module_id").alias("_d")), "dst_id")
        .where("_s <> _d")
        .select("src_id", "dst_id", "type")
        .distinct()
    )
    return members.dropDuplicates(["id"]), belongs.unionByName(crossing)


def document_graph(documents: DataFrame, chunks: DataFrame, mentions: DataFrame, document: str, with_chunks: bool = True) -> tuple[DataFrame, DataFrame]:
    """One document, its chunks (optional) and entities; edges exist only where chunks are shown."""
    doc = documents.where(F.col("id") == document).select("id", F.lit("Document").alias("label"))
    parts = chunks.where(F.col("document_id") == document).select("id")
    found = mentions.join(parts.withColumnRenamed("id", "chunk_id"), "chunk_id")
    things = found.select(F.col("entity_id").alias("id")).distinct().withColumn("label", F.lit("Entity"))
    if not with_chunks:
        empty = found.select(F.col("chunk_id").alias("src_id"), F.col("entity_id").alias("dst_id"), F.lit("CONTAINS_ENTITY").alias("type")).limit(0)
        return doc.unionByName(things), empty
    has = parts.select(F.lit(document).alias("src_id"), F.col("id").alias("dst_id"), F.lit("HAS_CHUNK").alias("type"))
    contains = found.select(F.col("chunk_id").alias("src_id"), F.col("entity_id").alias("dst_id"), F.lit("CONTAINS_ENTITY").alias("type")).distinct()
    return doc.unionByName(parts.withColumn("label", F.lit("Chunk"))).unionByName(things), has.unionByName(contains)


# --- edges from relations -----------------------------------------------------------------------------------------


def known_type(kind: Column) -> Column:
    return F.when(kind.isin(*EDGE_WEIGHTS), kind).otherwise(DEFAULT_EDGE_TYPE)


def resolve_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations by name to edges by id: both ends must exist, in any case; of several nodes with a name the last id counts."""
    ids = nodes.groupBy(F.lower(F.trim("name")).alias("_name")).agg(F.max("id").alias("_id"))
    a = ids.select(F.col("_name").alias("_source"), F.col("_id").alias("src_id"))
    b = ids.select(F.col("_name").alias("_target"), F.col("_id").alias("dst_id"))
    rows = relations.withColumns({"_source": F.lower(F.trim("source")), "_target": F.lower(F.trim("target"))})
    return rows.join(a, "_source").join(b, "_target").drop("_source", "_target")


def upsert_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old edges and new ones, one for each (source, type, target): the last in ``ord`` wins, evidence is cut to 300 characters."""
    fresh = new.select("src_id", "dst_id", known_type(F.col("type")).alias("type"), "confidence", F.substring("evidence", 1, 300).alias("evidence"), (F.col("ord") + 1).alias("ord"))
    rows = old.select("src_id", "dst_id", "type", "confidence", "evidence", F.lit(0).cast("long").alias("ord")).unionByName(fresh)
    last = rows.groupBy("src_id", "type", "dst_id").agg(F.max(F.struct("ord", "confidence", "evidence")).alias("e"))
    return last.select("src_id", "dst_id", "type", "e.confidence", "e.evidence")


def valid_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations between two known, different names and of a known type; confidence within [0, 1], evidence cut."""
    source, target = F.lower(F.trim("source")), F.lower(F.trim("target"))
    ok = (source != "") & (target != "") & (source != target) & F.col("type").isin(*EDGE_WEIGHTS)
    kept = resolve_relations(relations.where(ok), nodes)
    return kept.withColumns({"confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence")), "evidence": F.substring("evidence", 1, 300)})


def strongest_relations(relations: DataFrame, per_source: int = 10, min_confidence: float = 0.3, per_document: int = 50, document: str | None = None) -> DataFrame:
    """In each document each source's relations of highest confidence, then those certain enough, then the first of them. Without ``document``: one document."""
    doc = [document] if document else []
    by_source = Window.partitionBy(*doc, F.lower("source")).orderBy(F.desc("confidence"), "target", "type")
    top = relations.withColumn("_r", F.row_number().over(by_source)).where((F.col("_r") <= per_source) & (F.col("confidence") >= min_confidence)).drop("_r")
    order = [F.desc("confidence"), "source", "target", "type"]
    if not document:
        return top.orderBy(*order).limit(per_document)
    return top.withColumn("_r", F.row_number().over(Window.partitionBy(document).orderBy(*order))).where(F.col("_r") <= per_document).drop("_r")


def best_per_key(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The row of highest confidence for each key; the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc("confidence"), order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _number(node: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), node)


def _either_way(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(pairs.select(F.col(b).alias("u"), F.col(a).alias("v")))


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, u, at`` (an id's number, and the least number among its own and its neighbours') and the pairs by numbers ``u, v``.

    Links then are two longs, whatever the ids. No two ids share a number: where they would, other numbers are tried.
    """
    ends = _either_way(pairs, "a", "b")
    kind = ends.schema["u"].dataType
    for seed in count():
        near = ends.groupBy(F.col("u").alias("id")).agg(F.min(_number(F.col("v"), seed)).alias("_near"))
        numbers = settled(near.withColumn("u", _number(F.col("id"), seed)).select("id", "u", F.least("u", "_near").alias("at")))
        if numbers.groupBy("u").count().where("count > 1").isEmpty():
            return numbers, pairs.select(_number(F.col("a").cast(kind), seed).alias("u"), _number(F.col("b").cast(kind), seed).alias("v"))


def _contracted(links: DataFrame, moves: DataFrame) -> DataFrame:
    """The different links ``u, v`` between the nodes ``at`` to which their ends move; those within one node are gone."""
    moved = links.join(moves, "u").select("v", F.col("at").alias("_u")).join(moves.withColumnRenamed("u", "v"), "v")
    return settled(moved.where(F.col("_u") != F.col("at")).select(F.least("_u", "at").alias("u"), F.greatest("_u", "at").alias("v")).distinct())


def connected_components(pairs: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable over pairs ``a, b``; a pair with a missing end links nothing.

    Randomised contraction: each node moves to the first in order among itself and its neighbours, and the next round has the nodes moved to and the links that still lie between
    them. Only the first round reads all pairs. A random order leaves three quarters of the nodes at most on average, and links never become more. Moves are then
    followed from the last round back to the first.
    """
    numbers, links = _numbered(settled(pairs.select("a", "b").where("a is not null and b is not null")))
    moves = [numbers.select("u", "at")]
    while not (links := _contracted(links, moves[-1])).isEmpty():
        # an order serves two rounds, the numbers the first two: once a hub has moved to the first of its neighbours, all others follow
        order = len(moves) // 2
        rank = (lambda node: _number(F.col(node), order)) if order else F.col
        near = _either_way(links, "u", "v").groupBy("u").agg(F.min_by("v", rank("v")).alias("_near"))
        moves.append(settled(near.select("u", F.when(rank("_near") < rank("u"), F.col("_near")).otherwise(F.col("u")).alias("at"))))
    ends = moves.pop()
    while moves:
        ends = settled(moves.pop().join(ends.select(F.col("u").alias("at"), F.col("at").alias("_end")), "at", "left").select("u", F.coalesce("_end", "at").alias("at")))
    found = numbers.select("id", "u").join(ends, "u")
    return settled(found.join(found.groupBy("at").agg(F.min("id").alias("component")), "at").select("id", "component"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all batches, one after the other: the lists of extraction results by category."""
    return reduce(DataFrame.unionByName, frames)


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    """The different rows of several scans, as of one label each."""
    return union_all(frames).distinct()


def distinct_ids(batches: list[DataFrame], key: str = "id") -> DataFrame:
    """Each id once that any batch's result names; missing ids are none."""
    return union_all([b.select(key) for b in batches]).where(F.col(key).isNotNull()).distinct()
