"""Graph layouts and display attributes. Closed forms are expressions; the force-directed layout works on one display graph at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import edge_weight

# Display colours and sizes by type.
COLOURS = {"Module": "#6366f1", "Document": "#3b82f6", "Chunk": "#94a3b8", "Topic": "#f59e0b", "Concept": "#10b981", "Methodology": "#8b5cf6", "Finding": "#ef4444"}
SIZES = {"Module": 40, "Document": 30, "Chunk": 12, "Topic": 25, "Concept": 20, "Methodology": 20, "Finding": 20}
DEFAULT_COLOUR, DEFAULT_SIZE = "#6b7280", 15


def _lookup(table: dict, key: Column, default: object) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for item in table.items() for x in item])[key], F.lit(default))


def decorated(nodes: DataFrame, centre: str | None = None) -> DataFrame:
    """Adds ``colour`` and ``size``; the centre is half as large again."""
    size = _lookup(SIZES, F.col("label"), DEFAULT_SIZE).cast("double")
    if centre is not None:
        size = F.when(F.col("id") == centre, size * 1.5).otherwise(size)
    return nodes.withColumns({"colour": _lookup(COLOURS, F.col("label"), DEFAULT_COLOUR), "size": size})


def circular(nodes: DataFrame, width: float = 1000, height: float = 800, graph: str = "graph") -> DataFrame:
    """On a circle, in order of type and id. Windows are by graph: what is displayed together."""
    w = Window.partitionBy(graph)
    i, n = F.row_number().over(w.orderBy("label", "id")) - 1, F.count(F.lit(1)).over(w)
    angle, r = 2 * math.pi * i / n, 0.4 * min(width, height)
    return nodes.withColumns({"x": width / 2 + r * F.cos(angle), "y": height / 2 + r * F.sin(angle)})


def hierarchical(nodes: DataFrame, layers: list[str], width: float = 1000, height: float = 800, graph: str = "graph") -> DataFrame:
    """One row for each type in ``layers`` (others below), evenly spaced in order of id."""
    layer = F.coalesce(F.create_map(*[F.lit(x) for i, name in enumerate(layers) for x in (name, i)])[F.col("label")], F.lit(len(layers)))
    w = Window.partitionBy(graph, "_layer")
    placed = nodes.withColumn("_layer", layer)
    i, n = F.row_number().over(w.orderBy("id")), F.count(F.lit(1)).over(w)
    return placed.withColumns({"x": width * i / (n + 1), "y": height * (F.col("_layer") + 1) / (len(layers) + 2)}).drop("_layer")


def radial(levels: DataFrame, width: float = 1000, height: float = 800, graph: str = "graph") -> DataFrame:
    """Rings by ``level`` around the centre (level 0), in order of id."""
    w = Window.partitionBy(graph, "level")
    i, n = F.row_number().over(w.orderBy("id")) - 1, F.count(F.lit(1)).over(w)
    outer = F.max("level").over(Window.partitionBy(graph))
    r = 0.45 * min(width, height) * F.col("level") / F.greatest(F.lit(1), outer)
    angle = 2 * math.pi * i / n
    return levels.withColumns({"x": width / 2 + r * F.cos(angle), "y": height / 2 + r * F.sin(angle)})


def force_positions(n: int, pairs: np.ndarray, weights: np.ndarray, width: float, height: float, rounds: int = 100, repulsion: float = 8000.0, spring: float = 0.03, damping: float = 0.9, margin: float = 50.0) -> np.ndarray:
    """From a circle: nodes repel by the inverse square, edges pull in proportion to length and weight; positions stay inside the margin."""
    angle = 2 * math.pi * np.arange(n) / max(1, n)
    at = np.stack([width / 2 + 0.35 * min(width, height) * np.cos(angle), height / 2 + 0.35 * min(width, height) * np.sin(angle)], axis=1)
    speed = np.zeros_like(at)
    for _ in range(rounds):
        apart = at[:, None, :] - at[None, :, :]
        square = np.maximum((apart**2).sum(axis=2), 1.0)
        push = (apart * (repulsion / square / np.sqrt(square))[:, :, None]).sum(axis=1)
        if len(pairs):
            pull = spring * weights[:, None] * (at[pairs[:, 1]] - at[pairs[:, 0]])
            np.add.at(push, pairs[:, 0], pull)
            np.add.at(push, pairs[:, 1], -pull)
        speed = (speed + push) * damping
        at = np.clip(at + speed, margin, [width - margin, height - margin])
    return at


def force_directed(nodes: DataFrame, edges: DataFrame, graph: str = "graph", width: float = 1000, height: float = 800) -> DataFrame:
    """``graph, id, x, y``: one task for each display graph (meant for a few hundred nodes each)."""
    weighted = edges.select(graph, "src_id", "dst_id", edge_weight(F.col("type")).alias("w"))

    def place(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("id", ignore_index=True)
        index = {ident: i for i, ident in enumerate(n["id"])}
        kept = e[e["src_id"].isin(index) & e["dst_id"].isin(index)].sort_values(["src_id", "dst_id", "w"])
        pairs = np.array([kept["src_id"].map(index), kept["dst_id"].map(index)], dtype=int).T.reshape(-1, 2)
        at = force_positions(len(n), pairs, kept["w"].to_numpy(dtype=float), width, height)
        return pd.DataFrame({graph: n[graph], "id": n["id"], "x": at[:, 0], "y": at[:, 1]})

    kind = nodes.schema[graph].dataType.simpleString()
    return nodes.select(graph, "id").groupBy(graph).cogroup(weighted.groupBy(graph)).applyInPandas(place, f"{graph} {kind}, id string, x double, y double")
