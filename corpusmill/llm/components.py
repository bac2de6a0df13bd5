"""Connected components by contraction, each step a join on a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't the smallest of its component; root is the smallest.

    Every node points to its smallest neighbour below it, pointers are doubled until
    they reach a root, and edges between roots are the next step's.  Both loops end
    after a number of steps that is logarithmic for stars and trees of pointers.  What is
    written is under ``name``, and goes when the next step has superseded it.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges, found, step = ws.save(edges, f"{name}/e0"), None, 0
    while not edges.isEmpty():
        pointer, hop = ws.save(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), f"{name}/p{step}-0"), 0
        while True:
            up = pointer.select(F.col("node").alias("root"), F.col("root").alias("above"))
            hop += 1
            moved = ws.save(pointer.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), f"{name}/p{step}-{hop}")
            pointer = moved.select("node", "root")
            ws.drop(f"{name}/p{step}-{hop - 1}")
            if moved.where("moved").isEmpty():
                break
        found = pointer if found is None else relabel(found, pointer).unionByName(pointer)
        found = ws.save(found, f"{name}/f{step}")
        if step:
            ws.drop(f"{name}/f{step - 1}")
        step += 1
        a = relabel(edges.select(F.col("a").alias("root"), F.col("b").alias("node")), pointer).select(F.col("root").alias("a"), F.col("node").alias("root"))
        b = relabel(a.select("root", F.col("a").alias("node")), pointer)
        edges = ws.save(b.select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b")).where("a <> b").distinct(), f"{name}/e{step}")
        for old in (f"{name}/e{step - 1}", f"{name}/p{step - 1}-{hop}"):
            ws.drop(old)
    if found is None:
        found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def relabel(found: DataFrame, pointer: DataFrame) -> DataFrame:
    """``found`` with each root replaced by what it points to."""
    up = pointer.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return found.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
