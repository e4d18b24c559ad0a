"""Graph algorithms as frontier loops over DataFrames; state is cut to the shared folder every round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession, kind: str) -> str:
    """A new path of this kind in the checkpoint folder that all executors share."""
    sc = spark.sparkContext
    if not (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loom-"))
    return f"{sc.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back: survives lost executors and ends its lineage."""
    spark, path = df.sparkSession, shared(df.sparkSession, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth): nodes reached from start (id) over directed edges (u, v), at their least depth."""
    seen = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(edges, front.id == edges.u).select(F.col("v").alias("id")).distinct()
        front = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def trace_path(edges: DataFrame, source: str, target: str, depth: int = 5) -> DataFrame:
    """(hop, id, relation_type): one shortest path; of several, edges of better priority on the earliest hops win.

    edges has (u, v, relation_type, priority). A new node keeps the parent first in the queue, then edge priority,
    then its own order: what a first-in first-out search with sorted neighbours finds.
    """
    spark = edges.sparkSession
    e = edges.where("u <> v").groupBy("u", "v").agg(F.min(F.struct("priority", "relation_type")).alias("e"))
    front = spark.createDataFrame([(source, 1)], "id string, ord long")
    seen, levels, hit = front.select("id"), [], source == target
    for _ in range(max(1, min(depth, 20))):
        if hit:
            break
        step = front.join(e, front.id == e.u).select("ord", F.col("u").alias("parent"), F.col("v").alias("id"), "e.priority", "e.relation_type")
        step = step.join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct("ord", "priority", "parent", "relation_type")).alias("b"))
        front = cut(step.select("id", "b.parent", "b.relation_type", F.row_number().over(Window.orderBy("b.ord", "b.priority", "id")).cast("long").alias("ord")))
        levels.append(front)
        if front.isEmpty():
            break
        hit = not front.where(F.col("id") == target).isEmpty()
        seen = seen.unionByName(front.select("id"))
    path, at = [], target
    if hit:
        for level in reversed(levels):
            row = level.where(F.col("id") == at).first()
            path.append((at, row.relation_type))
            at = row.parent
        path.append((source, None))
    return spark.createDataFrame([(i, n, r) for i, (n, r) in enumerate(reversed(path))], "hop int, id string, relation_type string")


def closure(edges: DataFrame) -> DataFrame:
    """(u, v): transitive closure, to the fixpoint whatever its depth; cycles end by the anti-join.

    A round joins the newest pairs to all pairs, so path lengths double and a chain of n edges takes log2(n) rounds.
    """
    every = new = cut(edges.select("u", "v").distinct())
    while True:
        step = new.join(every.withColumnsRenamed({"u": "m", "v": "w"}), F.col("v") == F.col("m")).select("u", F.col("w").alias("v")).distinct()
        new = cut(step.join(every, ["u", "v"], "left_anti"))
        if new.isEmpty():
            return every
        every = every.unionByName(new)


def orphans(entities: DataFrame, rels: DataFrame, key: str = "id") -> DataFrame:
    ends = rels.select(F.explode(F.array("source_id", "target_id")).alias(key)).distinct()
    return entities.join(ends, key, "left_anti")


def prunable(entities: DataFrame, rels: DataFrame, keep: DataFrame | None = None, entry_points: bool = True, exports: bool = True, key: str = "entity_id") -> DataFrame:
    """Entities without an edge that may go: not in keep (key), no entry point, not exported, no external symbol but stubs.

    entities has entity_type and is_exported; the flags let entry points or exported ones go too.
    """
    stays = (F.col("entity_type") == "EXTERNAL_SYMBOL") & ~F.startswith(key, F.lit("unresolved:"))
    if entry_points:
        stays |= F.col("entity_type") == "ENTRY_POINT"
    if exports:
        stays |= F.coalesce("is_exported", F.lit(False))
    out = orphans(entities.where(~F.coalesce(stays, F.lit(False))), rels, key)
    return out.join(keep.select(key), key, "left_anti") if keep else out


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id reached. Min labels, each round doubled by looking up the label's own label."""
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("c")))
    while True:
        near = both.join(label, F.col("v") == F.col("id")).groupBy("u").agg(F.min("c").alias("m"))
        one = label.join(near, F.col("id") == F.col("u")).select("id", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        jump = label.select(F.col("id").alias("j"), F.col("c").alias("jc"))
        new = cut(one.join(jump, F.col("c") == F.col("j"), "left").select("id", F.least("c", F.coalesce("jc", "c")).alias("c"), "was"))
        moved = not new.where("c <> was").isEmpty()
        label = new.select("id", "c")
        if not moved:
            return label.select("id", F.col("c").alias("component"))


def cycles(edges: DataFrame, longest: int = 8) -> DataFrame:
    """(relation_type, nodes): every simple cycle of one relation with up to `longest` nodes, from its smallest node on.

    edges: (u, v, relation_type). A node that refers to itself is a cycle, but not for IMPORTS. A path starts at the
    smallest node of its cycle and grows through larger ones only, so each cycle is found once, in its least rotation.
    Edges that lie on no cycle are peeled off first: those from nodes nothing leads to and to nodes that lead nowhere.
    """
    e = cut(edges.select("relation_type", "u", "v").distinct())
    own = e.where("u = v and relation_type <> 'IMPORTS'").select("relation_type", F.array("u").alias("nodes"))
    live, n = e.where("u <> v"), -1
    while True:
        inner = live.join(live.select("relation_type", F.col("v").alias("u")).distinct(), ["relation_type", "u"], "left_semi")
        inner = cut(inner.join(live.select("relation_type", F.col("u").alias("v")).distinct(), ["relation_type", "v"], "left_semi").select("relation_type", "u", "v"))
        live, was, n = inner, n, inner.count()
        if n in (0, was):
            break
    found, paths = own, live.where("u < v").select("relation_type", F.array("u", "v").alias("nodes"))
    for size in range(2, longest + 1):
        paths = cut(paths)
        if paths.isEmpty():
            break
        tip = paths.withColumn("u", F.element_at("nodes", -1)).join(live, ["relation_type", "u"])
        found = found.unionByName(tip.where(F.col("v") == F.element_at("nodes", 1)).select("relation_type", "nodes"))
        paths = tip.where((F.col("v") > F.element_at("nodes", 1)) & ~F.array_contains("nodes", F.col("v"))).select("relation_type", F.concat("nodes", F.array("v")).alias("nodes"))
    return found
