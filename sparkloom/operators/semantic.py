"""Semantic tags from name tokens, and the edges that pairs of tags imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import name_tokens
from . import graph


def tag(entities: DataFrame, tokens: dict[str, set[str]], types: dict[str, set[str]] | None = None) -> DataFrame:
    """entities with `tags`: each tag whose token set meets the name's or path's tokens, where its types allow it."""
    seen = F.array_union(name_tokens(F.col("name")), name_tokens(F.col("file_path")))
    marks = []
    for name in sorted(tokens):
        ok = F.arrays_overlap(F.col("_seen"), F.array(*[F.lit(w) for w in sorted(tokens[name])]))
        if types and name in types:
            ok &= F.col("entity_type").isin(*sorted(types[name]))
        marks.append(F.when(ok, name))
    return entities.withColumn("_seen", seen).withColumn("tags", F.array_compact(F.array(*marks))).drop("_seen")


def implied_edges(rels: DataFrame, tags: DataFrame, rules: list[tuple[str | None, str | None, str]]) -> DataFrame:
    """Edges (source_id, target_id, relation_type) that are new: for each (source tag, target tag, type), None is any.

    tags: (id, tags). Only CALLS, IMPORTS and USES imply; self-edges and edges already there are left out.
    """
    base = rels.where("relation_type in ('CALLS', 'IMPORTS', 'USES') and source_id <> target_id").select("source_id", "target_id").distinct()
    e = base.join(tags.select(F.col("id").alias("source_id"), F.col("tags").alias("a")), "source_id").join(tags.select(F.col("id").alias("target_id"), F.col("tags").alias("b")), "target_id")
    kinds = [F.when((F.array_contains("a", s) if s else F.lit(True)) & (F.array_contains("b", d) if d else F.lit(True)), kind) for s, d, kind in rules]
    made = e.select("source_id", "target_id", F.explode(F.array_distinct(F.array_compact(F.array(*kinds)))).alias("relation_type"))
    return made.join(rels.select("source_id", "target_id", "relation_type").distinct(), ["source_id", "target_id", "relation_type"], "left_anti")


def tested_by(tests: DataFrame, targets: DataFrame, direct: DataFrame, most: int = 50) -> DataFrame:
    """(test, target, confidence): targets a test is named after, `most` first by id; 0.85 where an edge links them, else 0.65.

    tests: (test, base); targets: (target, base); direct: (test, target). A base's first `most` + 1 targets hold all that
    its tests can take, themselves left out, so tests never meet the rest of them.
    """
    rank = F.dense_rank().over(Window.partitionBy("base").orderBy("target"))
    first = graph.cut(targets.where("target is not null and base is not null").select("base", "target").withColumn("r", rank).where(F.col("r") <= most + 1).select("base", "target").distinct())
    w = Window.partitionBy("test").orderBy("target")
    near = tests.join(first, "base").select("test", "target").distinct().where("test <> target").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
    linked = direct.join(first.select("target").distinct(), "target", "left_semi").select("test", "target").distinct()
    return near.join(linked.withColumn("linked", F.lit(True)), ["test", "target"], "left").select("test", "target", F.when(F.col("linked"), 0.85).otherwise(0.65).alias("confidence"))


def verdicts(hits: DataFrame, entities: int) -> DataFrame:
    """(rule_id, verdict) from each rule's hits by run: what keeping, watching or dropping it rests on.

    hits: (rule_id, run, n, unique_n, avg_ns). No hit: regenerate in the first two runs, then disable. Over a quarter of
    all entities: regenerate. Slow (5 ms): shadow. Over half of its hits its own: promote. Else shadow.
    """
    s = hits.groupBy("rule_id").agg(F.count("*").alias("runs"), F.sum("n").alias("total"), F.max_by("n", "run").alias("last"), F.max_by("unique_n", "run").alias("own"), F.avg("avg_ns").alias("ns"))
    v = (
        F.when((F.col("total") == 0) & (F.col("runs") < 3), "regenerate").when(F.col("total") == 0, "disable").when(F.col("last") > 0.25 * entities, "regenerate")
        .when(F.col("ns") > 5_000_000, "shadow").when((F.col("last") > 0) & (F.col("own") > 0.5 * F.col("last")), "promote").otherwise("shadow")
    )
    return s.select("rule_id", v.alias("verdict"))
