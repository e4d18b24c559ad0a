"""Whole calls: the edges of a page of entities, one entity with what reaches it through stubs, one file's connections, export views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters as P
from . import resolution as R
from .graph import cut

TRIPLE = ["source_id", "target_id", "relation_type"]


def incident(rels: DataFrame, page: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges with an end in page (id), or a stub at the end that was resolved to one; forward types, stubs replaced.

    Adds stub_id, the name an edge was recorded under, null for plain ones. resolved: (stub, target). Ids are met
    before anything else, so what follows reads the page's edges only; both joins are equi-joins.
    """
    ids = page.select("id").distinct()
    stubs = resolved.where(~P.is_stub("target")).join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("stub", "target").distinct()
    ends = ids.unionByName(stubs.select(F.col("stub").alias("id"))).distinct()
    by_source = rels.join(ends.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(*rels.columns)
    by_target = rels.join(ends.withColumnRenamed("id", "target_id"), "target_id", "left_semi").join(ends.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    met = P.forward(by_source.unionByName(by_target.select(*rels.columns))).drop("reversed")
    every = resolved.where(~P.is_stub("target")).groupBy(F.col("stub").alias("target_id")).agg(F.min("target").alias("_to"))
    out = met.join(every, "target_id", "left").withColumn("stub_id", F.when(F.col("_to").isNotNull(), F.col("target_id")))
    return out.withColumn("target_id", F.coalesce("_to", "target_id")).select(*rels.columns, "stub_id")


def page_edges(rels: DataFrame, page: DataFrame, resolved: DataFrame, types: list[str] | None = None, roles: tuple[str, ...] = (), least: float | None = None, direction: str = "both") -> DataFrame:
    """(source_id, target_id, relation_type, line, confidence, stub_id): a page's edges under all filters, each triple once, its first line.

    Filters act on forward types and replaced stubs; a missing confidence is 1. direction: outgoing, incoming or both.
    """
    e = incident(rels, page, resolved)
    if types is not None:
        e = e.where(F.col("relation_type").isin(*types))
    if roles:
        e = e.where(P.has_role(*roles))
    if least is not None:
        e = e.where(P.confident(least))
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError("direction is outgoing, incoming or both")
    ids = page.select("id").distinct().withColumn("_in", F.lit(True))
    for end in ("source", "target"):
        e = e.join(ids.select(F.col("id").alias(f"{end}_id"), F.col("_in").alias(f"_{end}")), f"{end}_id", "left")
    e = e.where({"outgoing": "_source", "incoming": "_target", "both": "_source or _target"}[direction])
    return e.groupBy(*TRIPLE).agg(F.min(F.struct("line", "confidence", "stub_id")).alias("b")).select(*TRIPLE, "b.*")


def entity_card(entities: DataFrame, rels: DataFrame, resolved: DataFrame, name: str) -> DataFrame:
    """(entity_id, source_id, target_id, relation_type, line, via_stub): the entities a name means, each with its edges; without edges one row of nulls.

    entities needs (entity_id, name, entity_type, file_path); the name is looked up on one rung of `resolution.by_name`.
    """
    found = cut(R.by_name(entities, name).select("entity_id").distinct())  # read five times below
    e = page_edges(rels, found.withColumnRenamed("entity_id", "id"), resolved).select(*TRIPLE, "line", F.col("stub_id").isNotNull().alias("via_stub"))
    ends = e.withColumn("entity_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))))
    return found.join(ends, "entity_id", "left").select("entity_id", *TRIPLE, "line", "via_stub")


def file_connections(sourced: DataFrame, names: DataFrame, file: str, least: float | None = None) -> DataFrame:
    """(way, other, relation_type, n, max_confidence, via): one file's edges to and from other files, with the names they go by.

    via names the remote end of outgoing edges and the caller of incoming ones, distinct, by their first line, then
    name. sourced: edges with source_file and target_file; names: (id, name). The file's edges are cut out before any join.
    """
    e = sourced.where("relation_type <> 'CONTAINS' and source_file <> target_file")
    if least is not None:
        e = e.where(P.confident(least))

    def way(name: str, here: str, there: str, end: str) -> DataFrame:
        return e.where(F.col(here) == file).select(F.lit(name).alias("way"), F.col(there).alias("other"), "relation_type", "confidence", "line", F.col(end).alias("id"))

    both = way("out", "source_file", "target_file", "target_id").unionByName(way("in", "target_file", "source_file", "source_id"))
    key = ["way", "other", "relation_type"]
    each = both.join(names.select("id", "name"), "id", "left").groupBy(*key, "name").agg(F.count("*").alias("n"), F.max(F.coalesce("confidence", F.lit(1.0).cast("float"))).alias("c"), F.min("line").alias("line"))
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("name", F.lit("")) != "", F.struct("line", "name")))), lambda x: x["name"])
    return each.groupBy(*key).agg(F.sum("n").alias("n"), F.bround(F.max("c").cast("double"), 3).alias("max_confidence"), shown.alias("via"))


def file_externals(kinds: DataFrame) -> DataFrame:
    """(file_path, stdlib, packages, unresolved): what a file's edges meet outside the tree; roots distinct and sorted.

    kinds: (file_path, kind, ref), one row an edge, kinds as `lookup.endpoints` names them. A file's roots are as many
    as it imports; they are made distinct before they are gathered.
    """
    root = F.substring_index("ref", ".", 1)
    g = kinds.groupBy("file_path", "kind", root.alias("root")).agg(F.count("*").alias("n"))

    def roots(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when((F.col("kind") == kind) & (F.col("root") != ""), F.col("root"))))

    lost = F.sum(F.when(F.col("kind").isin("external_unresolved", "unresolved"), F.col("n")).otherwise(0))
    return g.groupBy("file_path").agg(roots("external_stdlib").alias("stdlib"), roots("external_package").alias("packages"), lost.alias("unresolved"))


# Export views: one row of JSON a file or a symbol, so a view of any size is written by all tasks.


def symbols_view(entities: DataFrame) -> DataFrame:
    """(file, line, id, name, type, signature), in the order in which files and lines are read when written sorted; a missing signature stays null."""
    signature = F.col("signature") if "signature" in entities.columns else F.lit(None).cast("string")
    return entities.select(F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.col("entity_id").alias("id"), "name", F.col("entity_type").alias("type"), signature.alias("signature"))


def dependencies_view(depends: DataFrame) -> DataFrame:
    """(file, depends_on, required_by): both directions of file dependencies (file, target), sorted and distinct; files without any are left out.

    The distinct pairs come first, so a hub gathers files, not edges.
    """
    d = depends.where("file is not null and target is not null").select("file", "target").distinct()
    out = d.groupBy("file").agg(F.array_sort(F.collect_list("target")).alias("depends_on"))
    into = d.groupBy(F.col("target").alias("file")).agg(F.array_sort(F.collect_list("file")).alias("required_by"))
    none = F.array().cast("array<string>")
    return out.join(into, "file", "full_outer").select("file", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("required_by", none).alias("required_by"))


def delta_view(old: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, state, entities): added, modified, removed and unchanged files between two entity tables (key, id, hash); entities of new files.

    A file is modified if its entities differ as a multiset of (id, hash). Files are compared by count and two sums of 64-bit
    hashes, so none is gathered; two files that differ agree in these by chance only.
    """

    def digest(df: DataFrame, tag: str) -> DataFrame:
        cells = [F.sum(F.xxhash64(F.lit(seed), "id", "hash").cast("decimal(38,0)")) for seed in (1, 2)]
        return df.groupBy(key).agg(F.struct(F.count("*").alias("n"), cells[0].alias("a"), cells[1].alias("b")).alias(tag))

    both = digest(old, "o").join(digest(new, "n"), key, "full_outer")
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "unchanged").otherwise("modified")
    return both.select(key, state.alias("state"), F.coalesce("n.n", F.lit(0)).alias("entities"))
