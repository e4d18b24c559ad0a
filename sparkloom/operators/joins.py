"""Joins of the engine: all equi-joins (prefixes, suffixes and tokens are exploded), ranked by windows where one must win."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row a key, the first in order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def longest_prefix(refs: DataFrame, modules: DataFrame, ref: str, module: str) -> DataFrame:
    """refs with the longest dotted proper prefix that is a module, null where none is."""
    parts = F.split(ref, r"\.")
    wide = refs.select(ref).distinct().withColumn("p", parts).where(F.size("p") > 1).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    wide = wide.withColumn(module, F.array_join(F.slice("p", F.lit(1), F.col("i")), "."))
    best = wide.join(modules.select(module).distinct(), module).groupBy(ref).agg(F.max_by(module, "i").alias(module))
    return refs.join(best, ref, "left")


def unique_suffix(mentions: DataFrame, paths: DataFrame, mention: str, path: str) -> DataFrame:
    """(mention, path) where the mention is a path suffix, at segment borders, of that path alone."""
    p = F.split(path, "/")
    tails = paths.select(path).distinct().withColumn("p", p).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("p"))))
    tails = tails.select(path, F.array_join(F.slice("p", F.col("i"), F.size("p")), "/").alias(mention))
    only = tails.groupBy(mention).agg(F.count("*").alias("c"), F.min(path).alias(path)).where("c = 1").drop("c")
    return mentions.select(mention).distinct().join(only, mention)


def nearest_path(refs: DataFrame, candidates: DataFrame, name: str, here: str, there: str) -> DataFrame:
    """For each (name, here) the candidate path that shares most leading segments, first path among equals."""
    a, b = F.split(here, "/"), F.split(there, "/")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.coalesce(F.array_position(same, F.lit(False)), F.lit(0))
    n = F.when(shared == 0, F.size(same)).otherwise(shared - 1)
    return first_by(refs.join(candidates, name).withColumn("shared", n), [name, here], F.desc("shared"), there)


def token_overlap(left: DataFrame, right: DataFrame, lid: str, rid: str, least: int, most: int) -> DataFrame:
    """(lid, rid, shared): pairs that share at least `least` tokens, the `most` best for each lid. Inputs: (id, token)."""
    pairs = left.distinct().join(right.distinct(), "token").groupBy(lid, rid).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    w = Window.partitionBy(lid).orderBy(F.desc("shared"), rid)
    return pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def enclosing(points: DataFrame, spans: DataFrame, file: str = "file_path") -> DataFrame:
    """For each (file, line) the smallest span around it, then the first id. Lines are binned, so this is an equi-join.

    spans has (file, start_line, end_line, entity_id); points has (file, line).
    """
    width = 64
    s = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))
    p = points.withColumn("_bin", F.floor(F.col("line") / width))
    hit = p.join(s, [file, "_bin"]).where("line between start_line and end_line").withColumn("span", F.col("end_line") - F.col("start_line"))
    return first_by(hit, [file, "line"], "span", "entity_id").drop("_bin", "span")


def enclosing_or_next(points: DataFrame, spans: DataFrame, file: str = "file_path") -> DataFrame:
    """(file, line, entity_id, how): the smallest span around a line, else the nearest that starts after it; first id on ties.

    The nearest start is the first in a running minimum from the file's end: one union, no pairs.
    """
    around = enclosing(points, spans, file).select(file, "line", "entity_id", F.lit("enclosing").alias("how"))
    rest = points.select(file, "line").distinct().join(around.select(file, "line"), [file, "line"], "left_anti")
    starts = spans.groupBy(file, F.col("start_line").alias("line")).agg(F.min("entity_id").alias("_id"))
    both = starts.unionByName(rest.withColumn("_id", F.lit(None).cast("string")))
    later = Window.partitionBy(file).orderBy("line").rangeBetween(1, Window.unboundedFollowing)
    after = both.withColumn("entity_id", F.first("_id", ignorenulls=True).over(later)).where("_id is null and entity_id is not null")
    return around.unionByName(after.select(file, "line", "entity_id", F.lit("following").alias("how")))


def strong_overlap(left: DataFrame, right: DataFrame, lid: str, rid: str, strong: Column, least: int = 2, most: int = 3) -> DataFrame:
    """(lid, rid, score): pairs with `least` tokens in common or one strong one; 10 a token and 1 more a strong one, `most` best for each lid.

    Inputs: (id, token); strong is a Column over token. A pair counts a token once.
    """
    pairs = left.distinct().join(right.distinct(), "token").groupBy(lid, rid).agg(F.count("*").alias("shared"), F.count(F.when(strong, 1)).alias("strong"))
    w = Window.partitionBy(lid).orderBy(F.desc("score"), rid)
    scored = pairs.where((F.col("shared") >= least) | (F.col("strong") >= 1)).select(lid, rid, (10 * F.col("shared") + F.col("strong")).alias("score"))
    return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def as_of(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, value: str) -> DataFrame:
    """left with the latest `value` of right at or before its time: one union, one window, no pair of rows is made."""
    a = left.withColumns({"_t": F.col(lt), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(key, F.col(rt).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_t", "_side", "_v")


def incident(rels: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end in ids: a union of two semi-joins, never an OR join; each edge once."""
    out = rels.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    rest = rels.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    return out.unionByName(rest.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*out.columns))


def merge(base: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """Copy on write by key: base rows of keys that new does not bring, and all of new."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
