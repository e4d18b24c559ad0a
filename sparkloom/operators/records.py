"""Record-level projections and small policies: categories, metadata, tiers, tags, patterns, pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import filters as P

# Entity types by category, metadata kept on entities, scope tiers, service folders, priority of path categories.
CATEGORIES = {
    "CODE": ("FUNCTION", "METHOD", "CLASS", "STRUCT", "INTERFACE", "TRAIT", "ENUM", "TYPE_ALIAS", "FIELD", "CONSTANT", "VARIABLE", "MODULE", "NAMESPACE", "ENTRY_POINT", "PROPERTY", "CONSTRUCTOR", "ENUM_MEMBER", "PARAMETER", "TYPE_PARAMETER"),
    "EXTERNAL": ("EXTERNAL_SYMBOL",),
    "INFRASTRUCTURE": ("INFRASTRUCTURE_CONFIG", "ENVIRONMENT_VARIABLE"),
    "MARKUP": ("SETTING", "SECTION", "ELEMENT", "DOCUMENT"),
    "STRUCTURAL": ("SYNTAX_GLUE", "COMMENT_BLOCK"),
}
KEPT = ("decorators", "docstring", "invocation_snippet")
TIERS = {"GLOBAL": ("MODULE", "NAMESPACE", "ENTRY_POINT", "DOCUMENT"), "MODULE": ("CLASS", "STRUCT", "INTERFACE", "TRAIT", "ENUM", "SECTION"), "CLASS": ("METHOD", "FIELD", "PROPERTY")}
PATH_PRIORITY = {"TEST": 4, "CONFIG": 3, "DOC": 2, "INFRA": 2, "SOURCE": 1}


def expand(categories: list[str], types: list[str] = ()) -> list[str]:
    """Entity types of the named categories and of `types`, upper case, sorted."""
    unknown = [c for c in categories if c.upper() not in CATEGORIES]
    if unknown:
        raise ValueError(f"unknown categories {unknown}")
    return sorted({t.upper() for t in types} | {t for c in categories for t in CATEGORIES[c.upper()]})


def relation_types(names: list[str]) -> Column:
    """Rows of any of the relation types, given or stored as forward or legacy inverse names."""
    want = {P.INVERSE.get(n.upper(), n.upper()) for n in names}
    return F.col("relation_type").isin(*sorted(want | {old for old, new in P.INVERSE.items() if new in want}))


def directed(rels: DataFrame, page: DataFrame, direction: str) -> DataFrame:
    """Edges that leave the page's ids (outgoing), enter them (incoming), or either."""
    out = rels.join(page.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi").select(*rels.columns)
    if direction == "outgoing":
        return out
    into = rels.join(page.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi").select(*rels.columns)
    if direction == "incoming":
        return into
    return out.unionByName(into.join(page.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_anti").select(*rels.columns))


def content_any(content: Column, patterns: list[str]) -> Column:
    """Lower-cased content contains any pattern; empty or missing content does not."""
    low = F.lower(content)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(p.lower())) for p in patterns], F.lit(False)), F.lit(False))


def gate(every: list[Column], some: list[Column]) -> Column:
    """All of the first list and, where given, any of the second."""
    yes = reduce(lambda a, b: a & b, every, F.lit(True))
    return F.coalesce(yes & reduce(lambda a, b: a | b, some) if some else yes, F.lit(False))


def regexes(tests: list[tuple[Column, str]], ignore_case: bool = True) -> Column:
    """All (value, pattern) searches hold; an invalid pattern or a missing value does not."""
    made = F.lit(True)
    for value, pattern in tests:
        try:
            re.compile(pattern)
            made &= F.coalesce(F.rlike(value, F.lit(("(?i)" if ignore_case else "") + pattern)), F.lit(False))
        except re.error:
            made &= F.lit(False)
    return made


def safe_regex(pattern: str, most: int = 250) -> bool:
    """Whether a pattern compiles, is short, and repeats no group that itself repeats or alternates."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    if len(pattern) > most:
        return False
    opened, risky = [], re.sub(r"\\.", "x", re.sub(r"\[[^\]]*\]", "x", pattern))
    for i, c in enumerate(risky):
        if c == "(":
            opened.append(i)
        elif c == ")" and opened:
            inner = risky[opened.pop() + 1 : i]
            if re.match(r"[*+{]", risky[i + 1 : i + 2]) and re.search(r"[*+|]|\{\d", inner):
                return False
    return True


def agent_metadata(meta: str, entity_id: str) -> Column:
    """Metadata map kept on an entity: bsg.* keys and a few others; stubs keep all."""
    m = F.from_json(meta, "map<string,string>")
    return F.when(P.is_stub(entity_id), m).otherwise(F.map_filter(m, lambda k, v: F.startswith(k, F.lit("bsg.")) | k.isin(*KEPT)))


def merged_metadata(entities: DataFrame, states: DataFrame) -> DataFrame:
    """Entities with resolution states (entity_id, state, target) merged into their metadata, new keys winning; JSON again."""
    m = F.coalesce(F.from_json("metadata_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.map_filter(F.create_map(F.lit("stub_resolution_state"), F.col("state"), F.lit("stub_resolved_target"), F.col("target")), lambda k, v: v.isNotNull())
    fresh = F.to_json(F.map_concat(F.map_filter(m, lambda k, v: ~k.isin("stub_resolution_state", "stub_resolved_target")), new))
    return entities.join(states, "entity_id", "left").withColumn("metadata_json", F.when(F.col("state").isNotNull(), fresh).otherwise(F.col("metadata_json"))).drop("state", "target")


def page_meta(df: DataFrame, limit: int, offset: int, generation: int = 0) -> DataFrame:
    """One row: total, returned, offset, limit, truncated, generation; the count is one aggregate."""
    n = df.agg(F.count("*").alias("total"))
    back = F.greatest(F.lit(0).cast("long"), F.least(F.lit(limit).cast("long"), F.col("total") - offset))
    return n.select("total", back.alias("returned"), F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), (F.col("total") > offset + back).alias("truncated"), F.lit(generation).alias("generation"))


def scope_tier(kind: str = "entity_type", parent: Column | None = None) -> Column:
    ladder = reduce(lambda acc, kv: acc.when(F.col(kind).isin(*kv[1]), kv[0]), TIERS.items(), F.when(F.lit(False), ""))
    return ladder.otherwise(F.when(parent.isNotNull(), "LOCAL").otherwise("MODULE") if parent is not None else "MODULE")


def service_tag(path: str = "file_path") -> Column:
    """Folder after the first of services, service, apps, modules; else the second folder of backend, frontend or api."""
    p = F.split(path, "/")
    spots = [F.when((F.array_position(p, w) > 0) & (F.array_position(p, w) < F.size(p)), F.get(p, F.array_position(p, w).cast("int"))) for w in ("services", "service", "apps", "modules")]
    return F.coalesce(*spots, F.when(F.get(p, F.lit(0)).isin("backend", "frontend", "api"), F.get(p, F.lit(1))))


def strongest_category(df: DataFrame, key: str, category: str) -> DataFrame:
    """(key, category): the category of highest priority, then first by name."""
    rank = reduce(lambda acc, kv: acc.when(F.col(category) == kv[0], kv[1]), PATH_PRIORITY.items(), F.when(F.lit(False), 0)).otherwise(0)
    return df.groupBy(key).agg(F.min(F.struct(-rank, F.col(category).alias("c"))).alias("b")).select(key, F.col("b.c").alias(category))


def numbered(df: DataFrame, label: str, key: str) -> DataFrame:
    """Labels made distinct: the second of a label by key gets (2), and so on."""
    k = F.row_number().over(Window.partitionBy(label).orderBy(key))
    return df.withColumn("_k", k).withColumn(label, F.when(F.col("_k") > 1, F.concat(label, F.lit(" ("), F.col("_k").cast("string"), F.lit(")"))).otherwise(F.col(label))).drop("_k")


def hinted(entities: DataFrame, hints: dict[str, str], most: int = 10) -> DataFrame:
    """(hint, entity_id): entities whose name fits a hint's glob, the first `most` by id. Hints are few and inlined, no join."""
    tests = [F.when(P.glob(pattern, "name"), hint) for hint, pattern in sorted(hints.items())]
    hit = entities.select("entity_id", F.explode(F.array_compact(F.array(*tests))).alias("hint"))
    w = Window.partitionBy("hint").orderBy("entity_id")
    return hit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def stripped(applied: DataFrame, owned: list[str]) -> DataFrame:
    """Entities without what rules own: their keys, tags and stamps; applying rules again then starts clean."""
    empty = F.array().cast("array<string>")
    return applied.withColumns({"put": F.map_filter("put", lambda k, v: ~k.isin(*owned)) if owned else F.col("put"), "tags": empty, "rule_ids": empty})


def greedy_files(counts: DataFrame, threshold: int) -> DataFrame:
    """Files, largest first, until the first that does not fit the threshold; counts: (file_path, n).

    A running sum by size class decides all classes but one: only rows of that class are ordered.
    """
    hist = counts.groupBy("n").agg(F.count("*").alias("c"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)  # a row a distinct size
    before = hist.select("n", F.coalesce(F.sum(F.col("n") * F.col("c")).over(w), F.lit(0)).alias("spent"), "c")
    room = before.select("n", F.floor((F.lit(threshold) - F.col("spent")) / F.col("n")).alias("fit"), "c")
    stop = room.where("fit < c").agg(F.max("n").alias("stop"))
    whole = counts.join(F.broadcast(stop), F.lit(True)).where("stop is null or n > stop").select("file_path", "n")  # a single row
    part = counts.join(F.broadcast(stop), F.col("n") == F.col("stop")).join(F.broadcast(room.join(F.broadcast(stop), F.col("n") == F.col("stop")).select("fit")), F.lit(True))  # single rows
    k = F.row_number().over(Window.orderBy("file_path"))
    return whole.unionByName(part.withColumn("k", k).where("k <= fit").select("file_path", "n"))


def coverage(spans: DataFrame, key: str, size: str = "size") -> DataFrame:
    """(key, covered, overlap, coverage): total span over size, overlaps counted twice, and the length covered again.

    spans: (key, start, end, size).
    """
    upto = F.max("end").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    again = F.greatest(F.lit(0), F.least(F.col("end"), F.coalesce("_u", F.lit(0))) - F.col("start"))
    s = spans.withColumn("_u", upto).withColumn("_again", F.when(F.col("_u").isNull(), 0).otherwise(again))
    return s.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.sum("_again").alias("overlap"), F.max(size).alias("_s")).select(key, "covered", "overlap", F.bround(F.col("covered") / F.col("_s"), 4).alias("coverage"))


def carried(old: DataFrame, new: DataFrame, cards: list[str]) -> DataFrame:
    """(id, label): labels of the last generation whose card, all but its id, is the same. old also has `label`."""
    digest = F.sha2(F.to_json(F.struct(*sorted(cards)), {"ignoreNullFields": "false"}), 256)
    known = old.select(digest.alias("h"), "label").groupBy("h").agg(F.min("label").alias("label"))
    return new.select("id", digest.alias("h")).join(known, "h").select("id", "label")


def tiebreak_pairs(old: DataFrame, new: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """(old_id, id): k-th old with k-th new row of equal keys, both in order."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    a, b = old.select(*keys, k.alias("k"), F.col("id").alias("old_id")), new.select(*keys, k.alias("k"), "id")
    return a.join(b, [*keys, "k"]).select("old_id", "id")
