"""Declarative rules compiled to Columns: one boolean a rule, actions merged in priority order, one pass over entities."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters as P
from . import records as X

EDGE_ALIASES = {"INHERITS_FROM": "INHERITS"}  # fixed values: older names of relation types


@dataclass(frozen=True)
class Edge:
    """At least `least` edges of a type, to or from other ends that satisfy the filters; alternatives within a filter."""

    edge: str
    direction: str = "either"  # outbound, inbound or either; an edge to itself then counts twice
    least: int = 1
    types: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    metadata: tuple[tuple[str, str], ...] = ()  # (key, value), all equal


@dataclass(frozen=True)
class Rule:
    rule_id: str
    priority: int = 0
    types: tuple[str, ...] = ("*",)
    files: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    metadata: tuple[tuple, ...] = ()  # (key, operator, value)
    tags_any: tuple[str, ...] = ()
    add_tags: tuple[str, ...] = ()
    put: dict = field(default_factory=dict)
    regexes: tuple[tuple, ...] = ()  # (target, pattern, ignore case); target: name, file_path, signature or metadata:<key>
    content: tuple[str, ...] = ()  # parts of the file's text, in a column `content`
    edges_all: tuple[Edge, ...] = ()
    edges_any: tuple[Edge, ...] = ()
    when_all: tuple[tuple, ...] = ()  # as metadata
    when_any: tuple[tuple, ...] = ()
    gap_types: tuple[str, ...] = ()
    has_raw: bool | None = None
    has_gap: bool | None = None
    start_from: int | None = None
    end_to: int | None = None
    hash_pattern: str | None = None


def _meta(conditions: tuple[tuple, ...]) -> list[Column]:
    return [P.metadata_predicate(F.get_json_object("metadata_json", f"$['{k}']"), op, want) for k, op, want in conditions]


def _regex_target(target: str) -> Column:
    if target.startswith("metadata:"):
        return F.coalesce(F.get_json_object("metadata_json", f"$['{target[9:]}']"), F.lit(""))
    return F.coalesce(F.col(target), F.lit("")) if target in ("name", "file_path", "signature") else F.lit(None).cast("string")


def _bytes(rule: Rule) -> list[Column]:
    """Conditions on raw text, byte range and content hash; a missing text has no gap to speak of and matches neither way."""
    size, raw = F.octet_length("raw_content") if rule.has_gap is not None else None, F.col("raw_content").isNotNull() if rule.has_raw is not None else None
    tests = [raw == F.lit(rule.has_raw)] if rule.has_raw is not None else []
    if rule.has_gap is not None:
        tests.append((F.col("start_byte") <= F.col("end_byte")) & (((F.col("end_byte") - F.col("start_byte")) != size) == F.lit(rule.has_gap)))
    tests += [F.col("start_byte") >= rule.start_from] if rule.start_from is not None else []
    tests += [F.col("end_byte") <= rule.end_to] if rule.end_to is not None else []
    return tests + ([F.rlike("content_hash", F.lit(rule.hash_pattern)) & (F.col("content_hash") != "")] if rule.hash_pattern is not None else [])


def _edges(rules: list[Rule]) -> list[Edge]:
    return sorted({e for r in rules for e in (*r.edges_all, *r.edges_any)}, key=repr)


def edge_counts(entities: DataFrame, rels: DataFrame, wanted: list[Edge]) -> DataFrame:
    """entities with an array `edge_counts`: for each edge condition of `wanted` the number of edges that satisfy it; null without edges.

    All conditions are counted in one pass over the edges of their types, by partial aggregates, so a hub costs no more
    than its edges. An end that is no entity satisfies conditions without filters only.
    """
    types = sorted({EDGE_ALIASES.get(e.edge.upper(), e.edge.upper()) for e in wanted})
    r = rels.select("source_id", "target_id", F.upper("relation_type").alias("kind")).replace(EDGE_ALIASES, subset=["kind"]).where(F.col("kind").isin(*types))
    ends = r.select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("other"), "kind", F.lit("outbound").alias("way"))
    ends = ends.unionByName(r.select(F.col("target_id").alias("entity_id"), F.col("source_id").alias("other"), "kind", F.lit("inbound").alias("way")))
    if any(e.types or e.names or e.metadata for e in wanted):
        far = entities.groupBy(F.col("entity_id").alias("other")).agg(F.min(F.struct("entity_type", "name", "metadata_json")).alias("far"))
        ends = ends.join(far, "other", "left").select("entity_id", "kind", "way", "far.entity_type", "far.name", "far.metadata_json")

    def one(e: Edge) -> Column:
        tests = [F.col("kind") == EDGE_ALIASES.get(e.edge.upper(), e.edge.upper())]
        tests += [F.col("way") == e.direction] if e.direction in ("outbound", "inbound") else []
        tests += [F.lower("entity_type").isin(*[t.lower() for t in e.types])] if e.types and "*" not in e.types else []
        tests += [F.col("entity_type").isNotNull()] if e.types else []
        tests += [reduce(lambda a, b: a | b, [P.name_matches(f"(?i){n}") for n in e.names])] if e.names else []
        tests += [F.get_json_object("metadata_json", f"$['{k}']") == v for k, v in e.metadata]
        return F.count(F.when(reduce(lambda a, b: a & b, tests), 1))

    n = ends.groupBy("entity_id").agg(F.array(*[one(e) for e in wanted]).alias("edge_counts"))
    return entities.join(n, "entity_id", "left")


def matcher(rule: Rule, tags: Column, wanted: list[Edge] = ()) -> Column:
    """All of a rule's conditions and its gate; lists of one kind are alternatives, but for regexes, metadata and edges_all.

    Edge conditions read `edge_counts`, whose places are those of `wanted`.
    """
    tests = []
    if "*" not in rule.types:
        tests.append(F.col("entity_type").isin(*rule.types))
    if rule.files:
        tests.append(reduce(lambda a, b: a | b, [P.glob(g) for g in rule.files]))
    if rule.names:
        tests.append(reduce(lambda a, b: a | b, [P.name_matches(f"(?i){n}") for n in rule.names]))
    tests += _meta(rule.metadata) + _bytes(rule) + [X.gate(_meta(rule.when_all), _meta(rule.when_any))]
    tests += [X.regexes([(_regex_target(t), p)], fold) for t, p, fold in rule.regexes]
    if rule.content:
        tests.append(X.content_any(F.col("content"), list(rule.content)))
    if rule.gap_types:
        tests.append(F.lower("entity_type").isin(*[t.lower() for t in rule.gap_types]))
    count = {e: F.coalesce(F.get("edge_counts", F.lit(i)), F.lit(0)) for i, e in enumerate(wanted)}
    tests += [count[e] >= e.least for e in rule.edges_all]
    if rule.edges_any:
        tests.append(reduce(lambda a, b: a | b, [count[e] >= e.least for e in rule.edges_any]))
    if rule.tags_any:
        tests.append(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in rule.tags_any])))
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def apply(entities: DataFrame, rules: list[Rule], rels: DataFrame | None = None) -> DataFrame:
    """entities with tags, rule_ids and put (map): rules in priority order, then by id; a rule sees the tags of those before.

    Rules with edge conditions need rels and raise ValueError without; a rule reads the columns of its own conditions only.
    """
    order = sorted(rules, key=lambda r: (r.priority, r.rule_id))
    wanted = _edges(rules)
    if wanted and rels is None:
        raise ValueError("edge conditions need edges")
    out = (edge_counts(entities, rels, wanted) if wanted else entities).withColumns({"tags": F.array().cast("array<string>"), "rule_ids": F.array().cast("array<string>"), "put": F.create_map().cast("map<string,string>")})
    for r in order:
        hit = f"_hit_{r.rule_id}"
        out = out.withColumn(hit, matcher(r, F.col("tags"), wanted))
        more = {"rule_ids": F.when(F.col(hit), F.concat("rule_ids", F.array(F.lit(r.rule_id)))).otherwise(F.col("rule_ids"))}
        if r.add_tags:
            more["tags"] = F.when(F.col(hit), F.array_sort(F.array_union("tags", F.array(*[F.lit(t) for t in r.add_tags])))).otherwise(F.col("tags"))
        if r.put:
            new = F.create_map(*[F.lit(x) for kv in r.put.items() for x in kv])
            more["put"] = F.when(F.col(hit), F.map_concat(F.map_filter("put", _not_in(r.put)), new)).otherwise(F.col("put"))
        out = out.withColumns(more).drop(hit)
    return out.drop("edge_counts") if wanted else out


def _not_in(put: dict):
    return lambda k, v: ~k.isin(*put)


def hits(applied: DataFrame) -> DataFrame:
    """(rule_id, entities, files) of applied rules."""
    return applied.select(F.explode("rule_ids").alias("rule_id"), "entity_id", "file_path").groupBy("rule_id").agg(F.count("*").alias("entities"), F.countDistinct("file_path").alias("files"))


def conflicts(rules: list[Rule]) -> list[tuple[str, str, str]]:
    """(rule, rule, key) where two rules of overlapping types put different constants under one key; rules are few."""
    out = []
    for i, a in enumerate(rules):
        for b in rules[i + 1 :]:
            meet = "*" in a.types or "*" in b.types or set(a.types) & set(b.types)
            out += [(a.rule_id, b.rule_id, k) for k in sorted(a.put.keys() & b.put.keys()) if meet and a.put[k] != b.put[k]]
    return out


def _edge(raw) -> Edge:
    raw = {"edge": raw} if isinstance(raw, str) else raw
    if raw.get("target_usn_tags_any"):
        raise ValueError("tags of an edge's other end are not supported")
    if not str(raw.get("edge") or "").strip() or not isinstance(raw.get("min_count", 1), int) or raw.get("min_count", 1) < 1:
        raise ValueError(f"edge matcher {raw}")
    return Edge(raw["edge"], raw.get("direction", "either"), raw.get("min_count", 1), tuple(raw.get("target_entity_types") or ()), tuple(raw.get("target_name_patterns") or ()), tuple(sorted((k, str(v)) for k, v in (raw.get("target_metadata_equals") or {}).items())))


def _conditions(raw) -> tuple[tuple, ...]:
    return tuple((c["key"], c["operator"], c.get("value")) for c in raw or ())


def _more(m: dict, a: dict) -> dict:
    """Conditions beyond types, files, names, metadata and tags, as a Rule takes them."""
    edges, when = m.get("ast_edges") or {}, a.get("when") or {}
    edges = {"any": edges} if isinstance(edges, list) else edges
    regexes = tuple((f"metadata:{x['metadata_key']}" if x.get("target") == "metadata" and x.get("metadata_key") else x.get("target", "name"), x["pattern"], bool(x.get("case_insensitive", True))) for x in m.get("regex_patterns") or ())
    return {
        "regexes": regexes, "content": tuple(m.get("content_patterns") or ()), "edges_all": tuple(_edge(e) for e in edges.get("all") or ()), "edges_any": tuple(_edge(e) for e in edges.get("any") or ()),
        "when_all": _conditions(when.get("all")), "when_any": _conditions(when.get("any")), "gap_types": tuple(m.get("gap_entity_types") or ()), "has_raw": m.get("has_raw_content"),
        "has_gap": m.get("has_coverage_gap"), "start_from": m.get("byte_range_start"), "end_to": m.get("byte_range_end"), "hash_pattern": m.get("content_hash_pattern"),
    }


def load(text: str) -> list[Rule]:
    """Rules of a YAML plugin of schema version 2; an unknown version or an invalid pattern raises ValueError."""
    import re

    import yaml

    doc = yaml.safe_load(text) or {}
    if str(doc.get("schema_version", "2")).split(".")[0] != "2":
        raise ValueError(f"schema version {doc.get('schema_version')}")
    out = []
    for r in doc.get("rules", []):
        if not r.get("enabled", True):
            continue
        m, a = r.get("matchers", {}), r.get("actions", {})
        for p in m.get("name_patterns", []):
            try:
                re.compile(p)
            except re.error as e:
                raise ValueError(f"{r['rule_id']}: {p}") from e
        meta = _conditions(m.get("metadata_conditions"))
        out.append(Rule(r["rule_id"], int(r.get("priority", 0)), tuple(m.get("entity_types", ["*"])), tuple(m.get("file_patterns", [])), tuple(m.get("name_patterns", [])), meta, tuple(m.get("usn_tags_any", [])), tuple(a.get("add_tags", [])), {k: str(v) for k, v in a.get("metadata", {}).items()}, **_more(m, a)))
    return out


def fingerprint(rules: list[Rule]) -> str:
    """SHA-256 of the rules' canonical JSON: the same set in any order has the same print."""
    import dataclasses
    import hashlib
    import json

    rows = sorted(json.dumps(dataclasses.asdict(r), sort_keys=True) for r in rules)
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def sample_gate(entities: DataFrame, rules: list[Rule], n: int = 2000) -> DataFrame:
    """(rule_id, hits, sample, verdict) on the `n` entities smallest by hashed id: fail at no hit or at 10 percent, else pass."""
    some = entities.orderBy(F.xxhash64("entity_id"), "entity_id").limit(n)
    h = apply(some, rules)
    each = h.agg(F.count("*").alias("sample"), *[F.count(F.when(F.array_contains("rule_ids", r.rule_id), 1)).alias(r.rule_id) for r in rules])
    wide = each.select("sample", F.explode(F.create_map(*[x for r in rules for x in (F.lit(r.rule_id), F.col(f"`{r.rule_id}`"))])).alias("rule_id", "hits"))
    return wide.select("rule_id", "hits", "sample", F.when((F.col("hits") == 0) | (F.col("hits") * 10 >= F.col("sample")), "fail").otherwise("pass").alias("verdict"))
