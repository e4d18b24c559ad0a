"""More registered queries: the whole ladder of stub resolution, receiver types read from signatures, the queue with both timers,
whole calls and export views."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import registry
from .operators import calls as Q
from .operators import filters as P
from .operators import ladder, receivers
from .operators import rules as U
from .streaming import queue
from .surface import NODES, SOURCED, nodes, sourced

query = registry.query


def parts(t):
    return t.raw("part").select(F.col("p_partkey").cast("string").alias("n"), (F.col("p_partkey") % 16).alias("k"))


def text(*pieces):
    """A Column of pieces in order: columns by name with a leading $, other pieces as they are."""
    return F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in pieces])


def by_kind(pieces: dict[int, tuple]):
    c = F.lit(None).cast("string")
    for k, p in pieces.items():
        c = F.when(F.col("k") == k, text(*p)).otherwise(c)
    return c


# What a part's reference is, by its number modulo 16, and the symbol that it should find.
REFS = {
    0: ("core.s", "$n"), 1: ("mods.m", "$n", ".Thing"), 2: ("@/m", "$n", ".Thing"), 3: ("fastapi.route", "$n"), 4: ("os.walk", "$n"), 5: ("svc.run", "$n"), 6: ("svc.run", "$n"), 7: ("self.run", "$n"),
    8: ("leaf", "$n"), 9: ("Field", "$n"), 10: ("../lib/u-", "$n"), 11: ("near", "$n"), 12: ("crate.util", "$n"), 13: ("amb", "$n"), 14: ("none", "$n"), 15: ("../../../../x", "$n"),
}
NAMES = {
    0: ("core.s", "$n"), 1: ("repo.mods.m", "$n", ".Thing"), 2: ("src.m", "$n", ".Thing"), 5: ("Svc", "$n", ".run", "$n"), 6: ("Svc", "$n", ".run", "$n"), 7: ("Svc", "$n", ".run", "$n", "_[ab12]"),
    8: ("par", "$n", ".leaf", "$n"), 9: ("pyd", "$n", ".Field", "$n"), 10: ("app/src/lib/u_", "$n"), 11: ("app.src.svc.near", "$n"), 12: ("app.src.util", "$n"), 13: ("amb", "$n"), 15: ("x", "$n"),
}
SIGNATURES = {5: ("def call(svc: Optional[Svc", "$n", "] = None, n: int = 0)"), 6: ("def call(*args, n: int = f(1, 2))",), 7: ("def call(self)",)}


@query("O-152-ladder", """select 'stub:' || p_partkey as stub, case k when 3 then 'external:fastapi.route' || p_partkey when 4 then 'std:os' when 14 then null when 15 then null else 'x:' || p_partkey end as target,
case k when 0 then 'exact_match' when 1 then 'package_alias' when 2 then 'package_alias' when 3 then 'external_prefix' when 4 then 'stdlib_method' when 5 then 'receiver_param' when 6 then 'receiver_assignment' when 7 then 'receiver_type'
when 8 then 'parent_chain' when 9 then 'sibling_module' when 10 then 'relative_path' when 11 then 'scope_qualified' when 12 then 'scope_qualified' when 13 then 'exact_match' end as strategy,
(case k when 0 then 0.95 when 1 then 0.85 when 2 then 0.85 when 3 then 0.85 when 4 then 0.90 when 5 then 0.90 when 6 then 0.75 when 7 then 0.65 when 8 then 0.75 when 9 then 0.75 when 10 then 0.85 when 11 then 0.70 when 12 then 0.70 when 13 then 0.5 else 0 end)::double as confidence,
case k when 3 then 'external:fastapi.route' || p_partkey when 4 then 'std:os' when 13 then 'x:' || p_partkey || ' y:' || p_partkey when 14 then '' when 15 then '' else 'x:' || p_partkey end as candidates
from (select p_partkey, p_partkey % 16 as k from part)""")
def ladder_of_strategies(t):
    """Every part is a reference site; its number modulo 16 sets what the reference looks like, so each strategy wins somewhere."""
    p = parts(t)
    here = [text("app/src/svc/f", "$n", ".rs").alias("file_path"), text("app/src/svc/f", "$n", "/call").alias("scope")]
    stubs = p.select(text("stub:", "$n").alias("stub"), by_kind(REFS).alias("ref"), *here, "n", "k")
    beside = p.where("k = 9").select(text("side:", "$n").alias("stub"), text("pyd", "$n").alias("ref"), *here, "n", "k")
    found = p.select(by_kind(NAMES).alias("name"), text("x:", "$n").alias("id"), F.when(F.col("k").isin(5, 6, 7), "METHOD").otherwise("FUNCTION").alias("kind"), F.lit(False).alias("external")).where("name is not null")
    second = p.where("k = 13").select(text("app.src.svc.amb", "$n").alias("name"), text("y:", "$n").alias("id"), F.lit("FUNCTION").alias("kind"), F.lit(False).alias("external"))
    modules = p.where("k in (1, 2)").select(F.when(F.col("k") == 1, text("repo.mods.m", "$n")).otherwise(text("src.m", "$n")).alias("name"), text("m:", "$n").alias("id"), F.lit("MODULE").alias("kind"), F.lit(False).alias("external"))
    fixed = t.spark.createDataFrame([("os", "std:os", "MODULE", True)], found.schema)
    symbols = found.unionByName(second).unionByName(modules).unionByName(fixed)
    callables = p.where("k in (5, 6, 7)").select(here[1].alias("id"), F.lit("call").alias("name"), here[0], by_kind(SIGNATURES).alias("signature"), F.when(F.col("k") == 7, text("Svc", "$n")).alias("owner"))
    types = p.where("k in (5, 6, 7)").select(text("Svc", "$n").alias("name"), F.lit(False).alias("module"))
    calls = stubs.where("k in (5, 6, 7)").select(F.col("stub").alias("call_id"), "scope", "file_path", F.substring_index("ref", ".", 1).alias("var"), F.lit(20).alias("line"))
    assigned = p.where("k = 6").select(here[1], F.lit("svc").alias("var"), F.explode(F.array(F.lit(10), F.lit(30))).alias("line"), "n").select("scope", "var", "line", F.when(F.col("line") == 10, text("Svc", "$n")).otherwise("other").alias("callee"))
    received = receivers.infer(calls, callables, types, assigned).where("type is not null").withColumnRenamed("call_id", "stub")
    aliases = t.spark.createDataFrame([("@/", "src/", True)], "prefix string, target string, open boolean")
    parents = p.where("k = 8").select(text("stub:", "$n").alias("stub"), text("par", "$n").alias("parent"))
    externals = t.spark.createDataFrame([("fastapi",)], "module string")
    out = ladder.climb(stubs.unionByName(beside).select("stub", "ref", "scope", "file_path"), symbols, aliases, parents, received, externals, ["os"])
    return out.where(F.startswith("stub", F.lit("stub:"))).withColumn("candidates", F.array_join("candidates", " "))


@query("O-153-signatures", """select o_orderkey as call_id, case k when 0 then 'T' || o_custkey when 1 then 'list' when 2 then 'Made' || o_custkey when 3 then 'Store' when 4 then 'Base' || o_custkey when 6 then 'Shared' when 8 then 'Base' || o_custkey || '.db' end as type,
case k when 0 then 'receiver_param' when 1 then 'receiver_param' when 2 then 'receiver_assignment' when 3 then 'receiver_assignment' when 4 then 'receiver_type' when 6 then 'receiver_type' when 8 then 'receiver_type' end as source from (select o_orderkey, o_custkey, o_orderkey % 9 as k from orders)""")
def types_from_signatures(t):
    """Each order is a call in its customer's method; its number modulo 9 picks the receiver, so every inference wins somewhere."""
    o = t.raw("orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").cast("string").alias("c"), (F.col("o_orderkey") % 9).alias("k"))
    var = F.element_at(F.array(*[F.lit(x) for x in ("direct", "many", "made", "dep", "self", "lost", "far", "nowhere", "self.db")]), (F.col("k") + 1).cast("int"))
    scope = text("m", "$c").alias("scope")
    calls = o.select("call_id", scope, F.lit("a.py").alias("file_path"), var.alias("var"), F.lit(50).alias("line"))
    c = o.select("c").distinct()
    signature = text("def m(self, direct: T", "$c", " = None, many: list[T", "$c", "], dep=Depends(get_store), *rest: int) -> None:")
    callables = c.select(scope.alias("id"), text("m", "$c").alias("name"), F.lit("a.py").alias("file_path"), signature.alias("signature"), text("Base", "$c").alias("owner"))
    shared = t.spark.createDataFrame([("z1", "get_store", "a.py", "def get_store(far: Shared | None, lost: Wrong) -> 'Store':", None), ("z2", "odd", "b.py", "def odd(nowhere: Elsewhere)", None)], callables.schema)
    types = c.select(F.explode(F.array(text("Base", "$c"), text("Base", "$c", ".db"), text("Made", "$c"))).alias("name"), F.lit(False).alias("module"))
    assigned = c.select(scope, text("Made", "$c").alias("made")).select("scope", F.inline(F.array(*[F.struct(F.lit(v).alias("var"), F.lit(line).alias("line"), callee.alias("callee")) for v, line, callee in (("made", 5, F.lit("m")), ("made", 9, F.col("made")), ("made", 60, F.lit("get_store")), ("lost", 8, F.lit("unknown")))])))
    return receivers.infer(calls, callables.unionByName(shared), types, assigned)


HOUR = 3_600_000_000


@query("O-202-pending", """with recursive e as (select user_id, event_type, ts, row_number() over (partition by user_id order by ts, event_type) as rn from events),
r as (select user_id, rn, ts, event_type, ts as first, [event_type] as seen, 1 as flush from e where rn = 1
union all select user_id, e.rn, e.ts, e.event_type, case when d then e.ts else first end, case when d then [e.event_type] else list_distinct(list_append(seen, e.event_type)) end, flush + d::int
from (select r.*, e as nx from r join e on e.user_id = r.user_id and e.rn = r.rn + 1) j, lateral (select nx.rn as rn, nx.ts as ts, nx.event_type as event_type) e, lateral (select len(seen) >= 4 or e.ts > least(j.ts + interval 12 hour, first + interval 30 hour) as d))
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last_at, strftime(case when count(distinct event_type) >= 4 then max(ts) else least(max(ts) + interval 12 hour, min(ts) + interval 30 hour) end, '%Y-%m-%d %H:%M:%S.%f') as flush_at, count(distinct event_type) as n, count(*) as events,
case when count(distinct event_type) >= 4 then 'threshold' when max(ts) + interval 12 hour <= min(ts) + interval 30 hour then 'debounce' else 'staleness' end as reason from r group by user_id, flush""")
def pending_flushes(t):
    out = queue.flushes(t.raw("events"), "user_id", "ts", "event_type", 12 * HOUR, 30 * HOUR, 4)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first_at", "last_at", "flush_at")})


# Stubs name a part; those of even parts are resolved to it.
TO = "case when starts_with(target_id, 'unresolved:') and regexp_extract(target_id, '[0-9]+$')::bigint % 2 = 0 then 'p:' || regexp_extract(target_id, '[0-9]+$') else target_id end"
STUB = f"case when {TO} <> target_id then target_id end"


def resolved_stubs(t):
    s = t.rels().where(P.is_stub("target_id")).select(F.col("target_id").alias("stub"), F.regexp_extract("target_id", "[0-9]+$", 0).alias("n")).distinct()
    return s.where(F.col("n").cast("long") % 2 == 0).select("stub", F.concat(F.lit("p:"), "n").alias("target"))


@query("O-181-filters", f"""with {NODES}, e as (select source_id, {TO} as target_id, {STUB} as stub_id, relation_type, roles, confidence, line from rels), pg as (select id from nodes where regexp_matches(name, '^[a-f]') and starts_with(id, 'p:'))
select source_id, target_id, relation_type, struct_extract(b, 'line') as line, struct_extract(b, 'stub') as stub_id from (select source_id, target_id, relation_type, min({{'line': line, 'c': coalesce(confidence, -1), 'stub': coalesce(stub_id, '')}}) as b from e
where target_id in (select id from pg) and relation_type in ('READS', 'WRITES') and (coalesce(roles, 0) & 4) <> 0 and coalesce(confidence, 1.0::float) >= 0.7::float group by 1, 2, 3)""")
def filtered_page(t):
    pg = nodes(t).where(F.startswith("id", F.lit("p:")) & P.name_matches("^[a-f]")).select("id")
    e = Q.page_edges(t.rels(), pg, resolved_stubs(t), ["READS", "WRITES"], ("WriteAccess",), 0.7, "incoming")
    return e.select("source_id", "target_id", "relation_type", "line", F.coalesce("stub_id", F.lit("")).alias("stub_id"))


@query("O-182-stubs", f"""with {NODES}, f as (select id as entity_id from nodes where name = (select min(p_name) from part) and starts_with(id, 'p:')), e as (select distinct source_id, {TO} as target_id, relation_type, line, {STUB} is not null as via_stub from rels),
g as (select source_id, target_id, relation_type, min({{'l': line, 'v': via_stub}}) as b from e where target_id in (select entity_id from f) group by 1, 2, 3)
select entity_id, source_id, target_id, relation_type, b.l as line, b.v as via_stub from f left join g on target_id = entity_id""")
def entity_with_stubs(t):
    """The parts of the first name; parts are never sources."""
    first = t.raw("part").agg(F.min("p_name")).first()[0]
    e = nodes(t).where(F.startswith("id", F.lit("p:"))).select(F.col("id").alias("entity_id"), "name", F.lit("CONSTANT").alias("entity_type"), F.col("path").alias("file_path"))
    return Q.entity_card(e, t.rels(), resolved_stubs(t), first)


@query("O-186-via", f"""{SOURCED}, c as (select 'out' as way, target_file as other, relation_type, confidence, line, target_id as id from sourced where source_file = 'src/asia/nation_2.py' and target_file <> source_file and relation_type <> 'CONTAINS'
union all select 'in', source_file, relation_type, confidence, line, source_id from sourced where target_file = 'src/asia/nation_2.py' and target_file <> source_file and relation_type <> 'CONTAINS'),
k as (select way, other, relation_type, name, count(*) as n, max(coalesce(confidence, 1.0::float)) as m, min(line) as line from c join nodes using (id) where coalesce(confidence, 1.0::float) >= 0.65::float group by 1, 2, 3, 4)
select way, other, relation_type, sum(n)::bigint as n, round_even(max(m)::double, 3) as max_confidence, string_agg(name, ',' order by line, name) as via from k group by 1, 2, 3""")
def connections_by_name(t):
    out = Q.file_connections(sourced(t), nodes(t), "src/asia/nation_2.py", 0.65)
    return out.withColumn("via", F.array_join("via", ","))


@query("O-97-roots", """with k as (select 'f' || o_custkey % 50 as file_path, case o_orderkey % 4 when 0 then 'external_stdlib' when 1 then 'external_package' when 2 then 'external_unresolved' else 'direct' end as kind, lower(o_orderstatus) || o_orderkey % 7 || '.x' as ref from orders)
select file_path, coalesce(string_agg(distinct case when kind = 'external_stdlib' then split_part(ref, '.', 1) end, ' ' order by case when kind = 'external_stdlib' then split_part(ref, '.', 1) end), '') as stdlib,
coalesce(string_agg(distinct case when kind = 'external_package' then split_part(ref, '.', 1) end, ' ' order by case when kind = 'external_package' then split_part(ref, '.', 1) end), '') as packages, count(*) filter (kind = 'external_unresolved') as unresolved from k group by 1""")
def roots_outside(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("external_stdlib", "external_package", "external_unresolved", "direct")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    k = t.raw("orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("file_path"), kind.alias("kind"), F.concat(F.lower("o_orderstatus"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".x")).alias("ref"))
    return Q.file_externals(k).withColumns({c: F.array_join(c, " ") for c in ("stdlib", "packages")})


@query("O-192-symbols", "select file_path as file, start_line as line, entity_id as id, name, entity_type as type, null::varchar as signature from entities")
def symbols(t):
    return Q.symbols_view(t.entities())


@query("O-192-dependencies", f"""{SOURCED}, d as (select distinct source_file as f, target_file as g from sourced where source_file <> target_file), o as (select f, string_agg(g, ' ' order by g) as a from d group by 1), i as (select g, string_agg(f, ' ' order by f) as b from d group by 1)
select coalesce(f, g) as file, coalesce(a, '') as depends_on, coalesce(b, '') as required_by from o full join i on f = g""")
def file_dependencies(t):
    d = sourced(t).where("source_file <> target_file").select(F.col("source_file").alias("file"), F.col("target_file").alias("target"))
    return Q.dependencies_view(d).withColumns({c: F.array_join(c, " ") for c in ("depends_on", "required_by")})


@query("O-192-delta", """with a as (select file_id, string_agg(id || hash, ',' order by id) as h from v_old group by 1), b as (select file_id, string_agg(id || hash, ',' order by id) as h, count(*) as n from v_new group by 1)
select coalesce(a.file_id, b.file_id) as file_id, case when a.h is null then 'added' when b.h is null then 'removed' when a.h = b.h then 'unchanged' else 'modified' end as state, coalesce(n, 0) as entities from a full join b on a.file_id = b.file_id""")
def delta_of_files(t):
    old, new = t.versions()
    return Q.delta_view(old, new, "file_id")


RULES = """
schema_version: "2"
rules:
  - {rule_id: busy, priority: 1, matchers: {entity_types: [CLASS], ast_edges: {all: [{edge: CALLS, direction: inbound, min_count: 12}]}}, actions: {add_tags: [busy]}}
  - {rule_id: big, priority: 2, matchers: {ast_edges: [{edge: IMPORTS, direction: outbound, target_name_patterns: ["[0-9]*[13579]$"]}], regex_patterns: [{pattern: "SEGMENT|build", target: metadata, metadata_key: segment}]}, actions: {add_tags: [big], when: {any: [{key: bsg.domain, operator: eq, value: ASIA}, {key: bsg.domain, operator: eq, value: AMERICA}]}}}
  - {rule_id: cased, priority: 3, matchers: {regex_patterns: [{pattern: "^customer", case_insensitive: false}]}, actions: {add_tags: [never]}}
  - {rule_id: bytes, priority: 4, matchers: {entity_types: [MODULE], has_raw_content: true, has_coverage_gap: true, byte_range_start: 3, content_patterns: ["none", "f nat"], content_hash_pattern: "^[0-9]"}, actions: {add_tags: [gap]}}
"""


@query("O-50-all", """with c as (select c_custkey as k, c_name, c_mktsegment, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select 'c:' || k as entity_id, concat_ws(',', case when n >= 12 then 'busy' end, case when c_mktsegment = 'BUILDING' and regexp_matches(n_name, '[13579]$') and r_name in ('ASIA', 'AMERICA') then 'big' end) as rule_ids from c left join (select o_custkey as k, count(*) as n from orders group by 1) using (k)
union all select 'n:' || n_nationkey, case when n_nationkey >= 3 and starts_with(lower(n_name), 'nat') and n_nationkey % 3 <> 0 and regexp_matches(md5(n_name), '^[0-9]') then 'bytes' else '' end from nation""")
def all_conditions(t):
    """Customers and nations under rules of every kind of condition; a nation's raw text is its name, one byte short of its range unless its key is a multiple of three."""
    nat = t.nations()
    c = t.raw("customer").join(F.broadcast(nat.select("file_id", "file_path", "r_name")), F.col("c_nationkey") == F.col("file_id"))  # one row a nation
    meta = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("bsg.domain")))
    none = {k: F.lit(None).cast(v) for k, v in (("raw_content", "string"), ("start_byte", "long"), ("end_byte", "long"), ("content", "string"), ("content_hash", "string"))}
    key = F.col("file_id")
    own = {"raw_content": F.col("n_name"), "start_byte": key, "end_byte": key + F.octet_length("n_name") + F.when(key % 3 == 0, 0).otherwise(1), "content": F.concat(F.lit("Of "), "n_name"), "content_hash": F.md5("n_name")}
    e = c.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_name").alias("name"), F.lit("CLASS").alias("entity_type"), "file_path", meta.alias("metadata_json"), *[v.alias(k) for k, v in none.items()])
    e = e.unionByName(nat.select(F.concat(F.lit("n:"), key.cast("string")).alias("entity_id"), F.col("n_name").alias("name"), F.lit("MODULE").alias("entity_type"), "file_path", F.lit("{}").alias("metadata_json"), *[v.alias(k) for k, v in own.items()]))
    return U.apply(e, U.load(RULES), t.rels()).select("entity_id", F.array_join("rule_ids", ",").alias("rule_ids"))
