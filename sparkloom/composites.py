"""More registered queries: rankings, resolution, rules, communities, composite calls, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import registry
from .functions import names as N
from .operators import aggregates as A
from .operators import communities as C
from .operators import filters as P
from .operators import graph as G
from .operators import lookup as L
from .operators import records as X
from .operators import resolution as R
from .operators import rules as U
from .operators import semantic as S
from .sources import code
from .streaming import changes
from .surface import NODES, SOURCED, nodes, ref, sourced

NAMES: list[str] = []
QUARANTINE = registry.QUARANTINE
FILE = "src/asia/nation_2.py"


def query(name: str, sql: str | None):
    NAMES.append(name)
    return registry.query(name, sql)


@query("O-102", """with a as (select count(*) filter (starts_with(target_id, 'unresolved:')) / count(*) as r from rels), b as (select count(*) filter (metadata_json like '%"bsg.domain"%') / count(*) as r from entities)
select 'unresolved_stubs' as gap, round_even(r, 4) as ratio from a where r > 0 union all select 'domain_coverage', round_even(r, 4) from b where r < 0.5""")
def gap_rows(t):
    a = t.rels().agg(F.avg(P.is_stub("target_id").cast("double")).alias("r")).where("r > 0").select(F.lit("unresolved_stubs").alias("gap"), F.bround("r", 4).alias("ratio"))
    b = t.entities().agg(F.avg(F.coalesce(F.contains("metadata_json", F.lit('"bsg.domain"')), F.lit(False)).cast("double")).alias("r")).where("r < 0.5")
    return a.unionByName(b.select(F.lit("domain_coverage").alias("gap"), F.bround("r", 4).alias("ratio")))


@query("O-103", "select lower(case when o_orderkey % 3 = 0 then 'WHY' else 'NOTE' end) as rationale_kind, count(*) as n from orders group by 1")
def rationale_counts(t):
    text = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "# WHY: ").otherwise("// NOTE: "), "o_orderpriority")
    return A.count_by(code.rationale(t.raw("orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text"), "rationale_kind")


RULES = [U.Rule("big", 1, ("CLASS",), metadata=(("segment", "eq", "BUILDING"),), add_tags=("building",), put={"tier": "1"}), U.Rule("lib", 2, files=("lib/**",), put={"tier": "2"}), U.Rule("ship", 3, ("FUNCTION",), add_tags=("ship",))]
PLUGIN = {"big": "core", "lib": "core", "ship": "external"}


@query("O-105", """select 'core' as plugin, count(*) as hits from entities where (entity_type = 'CLASS' and metadata_json ->> '$.segment' = 'BUILDING') or file_path like 'lib/%' union all select 'external', count(*) from entities where entity_type = 'FUNCTION'""")
def plugin_hits(t):
    plugin = F.create_map(*[F.lit(x) for kv in PLUGIN.items() for x in kv])
    h = U.apply(t.entities(), RULES).select(F.explode("rule_ids").alias("rule_id"))
    return A.count_by(h.withColumn("plugin", F.element_at(plugin, F.col("rule_id"))), "plugin", name="hits")


@query("O-106", """with h as (select file_path, 'big' as rule_id from entities where entity_type = 'CLASS' and metadata_json ->> '$.segment' = 'BUILDING' union all select file_path, 'lib' from entities where file_path like 'lib/%' union all select file_path, 'ship' from entities where entity_type = 'FUNCTION')
select rule_id, count(*) as entities, count(distinct file_path) as files from h group by 1""")
def telemetry(t):
    return U.hits(U.apply(t.entities(), RULES))


@query("O-109", """select o_custkey, arg_min(c, (-p, c)) as category from (select o_custkey, case o_orderstatus when 'F' then 'TEST' when 'O' then 'CONFIG' else 'SOURCE' end as c, case o_orderstatus when 'F' then 4 when 'O' then 3 else 1 end as p from orders) group by 1""")
def file_categories(t):
    c = F.when(F.col("o_orderstatus") == "F", "TEST").when(F.col("o_orderstatus") == "O", "CONFIG").otherwise("SOURCE")
    return X.strongest_category(t.raw("orders").withColumn("category", c), "o_custkey", "category")


def _paired(keys: str) -> str:
    return f"""with a as (select {keys}, id, row_number() over (partition by {keys} order by id) as k from v_old), b as (select {keys}, id, row_number() over (partition by {keys} order by id) as k from v_new)
select a.id as old_id, b.id as id from a join b using ({keys}, k)"""


@query("O-115", _paired("file_id, start_line"))
def line_pairs(t):
    return X.tiebreak_pairs(*t.versions(), ["file_id", "start_line"])


@query("O-117", _paired("file_id, name"))
def name_pairs(t):
    return X.tiebreak_pairs(*t.versions(), ["file_id", "name"])


@query("O-118", """with c as (select p_name as ref, 'p:' || p_brand as target, 0 as rank from part where p_size < 25 union all select p_name, 'x:' || p_type, 1 from part), d as (select ref, target, min(rank) as rank from c group by 1, 2)
select ref, arg_min(target, (rank, target)) as "primary", string_agg(target, ',' order by rank, target) as candidates from d group by 1""")
def candidates(t):
    p = t.raw("part")
    c = p.where("p_size < 25").select(F.col("p_name").alias("ref"), F.concat(F.lit("p:"), "p_brand").alias("target"), F.lit(0).alias("rank")).unionByName(p.select(F.col("p_name").alias("ref"), F.concat(F.lit("x:"), "p_type").alias("target"), F.lit(1).alias("rank")))
    d = c.groupBy("ref", "target").agg(F.min("rank").alias("rank"))
    g = d.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("rank", "target"))).alias("l"))
    return g.select("ref", F.get("l", F.lit(0)).target.alias("primary"), F.array_join(F.transform("l", lambda x: x.target), ",").alias("candidates"))


@query("O-121", "select p_partkey, p_name || case when k > 1 then ' (' || k || ')' else '' end as p_name from (select *, row_number() over (partition by p_name order by p_partkey) as k from part)")
def distinct_labels(t):
    return X.numbered(t.raw("part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("O-123", f"""select entity_id from (select entity_id, file_path, start_line as sl, is_exported from entities where entity_type = 'FUNCTION' and not {QUARANTINE}) order by is_exported desc, sl, file_path, entity_id limit 20""")
def total_order(t):
    e = t.entities().where((F.col("entity_type") == "FUNCTION") & ~P.quarantined())
    return e.orderBy(F.desc("is_exported"), "start_line", "file_path", "entity_id").limit(20).select("entity_id")


@query("O-190", f"""select score, count(*) as n from (select (case when b = 'Customer#000000012' then 100 when starts_with(b, 'Customer#000000012') then 60 when contains(b, 'Customer#000000012') then 30 else 10 end + case when entity_type in ('CLASS', 'METHOD', 'FUNCTION') then 40 when entity_type = 'MODULE' then 30 else 0 end
 + case when is_exported then 15 else 0 end + case when contains(coalesce(fqn, ''), 'Customer#000000012') then 20 else 0 end)::int as score from (select *, regexp_replace(name, '_\\[[0-9a-fA-F]+\\]$', '') as b from entities)) group by 1""")
def scores(t):
    return A.count_by(t.entities().withColumn("score", P.score("Customer#000000012").cast("int")), "score")


@query("O-124", f"""with p as ({registry.PAIRS}), d as (select id, count(*) as d from (select unnest([u, v]) as id from p) group by 1), r as (select *, row_number() over (order by d) - 1 as k, count(*) over () as n from d)
select id from r where d > (select d from r where k = least(n - 1, floor(0.99 * n)))""")
def super_hubs(t):
    return C.hubs(C.pair_weights(t.rels()))


@query("O-129", """with p as (select source_id, target_id, min(case relation_type when 'CALLS' then 0 when 'IMPORTS' then 2 when 'READS' then 3 else 3 end) as pr from rels where relation_type in ('CALLS', 'IMPORTS', 'READS', 'WRITES') group by 1, 2)
select source_id, target_id from p qualify row_number() over (partition by source_id order by pr, target_id) <= 2""")
def best_neighbours(t):
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in P.PRIORITY.items() for x in kv]), F.col("relation_type"))
    e = t.rels().where("relation_type in ('CALLS', 'IMPORTS', 'READS', 'WRITES')").groupBy("source_id", "target_id").agg(F.min(rank).alias("pr"))
    w = Window.partitionBy("source_id").orderBy("pr", "target_id")
    return e.withColumn("r", F.row_number().over(w)).where("r <= 2").select("source_id", "target_id")


@query("O-130", "select event_id from changelog order by ts desc, event_id limit 30 offset 20")
def page(t):
    return t.changelog().orderBy(F.desc("ts"), "event_id").offset(20).limit(30).select("event_id")


@query("O-135", "select file_path, n from (select *, sum(n) over (order by n desc, file_path) as s from (select file_path, count(*) as n from entities group by 1)) where s <= 900")
def greedy_sample(t):
    return X.greedy_files(A.count_by(t.entities(), "file_path"), 900)


@query("O-140", "select p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type), 'ring']))), ',') as tags, len(list_intersect(string_split(p_name, ' '), ['ring', 'red']))::int as shared from part")
def tag_sets(t):
    a, b = F.split("p_name", " "), F.array(F.lower("p_type"), F.lit("ring"))
    return t.raw("part").select("p_partkey", F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("tags"), F.size(F.array_intersect(a, F.array(F.lit("ring"), F.lit("red")))).alias("shared"))


@query("O-148", "select coalesce(metadata_json ->> '$.\"bsg.domain\"', 'SOURCE') as tier, count(*) as n from entities group by 1")
def tiers(t):
    key = F.coalesce(F.get_json_object("metadata_json", "$['bsg.domain']"), X.service_tag(), P.category())
    return A.count_by(t.entities().withColumn("tier", key), "tier")


@query("O-149", """with t as (select p_brand || '/' || p_size as community, unnest(list_distinct(string_split(lower(p_name), ' '))) as token from part), tf as (select community, token, count(*) as tf from t where length(token) >= 2 group by 1, 2), df as (select token, count(*) as df from tf group by 1), n as (select count(distinct community) as n from tf),
s as (select community, token, round_even(tf * ln((n + 1) / (df + 1)), 6) as score from tf join df using (token), n), r as (select *, row_number() over (partition by community order by score desc, token) as r from s where score > 0)
select community, string_agg(token, ' ' order by r) as label from r where r <= 3 group by 1""")
def labels(t):
    return C.term_labels(t.raw("part").select(F.concat_ws("/", "p_brand", "p_size").alias("community"), F.col("p_name").alias("name")))


REFS = "case p_partkey % 3 when 0 then p_type || '.' || p_name when 1 then p_name else 'other.' || p_name end"


@query("O-150", f"""with {NODES}, refs as (select distinct {REFS} as ref from part), nm as (select distinct p_name as name, p_type as module, file_path as path from part_paths where p_size < 20),
l as (select ref, case when contains(ref, '.') then split_part(ref, '.', 1) end as lead, regexp_extract(ref, '[^.]*$') as name from refs),
w as (select ref, lead, count(*) as c, arg_min(path, (case when lead = module then 0 else 1 end, module, path)) as path from l join nm using (name) group by 1, 2)
select distinct target_id as id, case when path is null then 'external_unresolved' else 'direct' end as kind, path from rels left join nodes on id = target_id where not starts_with(target_id, 'unresolved:')
union all select 'unresolved:p::' || l.ref, case when l.lead in ('ECONOMY', 'SMALL') then 'module' when w.path is not null and (l.lead is not null or c = 1) then 'name' else 'unresolved' end, case when l.lead in ('ECONOMY', 'SMALL') then 'lib/' || l.lead when l.lead is not null or c = 1 then w.path end from l left join w on l.ref = w.ref""")
def resolved_ends(t):
    p = t.part_paths()
    r = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(".", "p_type", "p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("other."), "p_name"))
    ids = t.rels().where(~P.is_stub("target_id")).select(F.col("target_id").alias("id")).unionByName(p.select(F.concat(F.lit("unresolved:p::"), r).alias("id")))
    mods = t.spark.createDataFrame([("ECONOMY", "lib/ECONOMY"), ("SMALL", "lib/SMALL")], "module string, path string")
    names = p.where("p_size < 20").select(F.col("p_name").alias("name"), F.col("p_type").alias("module"), F.col("file_path").alias("path"))
    return L.endpoints(ids, nodes(t), mods, names, ["os", "sys"])


@query("O-151", "with s as (select distinct p_name as name, file_path as path from part_paths where p_size < 10) select name, path, min(p_partkey) as target from s join part_paths on p_name = name and file_path = path group by 1, 2")
def redirected(t):
    p = t.part_paths().select(F.col("p_name").alias("name"), F.col("file_path").alias("path"), "p_partkey", "p_size")
    return p.join(p.where("p_size < 10").select("name", "path").distinct(), ["name", "path"], "left_semi").groupBy("name", "path").agg(F.min("p_partkey").alias("target"))


@query("O-153", """with a as (select o_custkey as scope, o_orderpriority as var, o_orderkey as line, 'T' || o_orderkey as type from orders where o_orderstatus = 'F'), p as (select c_custkey as scope, '1-URGENT' as var, c_mktsegment as type from customer where c_mktsegment = 'BUILDING'),
c as (select o_orderkey as call_id, o_custkey as scope, o_orderpriority as var, o_orderkey as line from orders), n as (select call_id, c.scope, c.var, arg_max(a.type, a.line) as t from c left join a on a.scope = c.scope and a.var = c.var and a.line <= c.line group by 1, 2, 3)
select call_id, coalesce(p.type, t) as type, (case when p.type is not null then 0.9 when t is not null then 0.75 else 0 end)::double as confidence from n left join p on p.scope = n.scope and p.var = n.var""")
def receiver_types(t):
    o = t.raw("orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("var"), F.col("o_orderkey").alias("line"), "o_orderstatus")
    assigned = o.where("o_orderstatus = 'F'").select("scope", "var", "line", F.concat(F.lit("T"), F.col("call_id").cast("string")).alias("type"))
    params = t.raw("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("scope"), F.lit("1-URGENT").alias("var"), F.col("c_mktsegment").alias("type"))
    return L.receivers(o.drop("o_orderstatus"), params, assigned)


@query("O-158", "select 'EXTERNAL_SYMBOL' as entity_type, count(*) as n from (select distinct regexp_extract(target_id, '::(.*)$', 1) as ref from rels where starts_with(target_id, 'unresolved:')) where ref not in (select 'lib.' || p_partkey from part where p_partkey % 2 = 0)")
def externals(t):
    refs = t.rels().where(P.is_stub("target_id")).select(F.regexp_extract("target_id", "::(.*)$", 1).alias("ref")).distinct()
    known = t.raw("part").where("p_partkey % 2 = 0").select(F.concat(F.lit("lib."), F.col("p_partkey").cast("string")).alias("ref"))
    return A.count_by(refs.join(known, "ref", "left_anti").withColumn("entity_type", F.lit("EXTERNAL_SYMBOL")), "entity_type")


@query("O-159", """with s as (select r_name, n_name, n_nationkey from nation join region on n_regionkey = r_regionkey) select r_name || '.Main' as alias, r_name || '.' || n_name || '.Main' as symbol from s union all select r_name || '.run_' || n_name, r_name || '.' || n_name || '.run' from s where n_nationkey % 2 = 0""")
def aliases(t):
    n = t.nations()
    text = F.concat(F.lit("import os\nfrom ."), "n_name", F.lit(" import Main, run as run_"), "n_name", F.lit("  # names\n"))
    symbols = n.select(F.concat_ws(".", "r_name", "n_name", F.lit("Main")).alias("symbol")).union(n.where("file_id % 2 = 0").select(F.concat_ws(".", "r_name", "n_name", F.lit("run"))))
    return L.reexports(n.select(F.col("r_name").alias("package"), text.alias("text")), symbols)


@query("O-161", """with r as (select distinct c_mktsegment as ref, r_name || '.' || n_name as scope, r_name from customer join nations on c_nationkey = file_id)
select ref, scope, case when ref = 'BUILDING' then 'in.' || r_name when ref <> 'MACHINERY' then 'top.' || ref else 'ext.' || scope end as symbol from r""")
def scoped_symbols(t):
    n = F.broadcast(t.nations())  # one row a nation
    r = t.raw("customer").join(n, F.col("c_nationkey") == F.col("file_id")).select(F.col("c_mktsegment").alias("ref"), F.concat_ws(".", "r_name", "n_name").alias("scope"), "r_name").distinct()
    top = r.where("ref not in ('MACHINERY')").select(F.col("ref").alias("name"), F.lit("").alias("scope"), F.concat(F.lit("top."), "ref").alias("symbol"), F.lit(False).alias("external")).distinct()
    region = r.where("ref = 'BUILDING'").select(F.col("ref").alias("name"), F.col("r_name").alias("scope"), F.concat(F.lit("in."), "r_name").alias("symbol"), F.lit(False).alias("external")).distinct()
    ext = r.where("ref in ('MACHINERY', 'HOUSEHOLD')").select(F.col("ref").alias("name"), "scope", F.concat(F.lit("ext."), "scope").alias("symbol"), F.lit(True).alias("external"))
    return L.scoped(r.select("ref", "scope"), top.unionByName(region).unionByName(ext))


@query("O-163", f"{SOURCED} select relation_type, count(*) as n from sourced where coalesce(source_file, '') not like 'lib/economy/%' and coalesce(target_file, '') not like 'lib/economy/%' group by 1")
def evicted(t):
    gone = nodes(t).where("path like 'lib/economy/%'").select("id")
    r = t.rels()
    for end in ("source_id", "target_id"):
        r = r.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return A.count_by(r, "relation_type")


@query("O-166", "select 'Client' as tag, count(*) as n from entities where entity_type = 'CLASS' union all select 'Far', count(*) from entities where file_path like 'src/asia/%' union all select 'Lib', count(*) from entities where file_path like 'lib/%' and entity_type = 'CONSTANT'")
def tagged(t):
    tokens, types = {"Client": {"customer"}, "Far": {"asia"}, "Lib": {"lib"}}, {"Client": {"CLASS"}, "Lib": {"CONSTANT"}}
    return A.count_by(S.tag(t.entities(), tokens, types).select(F.explode("tags").alias("tag")), "tag")


@query("O-170", "select case when entity_type = 'MODULE' then 'GLOBAL' when entity_type = 'CLASS' then 'MODULE' when entity_type = 'METHOD' then 'CLASS' else 'MODULE' end as tier, count(*) as n from entities group by 1")
def scope_tiers(t):
    return A.count_by(t.entities().withColumn("tier", X.scope_tier()), "tier")


@query("O-173", "select entity_type, count(*) as n, 0::bigint as tags, count(*) filter (file_path like 'lib/%') as kept from entities group by 1")
def stripped(t):
    rules = [*RULES, U.Rule("own", 9, files=("lib/**",), put={"origin": "lib"})]
    s = X.stripped(U.apply(t.entities(), rules), ["tier"])
    return s.groupBy("entity_type").agg(F.count("*").alias("n"), F.sum(F.size("tags") + F.size("rule_ids")).alias("tags"), F.sum(F.size("put")).alias("kept"))


@query("O-175", """with s as (select o_custkey as k, o_orderkey % 1000 as start, o_orderkey % 1000 + 40 as "end" from orders), w as (select *, max("end") over (partition by k order by start, "end" rows between unbounded preceding and 1 preceding) as u from s)
select k, sum("end" - start)::bigint as covered, sum(case when u is null then 0 else greatest(0, least("end", u) - start) end)::bigint as overlap, round_even(sum("end" - start) / 1040, 4) as coverage from w group by 1""")
def covered(t):
    o = t.raw("orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 1000).alias("start"), (F.col("o_orderkey") % 1000 + 40).alias("end"), F.lit(1040).alias("size"))
    return X.coverage(o, "k")


@query("O-181", f"{SOURCED}, pg as (select id from nodes where regexp_matches(name, 'Customer#0000000[0-4]') order by path, id limit 20 offset 5) select 'node' as part, id as a, null as b, null as relation_type from pg union all select distinct 'edge', source_id, target_id, relation_type from rels where source_id in (select id from pg) or target_id in (select id from pg)")
def graph_query(t):
    pg = nodes(t).where(P.name_matches("Customer#0000000[0-4]")).orderBy("path", "id").offset(5).limit(20).select("id")
    e = X.directed(t.rels(), pg, "both").select("source_id", "target_id", "relation_type").distinct()
    none = F.lit(None).cast("string")
    return pg.select(F.lit("node").alias("part"), F.col("id").alias("a"), none.alias("b"), none.alias("relation_type")).unionByName(e.select(F.lit("edge").alias("part"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), "relation_type"))


@query("O-182", f"with {NODES}, e as (select id from nodes where name = 'Customer#000000001') select source_id, target_id, relation_type, line from rels where source_id in (select id from e) or target_id in (select id from e)")
def get_entity(t):
    return X.directed(t.rels(), nodes(t).where("name = 'Customer#000000001'").select("id"), "both").select("source_id", "target_id", "relation_type", "line")


@query("O-183", "select 0 as hop, 'o:1' as id, null as relation_type union all select 1, 'c:' || o_custkey, 'CALLS' from orders where o_orderkey = 1 union all select 2, 'n:' || c_nationkey, 'IMPORTS' from orders join customer on c_custkey = o_custkey where o_orderkey = 1")
def trace_path(t):
    r = P.forward(t.rels()).where(F.col("relation_type").isin(*P.PRIORITY) & ~P.is_stub("target_id"))
    e = r.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"), "relation_type", F.element_at(F.create_map(*[F.lit(x) for kv in P.PRIORITY.items() for x in kv]), F.col("relation_type")).alias("priority"))
    e = G.cut(e)
    via = e.where("u = 'o:1' and relation_type = 'CALLS'").select("v").first()[0]
    return G.trace_path(e, "o:1", e.where((F.col("u") == via) & (F.col("relation_type") == "IMPORTS")).select("v").first()[0], 5)


CELLS = "with c as (select 'out' as way, target_file as other, relation_type, confidence from sourced where source_file = '{f}' and target_file <> source_file union all select 'in', source_file, relation_type, confidence from sourced where target_file = '{f}' and target_file <> source_file)".replace("{f}", FILE)


@query("O-186", f"{SOURCED}, {CELLS[5:]} select way, other, relation_type, count(*) as n, round_even(max(coalesce(confidence, 1.0::float))::double, 4) as max_confidence from c group by 1, 2, 3")
def file_connectivity(t):
    r = sourced(t).where("source_file <> target_file")
    c = r.where(F.col("source_file") == FILE).select(F.lit("out").alias("way"), F.col("target_file").alias("other"), "relation_type", "confidence")
    c = c.unionByName(r.where(F.col("target_file") == FILE).select(F.lit("in").alias("way"), F.col("source_file").alias("other"), "relation_type", "confidence"))
    return c.groupBy("way", "other", "relation_type").agg(F.count("*").alias("n"), F.bround(F.max(F.coalesce("confidence", F.lit(1.0).cast("float"))).cast("double"), 4).alias("max_confidence"))


@query("O-184", f"{SOURCED} select 'entity' as part, id as item, null as relation_type, 1::bigint as n from nodes where path = '{FILE}' union all select 'dependency', target_file, relation_type, count(*) from sourced where source_file = '{FILE}' and target_file <> source_file group by 2, 3")
def file_graph(t):
    own = nodes(t).where(F.col("path") == FILE).select(F.lit("entity").alias("part"), F.col("id").alias("item"), F.lit(None).cast("string").alias("relation_type"), F.lit(1).cast("long").alias("n"))
    d = A.count_by(sourced(t).where((F.col("source_file") == FILE) & (F.col("target_file") != FILE)), "target_file", "relation_type")
    return own.unionByName(d.select(F.lit("dependency").alias("part"), F.col("target_file").alias("item"), "relation_type", "n"))


@query("O-192", "select file_path, '{\"entities\":' || count(*) || ',\"exported\":' || count(*) filter (is_exported) || ',\"language\":\"' || regexp_extract(file_path, '[^.]*$') || '\"}' as view from entities group by 1")
def files_view(t):
    g = t.entities().groupBy("file_path").agg(F.count("*").alias("entities"), F.count(F.when(F.col("is_exported"), 1)).alias("exported"))
    return g.select("file_path", F.to_json(F.struct("entities", "exported", F.substring_index("file_path", ".", -1).alias("language"))).alias("view"))


@query("O-199", """with a as (select file_id, string_agg(name, ',' order by name) as names from v_old group by 1), b as (select file_id, string_agg(name, ',' order by name) as names from v_new group by 1)
select b.file_id as id, min('L' || a.file_id) as label from b join a using (names) group by 1""".replace("join a using (names)", "join a on a.names = b.names"))
def carried_labels(t):
    old, new = [v.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names")).withColumnRenamed("file_id", "id") for v in t.versions()]
    return X.carried(old.withColumn("label", F.concat(F.lit("L"), F.col("id").cast("string"))), new, ["names"])


@query("O-200", "select lang, count(*) as n from documents where doc_id % 10 <> 0 and n_chars <= 50000 group by 1")
def file_events(t):
    path = F.when(F.col("doc_id") % 10 == 0, F.concat("lang", F.lit("/.cache/"), "source")).otherwise(F.concat("lang", F.lit("/"), "source", F.lit(".txt")))
    return A.count_by(t.raw("documents").withColumn("path", path).where(changes.relevant("path", "n_chars", 50_000)), "lang")


@query("O-202", """with g as (select user_id, ts, time_bucket(interval 1 hour, ts) as slot, case when ts <= lag(ts) over w + interval 10 minute then 0 else 1 end as s from events window w as (partition by user_id, time_bucket(interval 1 hour, ts) order by ts)),
k as (select user_id, slot, ts, sum(s) over (partition by user_id, slot order by ts rows unbounded preceding) as k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_at, count(*) as n from k group by user_id, slot, k""")
def bounded_bursts(t):
    e = t.raw("events").withColumn("path", F.col("event_type"))
    return changes.flushes(e, "user_id", "ts", "path", gap="10 minutes", staleness="1 hour").select("user_id", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"), "n")


@query("O-204", """select * from (values ('index', 'boundary'), ('index.lock', 'lock'), ('refs/heads/main', 'boundary'), ('refs/remotes/origin/main', 'ignore'), ('rebase-merge/done', 'in_progress'), ('rebase-merge', 'boundary'), ('objects/ab/cd', 'ignore'), ('FETCH_HEAD', 'ignore'), ('HEAD', 'boundary'), ('logs/HEAD', 'ignore')) v(path, kind)""")
def boundaries(t):
    paths = ["index", "index.lock", "refs/heads/main", "refs/remotes/origin/main", "rebase-merge/done", "rebase-merge", "objects/ab/cd", "FETCH_HEAD", "HEAD", "logs/HEAD"]
    return t.spark.createDataFrame([(p,) for p in paths], "path string").select("path", changes.boundary(F.col("path"), F.lit("deleted"), F.lit(False)).alias("kind"))


@query("O-207", "select user_id, case when count(*) > 70 then 'full_scan' when count(*) >= 60 then 'flush' else 'wait' end as mode from events group by 1")
def saturation(t):
    return A.count_by(t.raw("events"), "user_id").select("user_id", changes.scan_mode(F.col("n"), 70, 60).alias("mode"))


@query("O-209", "select user_id, case when count(*) filter (event_type = 'signup') > 15 then 'patching' when max(value) > 90 then 'held' when count(*) filter (event_type = 'error') > 0 then count(*) filter (event_type = 'error') || ' pending' end as banner from events group by 1")
def banners(t):
    g = t.raw("events").groupBy("user_id").agg(*[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in ("signup", "error")], F.max("value").alias("v"))
    return g.select("user_id", changes.banner(F.col("signup") > 15, F.col("v") > 90, F.lit(False), F.col("error"), F.lit(False)).alias("banner"))


from .functions import render  # noqa: E402
from .sources import extract, manifests  # noqa: E402

PY = 'import os\nfrom .lib import tool as t\nLIMIT = 3\nclass Part{k}(Base):\n    size: int = {k}\n    def show(self):\n        return os.path.join(t(self), "x")\n'


@query("O-08", """select p_partkey, unnest(['reference', 'reference', 'definition', 'definition', 'reference', 'definition', 'definition', 'reference', 'reference']) as record, unnest(['os', '.lib.tool', 'LIMIT', 'Part' || p_partkey, 'Base', 'size', 'show', 'os.path.join', 't']) as name,
unnest(['IMPORTS', 'IMPORTS', 'CONSTANT', 'CLASS', 'INHERITS', 'FIELD', 'METHOD', 'CALLS', 'CALLS']) as kind, unnest(['', '', '', '', 'Part' || p_partkey, 'Part' || p_partkey, 'Part' || p_partkey, 'Part' || p_partkey || '.show', 'Part' || p_partkey || '.show']) as owner, unnest([1, 2, 3, 4, 4, 5, 6, 7, 7]) as start_line from part""")
def extracted(t):
    body = F.replace(F.lit(PY), F.lit("{k}"), F.col("p_partkey").cast("string"))
    return extract.python(t.raw("part").select("p_partkey", body.alias("text")), "p_partkey", "text").drop("end_line")


def _manifests(t):
    n = F.col("n_nationkey").cast("string")
    go = F.concat(F.lit("module x\n\nrequire (\n\tgithub.com/a/"), F.lower("n_name"), F.lit(" v1."), n, F.lit(".0\n)\n"))
    gem = F.concat(F.lit("source 'x'\ngem '"), F.lower("n_name"), F.lit("', '~> "), n, F.lit("'\ngem 'plain'\n"))
    both = F.array(F.struct(F.concat(n, F.lit("/go.mod")).alias("path"), go.alias("text")), F.struct(F.concat(n, F.lit("/Gemfile")).alias("path"), gem.alias("text")), F.struct(F.lit("readme.md").alias("path"), go.alias("text")))
    return manifests.dependencies(t.raw("nation").select(F.inline(both)))


DEPS = "deps as (select n_nationkey || '/go.mod' as path, 'go' as manager, 'github.com/a/' || lower(n_name) as name, 'v1.' || n_nationkey || '.0' as version from nation union all select n_nationkey || '/Gemfile', 'gem', lower(n_name), '~> ' || n_nationkey from nation union all select n_nationkey || '/Gemfile', 'gem', 'plain', null from nation)"


@query("O-18", f"with {DEPS} select * from deps")
def manifest_rows(t):
    return _manifests(t)


@query("O-19", f"with {DEPS} select distinct 'dependency' as scope, manager, name, version from deps where name <> 'plain' union all select 'workspace', 'gem', 'plain', '1.0'")
def workspace(t):
    return manifests.workspace_rows(_manifests(t), t.spark.createDataFrame([("gem", "plain", "1.0")], "manager string, name string, version string"))


@query("O-128", "select entity_id from entities where contains(name, 'order_12') order by (case when name = 'order_12' then 100 when starts_with(name, 'order_12') then 60 else 30 end) desc, start_line, file_path, entity_id limit 25")
def ranked(t):
    return P.search(t.entities(), "order_12").select("entity_id")


@query("O-155", "with c as (select p_name as ref, count(distinct 'p:' || p_brand) as n from part group by 1) select ref as stub, (case when n > 1 then 0.5 else 0.95 end)::double as confidence, n as n_candidates from c")
def ambiguity(t):
    p = t.raw("part").select(F.col("p_name").alias("ref"), F.concat(F.lit("p:"), "p_brand").alias("target"))
    return R.resolve(p.select(F.col("ref").alias("stub"), "ref").distinct(), {"exact_match": p}).select("stub", "confidence", "n_candidates")


@query("O-157", "select min('p:' || p_brand) as target from part where p_name = (select min(p_name) from part)")
def one_stub(t):
    p = t.raw("part").select(F.col("p_name").alias("ref"), F.concat(F.lit("p:"), "p_brand").alias("target"))
    ref_ = p.agg(F.min("ref")).first()[0]  # one stub asked for; its filter reaches the scan
    return R.resolve(t.spark.createDataFrame([(ref_, ref_)], "stub string, ref string"), {"exact_match": p.where(F.col("ref") == ref_)}).select("target")


@query("O-171", "select 'big' as a, 'lib' as b, 'tier' as key")
def conflicts(t):
    return t.spark.createDataFrame(U.conflicts(RULES), "a string, b string, key string")


PLUGIN_TEXT = """
schema_version: 2
rules:
  - rule_id: big
    priority: 1
    matchers: {entity_types: [CLASS], metadata_conditions: [{key: segment, operator: eq, value: BUILDING}]}
    actions: {add_tags: [building]}
  - rule_id: next
    priority: 2
    matchers: {usn_tags_any: [building], name_patterns: ["1$"]}
  - {rule_id: off, enabled: false}
"""


@query("O-172", "select 'big' as rule_id, count(*) as n from entities where entity_type = 'CLASS' and metadata_json ->> '$.segment' = 'BUILDING' union all select 'next', count(*) from entities where entity_type = 'CLASS' and metadata_json ->> '$.segment' = 'BUILDING' and ends_with(name, '1')")
def loaded(t):
    h = U.hits(U.apply(t.entities(), U.load(PLUGIN_TEXT)))
    return h.select("rule_id", F.col("entities").alias("n"))


@query("O-169", "select case when metadata_json ->> '$.segment' = 'BUILDING' and entity_type = 'CLASS' then 'big' else '' end || case when file_path like 'lib/%' then 'lib' else '' end || case when entity_type = 'FUNCTION' then 'ship' else '' end as rules, count(*) as n from entities group by 1")
def stamped(t):
    return A.count_by(U.apply(t.entities(), RULES).withColumn("rules", F.array_join("rule_ids", "")), "rules")


@query("O-197", None)
def gate(t):
    return U.sample_gate(t.entities(), RULES)


@query("O-167", """with h as (select entity_id as target_id from entities where lower(name) like 'customer#00000000%' order by entity_id limit 10) select entity_id as source_id, target_id, 0.95::double as confidence from entities, h where entity_type = 'FUNCTION' and ends_with(name, '1')""")
def declared(t):
    e = t.entities()
    src = e.where("entity_type = 'FUNCTION' and endswith(name, '1')").select(F.col("entity_id").alias("source_id"), F.lit("low").alias("hint"), F.lit(1.5).alias("c"))
    hit = X.hinted(e, {"low": "customer#00000000*"}).withColumnRenamed("entity_id", "target_id")  # ten targets a hint at most
    return src.join(hit, "hint").select("source_id", "target_id", F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.col("c"))).alias("confidence"))


@query("O-195", "select '- `' || id || '` ' || name || ' (' || path || ')' as line from nodes where starts_with(id, 's:')".replace("select", f"with {NODES} select", 1))
def markdown_lines(t):
    return nodes(t).where(F.startswith("id", F.lit("s:"))).select(render.node_line(F.col("id"), F.col("name"), F.col("path")).alias("line"))


@query("O-26", "select n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' as view from nation")
def json_view(t):
    return t.raw("nation").select("n_nationkey", render.sorted_json(name=F.col("n_name"), key=F.col("n_nationkey")).alias("view"))


@query("O-156", "select relation_type, count(*) as n from rels where not (starts_with(target_id, 'unresolved:') and regexp_extract(target_id, '[^.]*$') in ('17', '34', '51')) group by 1")
def pruned(t):
    return A.count_by(R.prune_stubs(t.rels(), ["17", "34", "51"]), "relation_type")


@query("O-146", None)
def cohesion(t):
    o = t.raw("orders").select(ref("c", "o_custkey").alias("u"), ref("d", "o_orderpriority").alias("v")).distinct()
    m = t.raw("customer").select(ref("c", "c_custkey").alias("id"), F.col("c_mktsegment").alias("community"))
    return C.cohesion(o, m.unionByName(t.spark.createDataFrame([("d:1-URGENT", "BUILDING")], "id string, community string")))
