"""More registered queries: lookups, records, rankings, set algebra and the composite calls of the public surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import registry
from .functions import names as N
from .operators import aggregates as A
from .operators import communities as C
from .operators import filters as P
from .operators import graph as G
from .operators import history as H
from .operators import joins as J
from .operators import lookup as L
from .operators import records as X
from .operators import resolution as R
from .operators import rules as U
from .operators import semantic as S
from .plans.projection import Tables
from .sources import code

NAMES: list[str] = []
QUARANTINE = registry.QUARANTINE


def query(name: str, sql: str | None):
    NAMES.append(name)
    return registry.query(name, sql)


def ref(tag: str, col: str):
    return F.concat(F.lit(tag + ":"), F.col(col).cast("string"))


def nodes(t: Tables) -> DataFrame:
    """(id, path, name): the graph's nodes under the slim ids that edges use."""
    n = t.nations()
    nat = F.broadcast(n.select("file_id", "file_path"))  # one row a nation
    c = t.raw("customer").join(nat, F.col("c_nationkey") == F.col("file_id"))
    s = t.raw("supplier").join(nat, F.col("s_nationkey") == F.col("file_id"))
    o = t.raw("orders").join(c.select("c_custkey", "file_path"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        n.select(ref("n", "file_id").alias("id"), F.col("file_path").alias("path"), F.col("n_name").alias("name"))
        .unionByName(c.select(ref("c", "c_custkey").alias("id"), F.col("file_path").alias("path"), F.col("c_name").alias("name")))
        .unionByName(s.select(ref("s", "s_suppkey").alias("id"), F.col("file_path").alias("path"), F.col("s_name").alias("name")))
        .unionByName(o.select(ref("o", "o_orderkey").alias("id"), F.col("file_path").alias("path"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("name")))
        .unionByName(t.part_paths().select(ref("p", "p_partkey").alias("id"), F.col("file_path").alias("path"), F.col("p_name").alias("name")))
    )


NODES = """nodes as (select 'n:' || file_id as id, file_path as path, n_name as name from nations union all select 'c:' || c_custkey, file_path, c_name from customer join nations on c_nationkey = file_id
union all select 's:' || s_suppkey, file_path, s_name from supplier join nations on s_nationkey = file_id union all select 'o:' || o_orderkey, file_path, 'order_' || o_orderkey from orders join customer on o_custkey = c_custkey join nations on c_nationkey = file_id
union all select 'p:' || p_partkey, file_path, p_name from part_paths)"""
SOURCED = f"with {NODES}, sourced as (select r.*, a.path as source_file, b.path as target_file from rels r left join nodes a on a.id = source_id left join nodes b on b.id = target_id)"


def sourced(t: Tables) -> DataFrame:
    """rels with the files of both ends; the node table is read twice, joined on its id."""
    n = nodes(t)
    a, b = n.select(F.col("id").alias("source_id"), F.col("path").alias("source_file")), n.select(F.col("id").alias("target_id"), F.col("path").alias("target_file"))
    return t.rels().join(a, "source_id", "left").join(b, "target_id", "left")


@query("O-03", f"{SOURCED} select 'entities' as section, count(*) as n from entities where file_path = 'src/asia/nation_2.py' union all select 'relations', count(*) from sourced where source_file = 'src/asia/nation_2.py'")
def artifacts(t):
    e = t.entities().where("file_path = 'src/asia/nation_2.py'").agg(F.count("*").alias("n"))
    r = sourced(t).where("source_file = 'src/asia/nation_2.py'").agg(F.count("*").alias("n"))
    return e.select(F.lit("entities").alias("section"), "n").unionByName(r.select(F.lit("relations").alias("section"), "n"))


TOML = "'title = \"' || c_name || '\"' || chr(10) || '[account]' || chr(10) || 'key = ' || c_custkey || chr(10) || 'tags = [\"' || c_mktsegment || '\"]'"


@query("O-13", """select c_custkey, unnest(['root', 'root.title', 'root.account', 'root.account.key', 'root.account.tags']) as path, unnest(['SECTION', 'SETTING', 'SECTION', 'SETTING', 'SECTION']) as entity_type, unnest(['2', c_name, '2', c_custkey::varchar, '1']) as value from customer""")
def toml_source(t):
    body = F.concat(F.lit('title = "'), "c_name", F.lit('"\n[account]\nkey = '), F.col("c_custkey").cast("string"), F.lit('\ntags = ["'), "c_mktsegment", F.lit('"]'))
    return code.settings(t.raw("customer").select("c_custkey", body.alias("text")), "c_custkey", "text", "toml")


@query("O-13-yaml", """select n_nationkey, unnest(['root', 'root.name', 'root.region', 'root.region.key', 'root.gone']) as path, unnest(['SECTION', 'SETTING', 'SECTION', 'SETTING', 'SETTING']) as entity_type, unnest(['3', n_name, '1', n_regionkey::varchar, null]) as value from nation""")
def yaml_source(t):
    body = F.concat(F.lit('name: "'), "n_name", F.lit('"\nregion:\n  key: '), F.col("n_regionkey").cast("string"), F.lit("\ngone: null\n"))
    return code.settings(t.raw("nation").select("n_nationkey", body.alias("text")), "n_nationkey", "text", "yaml")


@query("O-13-css", """with c as (select page_id, unnest(regexp_extract_all(html, '<style[^>]*>([^<]*)</style>', 1)) as css from pages), r as (select page_id, unnest(regexp_extract_all(css, '([^{}]+)\\{([^{}]*)\\}', 1)) as s, unnest(regexp_extract_all(css, '([^{}]+)\\{([^{}]*)\\}', 2)) as b from c), d as (select page_id, s, unnest(string_split(b, ';')) as d from r)
select page_id, trim(s) as selector, trim(split_part(d, ':', 1)) as property, trim(regexp_replace(d, '^[^:]*:', '')) as value from d where contains(d, ':')""")
def css_source(t):
    css = t.raw("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<style[^>]*>([^<]*)</style>"), F.lit(1))).alias("css"))
    return code.css_rules(css, "page_id", "css")


@query("O-14", """select p_partkey, 'make_' || replace(p_name, ' ', '_') as name, 'FUNCTION' as entity_type, 2 as start_line from part union all select p_partkey, 'Part' || p_partkey, 'CLASS', 1 from part union all select p_partkey, 'show', 'FUNCTION', 4 from part""")
def fallback(t):
    body = F.concat(F.lit("class Part"), F.col("p_partkey").cast("string"), F.lit(":\n    def make_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("(self):\n        pass\nexport default async function show(x) {\n"))
    return code.definitions(t.raw("part").select("p_partkey", body.alias("text")), "p_partkey", "text")


@query("O-15", """select p_partkey, 2 as line, 'why' as rationale_kind, p_name as value from part union all select p_partkey, 3, 'note', p_brand from part""")
def markers(t):
    body = F.concat(F.lit("x = 1\ny = 2  # WHY: "), "p_name", F.lit("\n// NOTE: "), "p_brand", F.lit("\n# other: no\n"))
    return code.rationale(t.raw("part").select("p_partkey", body.alias("text")), "p_partkey", "text")


@query("O-17", """with g as (select o_orderkey, case o_orderkey % 5 when 0 then chr(10) || '  ' when 1 then '-----' when 2 then '# ' || o_orderpriority when 3 then 'from a import b' else 'x = ' || o_orderkey end as raw from orders)
select case when trim(raw, chr(10) || ' ') = '' then 'whitespace' when raw = '-----' then 'separator' when raw[1] = '#' then 'comment' when starts_with(raw, 'from ') then 'import' else 'code' end as kind, count(*) as n from g group by 1""")
def glue(t):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "\n  ").when(k == 1, "-----").when(k == 2, F.concat(F.lit("# "), "o_orderpriority")).when(k == 3, "from a import b").otherwise(F.concat(F.lit("x = "), F.col("o_orderkey").cast("string")))
    return A.count_by(t.raw("orders").withColumn("kind", code.gap_kind(raw)), "kind")


@query("O-28", """select entity_id, case when entity_type = 'CLASS' then 'pending' end as state, metadata_json ->> '$.segment' as segment from entities where entity_type in ('CLASS', 'FUNCTION')""")
def merged_states(t):
    e = t.entities().where("entity_type in ('CLASS', 'FUNCTION')").select("entity_id", "entity_type", "metadata_json")
    states = e.where("entity_type = 'CLASS'").select("entity_id", F.lit("pending").alias("state"), F.lit(None).cast("string").alias("target"))
    out = X.merged_metadata(e, states)
    return out.select("entity_id", F.get_json_object("metadata_json", "$.stub_resolution_state").alias("state"), F.get_json_object("metadata_json", "$.segment").alias("segment"))


@query("O-31", "select entity_type, count(*) as n from entities where entity_type in ('FUNCTION', 'METHOD', 'CLASS', 'CONSTANT', 'MODULE') group by 1")
def categories(t):
    return A.count_by(t.entities().where(F.col("entity_type").isin(*X.expand(["code"], ["setting"]))), "entity_type")


@query("O-37", "select source_id, target_id from rels where relation_type in ('CONTAINS', 'CONTAINED_WITHIN', 'CALLS', 'CALLED_BY')")
def of_types(t):
    return t.rels().where(X.relation_types(["contained_within", "calls"])).select("source_id", "target_id")


@query("O-39", """with p as (select 'c:' || c_custkey as id from customer where c_mktsegment = 'BUILDING') select 'outgoing' as direction, count(*) as n from rels where source_id in (select id from p) union all select 'incoming', count(*) from rels where target_id in (select id from p)
union all select 'both', count(*) from rels where source_id in (select id from p) or target_id in (select id from p)""")
def directions(t):
    page, out = t.raw("customer").where("c_mktsegment = 'BUILDING'").select(ref("c", "c_custkey").alias("id")), None
    for d in ("outgoing", "incoming", "both"):
        one = X.directed(t.rels(), page, d).agg(F.count("*").alias("n")).select(F.lit(d).alias("direction"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("O-41", "select coalesce(metadata_json ->> '$.\"bsg.domain\"', 'SOURCE') as category, count(*) as n from entities where file_path like 'src/%' group by 1")
def export_categories(t):
    c = F.coalesce(F.get_json_object("metadata_json", "$['bsg.domain']"), P.category())
    return A.count_by(t.entities().where(P.glob("src/**")).withColumn("category", c), "category")


@query("O-44", "select lang, count(*) as n from documents where contains(lower(text), 'license') or contains(lower(text), 'copyright') group by 1")
def by_content(t):
    return A.count_by(t.raw("documents").where(X.content_any(F.col("text"), ["License", "Copyright"])), "lang")


@query("O-46", "select count(*) as n from customer where c_acctbal > 0 and (c_mktsegment = 'BUILDING' or c_nationkey = 3)")
def gated(t):
    return t.raw("customer").where(X.gate([F.col("c_acctbal") > 0], [F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") == 3])).agg(F.count("*").alias("n"))


@query("O-47", "select entity_type, count(*) as n from entities where regexp_matches(lower(name), 'customer#0+1') and regexp_matches(file_path, '(?i)ASIA|AFRICA') group by 1")
def by_regexes(t):
    return A.count_by(t.entities().where(X.regexes([(F.col("name"), "CUSTOMER#0+1"), (F.col("file_path"), "ASIA|AFRICA")])), "entity_type")


@query("O-48", "select * from (values ('a+', true), ('(a+)+$', false), ('(a|b)*', false), ('[unclosed(', false), ('(ab)+', true), ('a\\\\(b+\\\\)+', true)) v(pattern, safe)".replace("\\\\", "\\"))
def safe_patterns(t):
    every = ["a+", "(a+)+$", "(a|b)*", "[unclosed(", "(ab)+", r"a\(b+\)+"]
    return t.spark.createDataFrame([(p, X.safe_regex(p)) for p in every], "pattern string, safe boolean")


@query("O-49", "select doc_id, (n_chars <> strlen(text)) as has_gap, starts_with(md5(text), '0') as hash_hit from documents where text is not null")
def by_bytes(t):
    d = t.raw("documents").where("text is not null")
    return d.select("doc_id", (F.col("n_chars") != F.octet_length("text")).alias("has_gap"), F.rlike(F.md5(F.col("text").cast("binary")), F.lit("^0")).alias("hash_hit"))


@query("O-51", f"{SOURCED} select source_id, target_id, relation_type, source_file, target_file, case when starts_with(target_id, 'unresolved:') then 'unresolved' when target_file is null then 'external' else 'direct' end as resolution from sourced")
def edge_records(t):
    kind = F.when(P.is_stub("target_id"), "unresolved").when(F.col("target_file").isNull(), "external").otherwise("direct")
    return sourced(t).select("source_id", "target_id", "relation_type", "source_file", "target_file", kind.alias("resolution"))


@query("O-52", "select key, value, count(*) as n from (select unnest(json_keys(metadata_json::json)) as key, metadata_json from entities where metadata_json is not null) x, lateral (select metadata_json::json ->> ('$.\"' || key || '\"') as value) where starts_with(key, 'bsg.') group by 1, 2")
def kept_metadata(t):
    m = t.entities().select(F.explode(X.agent_metadata("metadata_json", "entity_id")).alias("key", "value"))
    return A.count_by(m, "key", "value")


@query("O-53", "select count(*) as total, least(50, greatest(0, count(*) - 10)) as returned, 10 as \"offset\", 50 as \"limit\", count(*) > 60 as truncated, 0 as generation from entities where entity_type = 'CLASS'")
def paged(t):
    return X.page_meta(t.entities().where("entity_type = 'CLASS'"), 50, 10)


@query("O-61", f"with {NODES} select relation_type, count(*) filter (id is null) as missing, count(*) as n from rels left join nodes on id = target_id group by 1")
def lookup(t):
    r = t.rels().join(nodes(t).select(F.col("id").alias("target_id"), F.lit(1).alias("hit")), "target_id", "left")
    return r.groupBy("relation_type").agg(F.count(F.when(F.col("hit").isNull(), 1)).alias("missing"), F.count("*").alias("n"))


@query("O-63", f"{SOURCED}, p as (select id from nodes where path = 'src/asia/nation_2.py') select distinct source_id, target_id, relation_type from sourced where source_file = 'src/asia/nation_2.py' or target_id in (select id from p)")
def page_edges(t):
    page = nodes(t).where("path = 'src/asia/nation_2.py'").select("id")
    return X.directed(t.rels(), page, "both").select("source_id", "target_id", "relation_type").distinct()


@query("O-66", "select relation_type, count(*) as n from rels where source_id not in (select 'c:' || c_custkey from customer where c_acctbal < -900) and target_id not in (select 'c:' || c_custkey from customer where c_acctbal < -900) group by 1")
def unflagged(t):
    bad = t.raw("customer").where("c_acctbal < -900").select(ref("c", "c_custkey").alias("id"))
    r = t.rels()
    for end in ("source_id", "target_id"):
        r = r.join(bad.withColumnRenamed("id", end), end, "left_anti")
    return A.count_by(r, "relation_type")


@query("O-67", f"{SOURCED} select distinct target_id as id, target_file as path from sourced where source_file = 'src/asia/nation_2.py' and target_file <> source_file")
def foreign_neighbours(t):
    return sourced(t).where("source_file = 'src/asia/nation_2.py' and target_file <> source_file").select(F.col("target_id").alias("id"), F.col("target_file").alias("path")).distinct()


@query("O-72", """with d as (select distinct p_name as name, 'lib/economy/' || lower(replace(p_brand, '#', '_')) || '.ts' as here from part where p_type = 'ECONOMY'), c as (select p_name as name, p_partkey as id, file_path as there from part_paths where p_type <> 'ECONOMY'),
s as (select *, 10 * len(list_filter(range(1, 3), lambda i: list_slice(string_split(here, '/'), 1, i) = list_slice(string_split(there, '/'), 1, i))) + case when here = there then 1000 else 0 end as score from d join c using (name))
select name, here, id from s qualify row_number() over (partition by name, here order by score desc, length(there), id desc) = 1""")
def dangling_names(t):
    p = t.part_paths()
    refs = p.where("p_type = 'ECONOMY'").select(F.col("p_name").alias("name"), F.col("file_path").alias("here")).distinct()
    # of the candidates of one name and file only the last id can win, so they are pre-aggregated before the join
    cand = p.where("p_type <> 'ECONOMY'").groupBy(F.col("p_name").alias("name"), F.col("file_path").alias("there")).agg(F.max("p_partkey").alias("id"))
    a, b = F.split("here", "/"), F.split("there", "/")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    miss = F.array_position(same, F.lit(False))
    score = 10 * F.when(miss == 0, F.size(same)).otherwise(miss - 1) + F.when(F.col("here") == F.col("there"), 1000).otherwise(0)
    return J.first_by(refs.join(cand, "name").withColumn("score", score), ["name", "here"], F.desc("score"), F.length("there"), F.desc("id")).select("name", "here", "id")


@query("O-74", """with d as (select distinct p_type as dir, p_brand as family, p_name as name from part), k as (select dir, family, name, unnest(string_split(name, ' ')) as token from d)
select dir, family, a.name as a, b.name as b, count(*) as shared from k a join k b using (dir, family, token) where a.name < b.name group by all""")
def similar(t):
    k = t.raw("part").select(F.col("p_type").alias("dir"), F.col("p_brand").alias("family"), F.col("p_name").alias("name")).distinct().select("dir", "family", "name", F.explode(F.split("name", " ")).alias("token"))
    return k.withColumnRenamed("name", "a").join(k.withColumnRenamed("name", "b"), ["dir", "family", "token"]).where("a < b").groupBy("dir", "family", "a", "b").agg(F.count("*").alias("shared"))


@query("O-77", """with h as (select 'low' as hint, entity_id from entities where lower(name) like 'customer#00000000%' union all select 'ship', entity_id from entities where lower(name) like 'supplier#_____00_1') select hint, entity_id from h qualify row_number() over (partition by hint order by entity_id) <= 10""")
def glob_hints(t):
    return X.hinted(t.entities(), {"low": "Customer#00000000*", "ship": "supplier#?????00?1"}).select("hint", "entity_id")


@query("O-78", """with n as (select p_name as name, max(p_partkey) as base from part group by 1) select p_partkey as id, base as base_id from part join n on name = p_name where p_partkey <> base""")
def bases(t):
    p = t.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return L.hierarchy(p.select("id", F.array("name").alias("bases")), p.withColumn("ord", F.col("id")))


@query("O-79", """with i as (select n_name as u, r_name as v from nations union select r_name, 'WORLD' from region), c as (select u, v from i union select a.u, b.v from i a join i b on a.v = b.u),
m as (select distinct n_name as owner, c_mktsegment as name, n_name || '.' || c_mktsegment as id from customer join nations on c_nationkey = file_id union select distinct r_name, c_mktsegment, r_name || '.' || c_mktsegment from region, customer union select 'WORLD', 'BUILDING', 'WORLD.BUILDING')
select distinct x.id as child, y.id as parent from c join m x on x.owner = u join m y on y.owner = v and x.name = y.name""")
def override_pairs(t):
    n = t.nations()
    i = n.select(F.col("n_name").alias("u"), F.col("r_name").alias("v")).union(t.raw("region").select("r_name", F.lit("WORLD")))
    own = t.raw("customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("file_id")).select("n_name", "c_mktsegment").distinct()  # one row a nation
    seg = F.broadcast(t.raw("customer").select("c_mktsegment").distinct())  # the market segments, a fixed handful
    m = own.toDF("owner", "name").union(t.raw("region").select("r_name").join(seg, F.lit(True))).union(t.spark.createDataFrame([("WORLD", "BUILDING")], "owner string, name string"))
    return L.overrides(i, m.withColumn("id", F.concat_ws(".", "owner", "name")))


@query("O-80", """with m as (select o.id as old, min(n.id) as new from v_old o join v_new n on o.file_id = n.file_id and o.name = n.name and o.start_line = n.start_line and o.id <> n.id group by 1)
select id as source_id, coalesce(new, id) as target_id from v_old left join m on old = id""")
def remapped(t):
    old, new = [v.withColumn("entity_type", F.lit("METHOD")) for v in t.versions()]
    return L.remap(old.select(F.col("id").alias("source_id"), F.col("id").alias("target_id")), old, new)


@query("O-82", """with r as (select distinct file_path as here, './' || regexp_extract(file_path, '([^/]*)\\.ts$', 1) as ref from part_paths union select file_path, '../' || lower(p_type) || '/missing' from part_paths)
select here, ref, regexp_replace(here, '[^/]*$', '') || ref[3:] || '.ts' as path from r where starts_with(ref, './')""")
def relative(t):
    p = t.part_paths()
    here = F.col("file_path").alias("here")
    refs = p.select(here, F.concat(F.lit("./"), F.regexp_extract("file_path", r"([^/]*)\.ts$", 1)).alias("ref")).union(p.select(here, F.concat(F.lit("../"), F.lower("p_type"), F.lit("/missing"))))
    return L.relative_imports(refs, t.files().select(F.col("file_path").alias("path")))


@query("O-83", """with s as (select distinct 'm' || p_size % 5 || '.' || p_name as symbol from part), i as (select distinct p_brand as scope, 'm' || p_size % 5 as module from part), r as (select distinct p_brand as scope, p_name as ref from part)
select scope, ref, min(symbol) as symbol from r join i using (scope) join s on symbol = module || '.' || ref group by 1, 2""")
def sibling_modules(t):
    p = t.raw("part")
    module = F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string"))
    return L.siblings(p.select(F.col("p_brand").alias("scope"), F.col("p_name").alias("ref")), p.select(F.col("p_brand").alias("scope"), module.alias("module")), p.select(F.concat_ws(".", module, "p_name").alias("symbol")))


@query("O-93", "select count(*) filter (l_orderkey % 7 in (1, 3, 5)) as ambiguous from lineitem")
def ambiguous(t):
    """Edges with every form of the mark: true, false, the string "false", 0, a list, null, none."""
    forms = ['{"ambiguous":false}', '{"ambiguous":true}', '{"ambiguous":0}', '{"ambiguous":"false"}', '{"ambiguous":null}', '{"ambiguous":[0]}', "{}"]
    meta = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("l_orderkey") % 7 + 1).cast("int"))
    return A.ambiguous(t.raw("lineitem").select(meta.alias("metadata_json")))


FILE_EDGES = "with d as (select source_file as a, target_file as b, relation_type, count(*) as n from sourced where source_file <> target_file group by all)"


@query("O-96", f"{SOURCED} select 'out' as way, target_file as other, relation_type, count(*) as n from sourced where source_file = 'src/asia/nation_2.py' and target_file <> source_file group by all union all select 'in', source_file, relation_type, count(*) from sourced where target_file = 'src/asia/nation_2.py' and target_file <> source_file group by all")
def file_dependencies(t):
    r = sourced(t).where("source_file <> target_file")
    out = r.where("source_file = 'src/asia/nation_2.py'").select(F.lit("out").alias("way"), F.col("target_file").alias("other"), "relation_type")
    return A.count_by(out.unionByName(r.where("target_file = 'src/asia/nation_2.py'").select(F.lit("in").alias("way"), F.col("source_file").alias("other"), "relation_type")), "way", "other", "relation_type")


@query("O-194", f"{SOURCED} select source_file, target_file, count(*) as n from sourced where relation_type <> 'CONTAINED_WITHIN' and source_file <> target_file group by 1, 2")
def cross_file(t):
    return A.count_by(sourced(t).where("relation_type <> 'CONTAINED_WITHIN' and source_file <> target_file"), "source_file", "target_file")


@query("O-98", """select * from (select 'type' as metric, entity_type as item, count(*) as n from entities group by 2) union all select * from (select 'extension', regexp_extract(file_path, '[^.]*$'), count(*) from files group by 2)
union all select * from (select 'file', file_path, count(*) as n from entities group by 2 order by n desc, 2 limit 100) union all select * from (select 'entity', id, count(*) as n from (select unnest([source_id, target_id]) as id from rels) group by 2 order by n desc, 2 limit 200)""")
def run_metrics(t):
    def part(df, metric, item):
        return df.select(F.lit(metric).alias("metric"), F.col(item).alias("item"), "n")

    ext = A.count_by(t.files().withColumn("x", F.substring_index("file_path", ".", -1)), "x")
    ends = A.count_by(t.rels().select(F.explode(F.array("source_id", "target_id")).alias("id")), "id")
    out = part(A.count_by(t.entities(), "entity_type"), "type", "entity_type").unionByName(part(ext, "extension", "x"))
    return out.unionByName(part(A.top(A.count_by(t.entities(), "file_path"), "n", "file_path", 100), "file", "file_path")).unionByName(part(A.top(ends, "n", "id", 200), "entity", "id"))
