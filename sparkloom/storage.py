"""More registered queries: catalogs, packs, workspaces, caches, package names, extensions, queues of changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import registry
from .operators import aggregates as A
from .operators import extensions as E
from .operators import filters as P
from .operators import graph as G
from .operators import history as H
from .operators import joins as J
from .operators import packages as K
from .operators import rules as U
from .operators.hooks import Hooks
from .plans.catalog import Catalog
from .plans.workspaces import Workspace, Workspaces
from .sources import files as FS
from .sources import html, text
from .sources import symbols as SY
from .streaming import changes

query = registry.query


def catalog(t, kind: str = "catalog") -> Catalog:
    return Catalog(t.spark, G.shared(t.spark, kind))


@query("O-04", f"select count(*) as n from (select distinct file_path from files where not starts_with(file_path, 'lib/economy')) where file_path not like 'src/asia/%'")
def walk(t):
    return t.files().select("file_path").distinct().where(~FS.ignored(F.col("file_path"), ("lib/economy**", "src/asia/**"))).agg(F.count("*").alias("n"))


@query("O-22", "select o_custkey, count(*) as n, min(o_orderkey) as first from orders group by 1")
def sorted_sink(t):
    c = catalog(t)
    c.commit({"orders": t.raw("orders")}, sort_by={"orders": "o_custkey"})
    return c.table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("O-23", "select 1::bigint as generation, count(*) as n from nation union all select 2, count(*) from nation where n_regionkey > 1")
def generations(t):
    c = catalog(t)
    first = c.commit({"nation": t.raw("nation"), "region": t.raw("region")})
    second = c.commit({"nation": t.raw("nation").where("n_regionkey > 1")})
    each = [c.table("nation", generation=g).agg(F.lit(g).cast("long").alias("generation"), F.count("*").alias("n")) for g in (first, second)]
    return each[0].unionByName(each[1])


@query("O-24", "select 'nation/gen=1' as folder, (select count(*) from nation where n_regionkey > 1) as left_rows")
def garbage(t):
    c = catalog(t)
    c.commit({"nation": t.raw("nation"), "region": t.raw("region")})
    c.commit({"nation": t.raw("nation").where("n_regionkey > 1")})
    gone = t.spark.createDataFrame([(f,) for f in c.collect_garbage()], "folder string")
    return gone.crossJoin(F.broadcast(c.table("nation").agg(F.count("*").alias("left_rows"))))  # one row


@query("O-25", "select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def packed(t):
    a, b = catalog(t), catalog(t, "unpacked")
    a.commit({"nation": t.raw("nation"), "region": t.raw("region")})
    archive = G.shared(t.spark, "pack") + ".zip"
    a.export_pack(archive)
    b.import_pack(archive)
    return b.table("nation").join(b.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("O-29", "select case when s_suppkey % 2 = 0 then 'even' else 'odd' end as workspace, case when s_suppkey % 2 = 0 then 100 else 60000 end::bigint as debounce_ms, count(*) as n from supplier group by 1, 2")
def workspaces(t):
    w = Workspaces(t.spark, G.shared(t.spark, "workspaces") + ".json")
    for name, keep, wait in (("even", "s_suppkey % 2 = 0", 5), ("odd", "s_suppkey % 2 = 1", 10**9)):
        c = catalog(t)
        c.commit({"supplier": t.raw("supplier").where(keep)})
        w.add(Workspace(name, c.root, debounce_ms=wait))
    known = w.frame().select(F.col("name").alias("workspace"), "debounce_ms")
    return w.table("supplier").groupBy("workspace").agg(F.count("*").alias("n")).join(known, "workspace").select("workspace", "debounce_ms", "n")


@query("O-198", "select event_type, count(*) as n from events where ts >= (select max(ts) - interval 3 day from events) group by 1")
def old_runs(t):
    c = catalog(t)
    e = t.raw("events").withColumn("run_uuid", F.col("ts").cast("string"))
    c.commit({"events": e, "region": t.raw("region")})
    runs = c.table("events").groupBy("run_uuid").agg(F.min("ts").alias("started_at"))
    newest = runs.agg(F.max("started_at").alias("now"))
    c.delete_runs(runs.crossJoin(F.broadcast(newest)).where("started_at < now - interval 3 days"))  # one row
    return A.count_by(c.table("events"), "event_type")


@query("O-198-status", "select * from (values ('nation', 2::bigint, true), ('region', 1, true)) v(name, generation, filled)")
def storage_status(t):
    c = catalog(t)
    c.commit({"nation": t.raw("nation"), "region": t.raw("region")})
    c.commit({"nation": t.raw("nation")})
    return c.status().select("name", "generation", (F.col("bytes") > 0).alias("filled"))


@query("O-21", "with v as (select o_orderkey as k, year(o_orderdate) as y from orders) select case when k % 10 = 0 or k % 7 = 0 then false else true end as reused, count(*) as n, sum(k % 100)::bigint as total from v group by 1")
def cache(t):
    """Every tenth order has changed; every seventh was cached too long ago."""
    o = t.raw("orders").select(F.col("o_orderkey").alias("path"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"), F.lit("ast").alias("variant"))

    def build(d):
        return d.select("path", "hash", "variant", (F.col("path") % 100).alias("v"))

    age = F.when(F.col("path") % 7 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-03-01")).cast("timestamp")
    kept = build(o).withColumn("hash", F.when(F.col("path") % 10 == 0, F.lit("old")).otherwise(F.col("hash"))).withColumn("built_at", age)
    return H.reuse(o, kept, build, now="2024-03-10", ttl_days=30).groupBy("reused").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("O-20", """with r as (select distinct case p_size % 4 when 0 then 'os.path.join' when 1 then 'os.missing.x' when 2 then 'json' else 'own.' || p_size end as ref from part)
select ref, 'python' as language, case ref when 'os.path.join' then 'os.path' when 'os.missing.x' then 'os' else 'json' end as module, case when ref = 'os.path.join' then 'join' end as symbol from r where not starts_with(ref, 'own')""")
def external_symbols(t):
    at = G.shared(t.spark, "symbols")
    known = [("python", "os", ["getcwd"]), ("python", "os.path", ["join", "exists"]), ("python", "json", [])]
    t.spark.createDataFrame(known, "language string, module string, symbols array<string>").write.json(at)
    size = F.col("p_size") % 4
    ref = F.when(size == 0, "os.path.join").when(size == 1, "os.missing.x").when(size == 2, "json").otherwise(F.concat(F.lit("own."), F.col("p_size").cast("string")))
    return SY.external(t.raw("part").select(ref.alias("ref"), F.lit("python").alias("language")), SY.load(t.spark, at))


@query("O-160", """with f as (select file_path as path, r_name, n_name from nations) select path, case when r_name in ('ASIA', 'EUROPE') then lower(r_name) || '.' || lower(n_name) end as module from f where r_name in ('ASIA', 'EUROPE')
union all select 'src/' || lower(r_name) || '/__init__.py', lower(r_name) from region where r_name in ('ASIA', 'EUROPE')""")
def package_modules(t):
    """Two regions are packages, src is not."""
    init = t.raw("region").where("r_name in ('ASIA', 'EUROPE')").select(F.concat(F.lit("src/"), F.lower("r_name"), F.lit("/__init__.py")).alias("path"))
    return K.marked(t.nations().select(F.col("file_path").alias("path")).unionByName(init))


MANIFESTS = [
    ("web/tsconfig.json", '{\n  // names\n  "compilerOptions": {"baseUrl": "./app", "paths": {"@/*": ["./src/*"], "~lib": ["lib"],}, /* end */}\n}'),
    ("go.mod", "module example.org/tool\n\ngo 1.22\n"),
    ("core/Cargo.toml", '[package]\nname = "core"\n'),
    ("pyproject.toml", '[tool.setuptools.packages.find]\nwhere = ["src", "lib"]\n'),
]


@query("O-160-roots", """with p as (select path, unnest(['src', 'lib', 'core/src', 'web/app']) as root from (select file_path as path from nations union all select distinct file_path from part_paths))
select path, replace(regexp_replace(substr(path, length(root) + 2), '\\.[^./]*$', ''), '/', '.') as module from p where starts_with(path, root || '/')""")
def rooted(t):
    m = t.spark.createDataFrame(MANIFESTS, "path string, text string")
    paths = t.nations().select(F.col("file_path").alias("path")).unionByName(t.part_paths().select(F.col("file_path").alias("path")).distinct())
    return K.below_roots(paths, K.roots(m))


@query("O-160-aliases", """with r as (select distinct p_size as k, case p_size % 4 when 0 then '@/ui/b' || p_size || '.Button' when 1 then '~lib.x' || p_size when 2 then '~library.x' else 'example.org.tool.pkg' || p_size end as ref from part)
select ref, case k % 4 when 0 then 'web.src.ui.b' || k || '.Button' when 1 then 'web.lib.x' || k else 'pkg' || k end as candidate from r where k % 4 <> 2""")
def aliased(t):
    k, size = F.col("p_size").cast("string"), F.col("p_size") % 4
    ref = F.when(size == 0, F.concat(F.lit("@/ui/b"), k, F.lit(".Button"))).when(size == 1, F.concat(F.lit("~lib.x"), k)).when(size == 2, "~library.x").otherwise(F.concat(F.lit("example.org.tool.pkg"), k))
    return K.rewritten(t.raw("part").select(ref.alias("ref")), K.aliases(t.spark.createDataFrame(MANIFESTS, "path string, text string")))


@query("O-160-suffixes", "with m as (select distinct ['src', lower(r_name), lower(n_name)] as p from nations) select distinct array_to_string(p[i:], '.') as suffix, array_to_string(p, '.') as module from (select p, unnest([1, 2, 3]) as i from m)")
def dotted_tails(t):
    return K.suffixes(t.nations().select(F.concat(F.lit("src."), F.lower("r_name"), F.lit("."), F.lower("n_name")).alias("module")))


@query("O-205", "select event_id, (event_id % 1000 + case when event_type = 'error' then 30000 else least(30000, ceil(event_id % 40000 / 500.0) * 500) end)::bigint as release_at from events")
def held(t):
    first = F.col("event_id") % 1000
    ended = F.when(F.col("event_type") != "error", first + F.col("event_id") % 40000)
    return t.raw("events").select("event_id", changes.release_at(first, ended).cast("long").alias("release_at"))


PENDING = "select e.user_id, max(e.ts) as ts from events e left join (select user_id, max(ts) as started from events where event_type = 'purchase' group by 1) d on d.user_id = e.user_id group by e.user_id having any_value(d.started) is null or max(e.ts) >= any_value(d.started)"


@query("O-206", f"select count(*) as n, max(ts) as ts from ({PENDING})")
def in_flight(t):
    e = t.raw("events")
    done = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("started"))
    return changes.pending(e, done, "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))


@query("O-208", "select id from v_old full join v_new n using (id) where v_old.hash is distinct from n.hash union select id from v_new where file_id % 9 = 0")
def caught_up(t):
    old, new = t.versions()
    return changes.catch_up(new.where("file_id % 9 = 0"), H.change_scan(old, new), "id")


RULES_TEXT = """
schema_version: "2"
rules:
  - {rule_id: small, priority: 1, matchers: {entity_types: [CLASS], metadata_conditions: [{key: segment, operator: eq, value: MACHINERY}]}, actions: {add_tags: [m]}}
  - {rule_id: seen, priority: 2, matchers: {usn_tags_any: [m], file_patterns: ["src/asia/*"]}}
"""


@query("O-215", "select case when file_path like 'src/asia/%' then 'seen,small' else 'small' end as rules, count(*) as n from entities where entity_type = 'CLASS' and metadata_json ->> '$.segment' = 'MACHINERY' group by 1")
def plugin_rules(t):
    done = U.apply(t.entities(), U.load(RULES_TEXT)).where(F.size("rule_ids") > 0)
    return A.count_by(done.select(F.array_join(F.array_sort("rule_ids"), ",").alias("rules")), "rules")


PACKS = E.Packs([
    E.Pack("base", sets={"noise": {"click", "view"}}, maps={"name": {"en": "English"}}, languages={"de": E.Pack("de", sets={"noise": {"error"}})}),
    E.Pack("more", sets={"noise": {"signup"}}, maps={"name": {"fr": "French"}}),
])


@query("O-216", """with e as (select event_type, case event_id % 3 when 0 then 'de' when 1 then 'en' end as lang from events)
select lang, case lang when 'en' then 'English' end as name, coalesce(event_type in ('signup') or (lang = 'de' and event_type = 'error') or (lang is distinct from 'de' and event_type in ('click', 'view')), false) as noise, count(*) as n from e group by 1, 2, 3""")
def data_packs(t):
    lang = F.when(F.col("event_id") % 3 == 0, "de").when(F.col("event_id") % 3 == 1, "en")
    e = t.raw("events").select("event_type", lang.alias("lang"))
    return A.count_by(e.select("lang", PACKS.lookup("name", F.col("lang"), F.col("lang")).alias("name"), PACKS.member("noise", F.col("lang"), F.col("event_type")).alias("noise")), "lang", "name", "noise")


@query("O-217", "select n_nationkey, upper(n_name) || '!' as n_name from nation where n_regionkey > 0")
def hooked(t):
    h = Hooks(("post_entities",))
    h.add("post_entities", "b", lambda d: d.withColumn("n_name", F.concat("n_name", F.lit("!"))), 5)
    h.add("post_entities", "a", lambda d: d.withColumn("n_name", F.upper("n_name")), 5)
    h.add("post_entities", "z", lambda d: d.where("n_regionkey > 0"), 1)
    return h.run("post_entities", t.raw("nation")).select("n_nationkey", "n_name")


@query("O-218", """select relation_type, starts_with(target_id, 'unresolved:') as stub, case when starts_with(target_id, 'unresolved:') then null else 'typescript' end as language, 'npm' as ecosystem, count(*) as n from rels group by 1, 2""")
def stamped_language(t):
    meta = F.when(P.is_stub("target_id"), F.create_map(F.lit("reference_type"), F.lit("call"))).otherwise(F.create_map(F.lit("language"), F.lit("?")))
    done = t.rels().withColumn("m", E.stamp_language(meta, F.lit("typescript"), F.lit("npm")))
    return A.count_by(done.select("relation_type", P.is_stub("target_id").alias("stub"), F.col("m")["language"].alias("language"), F.col("m")["bsg.language"].alias("ecosystem")), "relation_type", "stub", "language", "ecosystem")


@query("O-218-prune", """with r as (select case p_size % 5 when 0 then ' ' when 1 then 'print' when 2 then 'get' when 3 then 'a.b' else p_name end as name, p_size from part)
select case p_size % 5 when 0 then 'empty_ref' when 1 then 'builtin' when 2 then 'noise_symbol' when 3 then '+qualified_name' else case when p_size % 2 = 0 then '+imported' when p_size % 3 = 0 then '+cross_file_rel' else 'unimported_simple_name' end end as reason, count(*) as n from r group by 1""")
def pruning(t):
    size = F.col("p_size")
    name = F.when(size % 5 == 0, " ").when(size % 5 == 1, "print").when(size % 5 == 2, "get").when(size % 5 == 3, "a.b").otherwise(F.regexp_replace("p_name", "[./:]", "_"))
    why = E.prune_reason(name, name == "print", name == "get", size % 2 == 0, size % 3 == 0)
    return A.count_by(t.raw("part").select(why.alias("reason")), "reason")


@query("O-220", "select 'src' as kind, file_path as name from nations union all select 'any', file_path from (select distinct file_path from part_paths)")
def extractors(t):
    x = E.Extractors()
    x.add("python", lambda d: d.select(F.lit("src").alias("kind"), F.col("path").alias("name")))
    f = t.files().select(F.col("file_path").alias("path"), FS.language(F.col("file_path")).alias("language")).distinct()
    return x.run(f, lambda d: d.select(F.lit("any").alias("kind"), F.col("path").alias("name")))


@query("O-10-graph", """with p as (select page_id, '<link rel="Stylesheet" href="/s' || page_id || '.css"><a HREF=''//x.org/' || page_id || ''' href="y">z</a><a href="/local">q</a>' as html from pages)
select page_id, 'document' as source, 'CONTAINS' as relation_type, unnest(['link#0', 'a#1', 'a#2']) as target from p union all select page_id, 'a#1', 'LINKS_TO', '//x.org/' || page_id from p union all select page_id, 'document', 'IMPORTS_STYLE', '/s' || page_id || '.css' from p""")
def html_graph(t):
    page = F.col("page_id").cast("string")
    made = F.concat(F.lit('<link rel="Stylesheet" href="/s'), page, F.lit(".css\"><a HREF='//x.org/"), page, F.lit("' href=\"y\">z</a><a href=\"/local\">q</a>"))
    return html.graph(t.raw("pages").select("page_id", made.alias("html")))


@query("O-12-nested", """with e as (select event_id, props from events where props is not null)
select event_id, unnest(['document', 'root', 'root.a', 'root.a.p', 'root.a.l', 'root.s', 'root.n']) as path, unnest(['DOCUMENT', 'SECTION', 'SECTION', 'SECTION', 'SECTION', 'SETTING', 'SETTING']) as entity_type,
unnest([null, '3', '2', len(json_keys(props::json))::varchar, '3', 't // u', null]) as value from e
union all select event_id, 'root.a.p.' || k, 'SETTING', props::json ->> k from (select event_id, props, unnest(json_keys(props::json)) as k from e)""")
def nested_json(t):
    made = F.concat(F.lit('{"a": {"p": '), F.col("props"), F.lit(', "l": [1, 2, {"x": 3}], /* end */}, // line\n "s": "t // u", "n": null}'))
    return text.json_tree(t.raw("events").select("event_id", made.alias("t")), "event_id", "t")


@query("O-42-plain", "select case when contains(lower(file_path), 'test') then 'TEST' when contains(lower(file_path), 'doc') then 'DOC' else 'SOURCE' end as category, count(*) as n from files group by 1")
def plain_category(t):
    return A.count_by(t.files().withColumn("category", P.plain_category()), "category")


@query("O-54-cut", """with h as (select doc_id, text, replace(text, ' ', chr(10)) as t from documents), c as (select *, left(t, 80) as s from h)
select doc_id, case when text is null then null when length(t) // 4 <= 20 then t when length(s) - instr(reverse(s), chr(10)) > 0 and contains(s, chr(10)) then left(s, (length(s) - instr(reverse(s), chr(10)))::bigint) else s end as t from c""")
def cut_text(t):
    lines = F.replace("text", F.lit(" "), F.lit("\n"))
    return t.raw("documents").select("doc_id", P.cut_to_tokens(lines, 20).alias("t"))


@query("O-65-both", "select entity_id from (select 'p:' || p_partkey as entity_id from part union all select 'o:' || o_orderkey from orders) where entity_id in (select target_id from rels where roles & 128 != 0 union all select source_id from rels where roles & 128 != 0)")
def role_ends(t):
    ids = t.raw("part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("entity_id")).unionByName(t.raw("orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("entity_id")))
    ends = t.rels().where(P.has_role("heuristic")).select(F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    return ids.join(ends, "entity_id", "left_semi")


@query("O-73-strong", """with l as (select distinct p_name as l, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) as token from part), r as (select distinct p_type as r, unnest(regexp_extract_all(lower(p_type || ' ' || p_brand), '[a-z0-9]+')) as token from part),
p as (select l, r, count(*) as shared, count(*) filter (length(token) >= 4) as strong from l join r using (token) group by 1, 2 having count(*) >= 2 or count(*) filter (length(token) >= 4) >= 1)
select l, r, 10 * shared + strong as score from p qualify row_number() over (partition by l order by 10 * shared + strong desc, r) <= 3""")
def strong_tokens(t):
    def words(df, key):
        return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("x"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token")).distinct()

    p = t.raw("part")
    left = words(p.select(F.col("p_name").alias("l"), F.col("p_name").alias("x")).distinct(), "l")
    right = words(p.select(F.col("p_type").alias("r"), F.concat_ws(" ", "p_type", "p_brand").alias("x")).distinct(), "r")
    return J.strong_overlap(left, right, "l", "r", F.length("token") >= 4)


@query("O-76-next", """with s as (select file_path, start_line, end_line, entity_id from entities where entity_type = 'FUNCTION'), p as (select distinct file_path, (key % 1500)::int as line from entities where entity_type = 'METHOD'),
a as (select p.file_path, line, entity_id from p join s on s.file_path = p.file_path and line between start_line and end_line qualify row_number() over (partition by p.file_path, line order by end_line - start_line, entity_id) = 1),
b as (select p.file_path, line, entity_id from p join s on s.file_path = p.file_path and start_line > line where not exists (select 1 from a where a.file_path = p.file_path and a.line = p.line) qualify row_number() over (partition by p.file_path, line order by start_line, entity_id) = 1)
select *, 'enclosing' as how from a union all select *, 'following' from b""")
def next_symbol(t):
    e = t.entities()
    p = e.where("entity_type = 'METHOD'").select("file_path", ((F.col("start_line") - 1) % 1500).alias("line")).distinct()
    return J.enclosing_or_next(p, e.where("entity_type = 'FUNCTION'").select("file_path", "start_line", "end_line", "entity_id"))


@query("O-131-global", "select doc_id from (select doc_id, sum(n_chars // 4) over (order by doc_id) as spent from documents) where spent <= 20000")
def global_budget(t):
    return A.budget_cut(t.raw("documents").select("doc_id", F.expr("n_chars div 4").alias("cost")), "cost", 20000, ["doc_id"]).select("doc_id")


@query("O-134-global", "with d as (select doc_id, row_number() over (order by doc_id) - 1 as rn, greatest(1, (select count(*) from documents) // 30) as step from documents) select doc_id from d where rn % step = 0 and rn // step < 30")
def global_stride(t):
    return A.strided_sample(t.raw("documents").select("doc_id"), "doc_id", 30)


@query("O-144-prune", """with e as (select 's:' || s_suppkey as entity_id, case when s_suppkey % 5 = 0 then 'ENTRY_POINT' else 'FUNCTION' end as entity_type, s_acctbal > 0 as is_exported from supplier union all select 'x:' || p_partkey, 'EXTERNAL_SYMBOL', false from part where p_partkey % 2 = 0 union all select 'unresolved:' || p_partkey, 'EXTERNAL_SYMBOL', null from part)
select entity_id from e where entity_type = 'FUNCTION' and not is_exported and entity_id not in (select source_id from rels where relation_type = 'READS') and not ends_with(entity_id, '1') or starts_with(entity_id, 'unresolved:') and not ends_with(entity_id, '1')""")
def prune(t):
    sid, pid = F.col("s_suppkey").cast("string"), F.col("p_partkey").cast("string")
    s = t.raw("supplier").select(F.concat(F.lit("s:"), sid).alias("entity_id"), F.when(F.col("s_suppkey") % 5 == 0, "ENTRY_POINT").otherwise("FUNCTION").alias("entity_type"), (F.col("s_acctbal") > 0).alias("is_exported"))
    x = t.raw("part").where("p_partkey % 2 = 0").select(F.concat(F.lit("x:"), pid).alias("entity_id"), F.lit("EXTERNAL_SYMBOL").alias("entity_type"), F.lit(False).alias("is_exported"))
    u = t.raw("part").select(F.concat(F.lit("unresolved:"), pid).alias("entity_id"), F.lit("EXTERNAL_SYMBOL").alias("entity_type"), F.lit(None).cast("boolean").alias("is_exported"))
    e = s.unionByName(x).unionByName(u)
    return G.prunable(e, t.rels().where("relation_type = 'READS'"), e.where(F.endswith("entity_id", F.lit("1")))).select("entity_id")
