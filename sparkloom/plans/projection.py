"""Code-graph shaped tables made from the star-schema tables: files, entities, relationships, stubs, versions, runs.

Each has a Spark plan and the same rows as a DuckDB common table expression (CTE), for side-by-side checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazily built plans over one input folder; nothing runs until a query's action."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def nations(self) -> DataFrame:
        n = self.raw("nation").join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 and 25 rows
        path = F.concat(F.lit("src/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit(".py"))
        return n.select(F.col("n_nationkey").cast("long").alias("file_id"), path.alias("file_path"), "n_name", "r_name")

    def part_paths(self) -> DataFrame:
        p = self.raw("part")
        return p.withColumn("file_path", F.concat(F.lit("lib/"), F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".ts")))

    def files(self) -> DataFrame:
        """file_tracking: (file_id, file_path, is_indexed). Part files are numbered by path: types x brands rows."""
        lib = self.part_paths().select("file_path").distinct()
        lib = lib.select((F.lit(1000) + F.crc32(F.col("file_path").cast("binary"))).alias("file_id"), "file_path", F.lit(True).alias("is_indexed"))
        return self.nations().select("file_id", "file_path", (F.col("file_id") % 7 != 0).alias("is_indexed")).unionByName(lib)

    def entities(self) -> DataFrame:
        nat = F.broadcast(self.nations())  # one row a nation

        def made(df, kind, name, key, exported, fqn, meta):
            return df.select(
                "file_id", "file_path", F.concat_ws("|", F.lit("ent"), F.lit(kind), "file_path", F.lit(""), F.lit(""), F.lit(""), F.lit(""), name).alias("entity_id"), name.alias("name"), F.lit(kind).alias("entity_type"),
                (key + 1).cast("int").alias("start_line"), (key + 1 + key % 20).cast("int").alias("end_line"), exported.alias("is_exported"), fqn.alias("fqn"), meta.alias("metadata_json"),
            )

        null, n_name = F.lit(None).cast("string"), F.col("n_name")
        c = self.raw("customer").join(nat, F.col("c_nationkey") == F.col("file_id"))
        s = self.raw("supplier").join(nat, F.col("s_nationkey") == F.col("file_id"))
        o = self.raw("orders").join(self.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(nat, F.col("c_nationkey") == F.col("file_id"))
        p = self.part_paths().withColumn("file_id", F.lit(1000) + F.crc32(F.col("file_path").cast("binary")))
        cmeta = F.concat(F.lit('{"bsg.quarantined":'), F.when(F.col("c_acctbal") < -900, "true").otherwise("false"), F.lit(',"bsg.domain":"'), F.col("r_name"), F.lit('","segment":"'), F.col("c_mktsegment"), F.lit('"}'))
        pmeta = F.when(F.col("p_size") < 3, F.lit('{"bsg.noise":true}')).when(F.col("p_size") < 6, F.lit('{"bsg.noise":false}'))
        return (
            made(self.nations(), "MODULE", n_name, F.col("file_id"), F.lit(True), null, null)
            .unionByName(made(c, "CLASS", F.col("c_name"), F.col("c_custkey"), F.col("c_acctbal") > 0, F.concat(F.lower("n_name"), F.lit("."), F.col("c_name")), cmeta))
            .unionByName(made(s, "FUNCTION", F.col("s_name"), F.col("s_suppkey"), F.col("s_acctbal") > 0, F.concat(F.lower("n_name"), F.lit("."), F.col("s_name")), null))
            .unionByName(made(o, "METHOD", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), F.col("o_orderkey"), F.lit(False), null, null))
            .unionByName(made(p, "CONSTANT", F.concat(F.col("p_name"), F.lit("_["), F.lower(F.hex("p_partkey")), F.lit("]")), F.col("p_partkey"), F.lit(False), F.col("p_name"), pmeta))
        )

    def rels(self) -> DataFrame:
        """(file_id, source_id, target_id, relation_type, roles, confidence, line). Ids are type and key, to stay slim."""
        tier = F.element_at(F.array(*[F.lit(x).cast("float") for x in TIERS]), (F.floor(F.col("l_discount") * 100 + 0.5).cast("int") % 9) + 1)
        line = self.raw("lineitem").select(
            F.col("l_orderkey").alias("file_id"), F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("source_id"),
            F.when(F.col("l_partkey") % 17 == 0, F.concat(F.lit("unresolved:o:"), F.col("l_orderkey").cast("string"), F.lit("::lib."), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("p:"), F.col("l_partkey").cast("string"))).alias("target_id"),
            F.when(F.col("l_linestatus") == "O", "READS").otherwise("WRITES").alias("relation_type"),
            (F.when(F.col("l_linestatus") == "O", 8).otherwise(4) + F.when(F.col("l_returnflag") == "R", 128).otherwise(0)).cast("int").alias("roles"),
            F.when(F.col("l_tax") != 0, tier).alias("confidence"), F.col("l_linenumber").cast("int").alias("line"),
        )
        none_i, none_f = F.lit(None).cast("int"), F.lit(None).cast("float")

        def plain(df, src, dst, kind, file_id):
            return df.select(F.col(file_id).cast("long").alias("file_id"), src.alias("source_id"), dst.alias("target_id"), F.lit(kind).alias("relation_type"), none_i.alias("roles"), none_f.alias("confidence"), F.lit(1).alias("line"))

        def ref(tag, col):
            return F.concat(F.lit(tag + ":"), F.col(col).cast("string"))

        return (
            line.unionByName(plain(self.raw("orders"), ref("o", "o_orderkey"), ref("c", "o_custkey"), "CALLS", "o_orderkey"))
            .unionByName(plain(self.raw("customer"), ref("c", "c_custkey"), ref("n", "c_nationkey"), "IMPORTS", "c_custkey"))
            .unionByName(plain(self.raw("supplier"), ref("s", "s_suppkey"), ref("n", "s_nationkey"), "IMPORTS", "s_suppkey"))
            .unionByName(plain(self.raw("nation"), ref("n", "n_nationkey"), ref("r", "n_regionkey"), "CONTAINED_WITHIN", "n_nationkey"))
        )

    def versions(self) -> tuple[DataFrame, DataFrame]:
        """Two versions of one entity table, with added, deleted, modified, renamed and unchanged rows."""
        o = self.raw("orders").withColumn("y", F.year("o_orderdate"))
        h = F.md5(F.concat(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")))
        base = [F.col("o_custkey").alias("file_id"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_orderkey") % 50).cast("int").alias("start_line")]
        key = F.col("o_orderkey").cast("string")
        old = o.where("y <= 1998").select(*base, key.alias("id"), h.alias("hash"))
        new_hash = F.when(F.col("o_orderkey") % 10 == 0, F.md5(F.concat(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.lit("x")))).otherwise(h)
        new = o.where("y >= 1996").select(*base, F.when(F.col("o_orderkey") % 10 == 1, F.concat(key, F.lit("_r"))).otherwise(key).alias("id"), new_hash.alias("hash"))
        return old, new

    def changelog(self) -> DataFrame:
        kind = F.expr("case event_type when 'signup' then 'added' when 'error' then 'removed' when 'purchase' then 'modified' when 'click' then 'renamed' end")
        return self.raw("events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_uuid"), "event_id", F.col("user_id").alias("entity_id"), (F.col("user_id") % 25).alias("file_id"), kind.alias("change_kind"), "ts").where("change_kind is not null")


# The confidence tiers of resolved references.
TIERS = (1.0, 0.95, 0.90, 0.85, 0.75, 0.70, 0.65, 0.50, 0.0)

CTE = f"""
nations as (select n_nationkey::bigint as file_id, 'src/' || lower(r_name) || '/' || lower(n_name) || '.py' as file_path, n_name, r_name from nation join region on n_regionkey = r_regionkey),
part_paths as (select *, 'lib/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) || '.ts' as file_path from part),
ents as (
  select file_path, n_name as name, 'MODULE' as entity_type, file_id as key, true as is_exported, null::varchar as fqn, null::varchar as metadata_json from nations
  union all select file_path, c_name, 'CLASS', c_custkey, c_acctbal > 0, lower(n_name) || '.' || c_name, '{{"bsg.quarantined":' || case when c_acctbal < -900 then 'true' else 'false' end || ',"bsg.domain":"' || r_name || '","segment":"' || c_mktsegment || '"}}' from customer join nations on c_nationkey = file_id
  union all select file_path, s_name, 'FUNCTION', s_suppkey, s_acctbal > 0, lower(n_name) || '.' || s_name, null from supplier join nations on s_nationkey = file_id
  union all select file_path, 'order_' || o_orderkey, 'METHOD', o_orderkey, false, null, null from orders join customer on o_custkey = c_custkey join nations on c_nationkey = file_id
  union all select file_path, p_name || '_[' || lower(printf('%X', p_partkey)) || ']', 'CONSTANT', p_partkey, false, p_name, case when p_size < 3 then '{{"bsg.noise":true}}' when p_size < 6 then '{{"bsg.noise":false}}' end from part_paths
),
entities as (select *, 'ent|' || entity_type || '|' || file_path || '|||||' || name as entity_id, (key + 1)::int as start_line, (key + 1 + key % 20)::int as end_line from ents),
files as (select file_path, n_is as is_indexed from (select file_path, file_id % 7 != 0 as n_is from nations union all select distinct file_path, true from part_paths)),
rels as (
  select l_orderkey as file_id, 'o:' || l_orderkey as source_id, case when l_partkey % 17 = 0 then 'unresolved:o:' || l_orderkey || '::lib.' || l_partkey else 'p:' || l_partkey end as target_id,
         case when l_linestatus = 'O' then 'READS' else 'WRITES' end as relation_type, (case when l_linestatus = 'O' then 8 else 4 end + case when l_returnflag = 'R' then 128 else 0 end)::int as roles,
         case when l_tax != 0 then ([{", ".join(f"{x}::float" for x in TIERS)}])[(floor(l_discount * 100 + 0.5)::int % 9) + 1] end as confidence, l_linenumber::int as line from lineitem
  union all select o_orderkey, 'o:' || o_orderkey, 'c:' || o_custkey, 'CALLS', null, null, 1 from orders
  union all select c_custkey, 'c:' || c_custkey, 'n:' || c_nationkey, 'IMPORTS', null, null, 1 from customer
  union all select s_suppkey, 's:' || s_suppkey, 'n:' || s_nationkey, 'IMPORTS', null, null, 1 from supplier
  union all select n_nationkey, 'n:' || n_nationkey, 'r:' || n_regionkey, 'CONTAINED_WITHIN', null, null, 1 from nation
),
v_old as (select o_custkey as file_id, 'order_' || o_orderkey as name, (o_orderkey % 50)::int as start_line, o_orderkey::varchar as id, md5(o_orderkey || o_orderstatus) as hash from orders where year(o_orderdate) <= 1998),
v_new as (select o_custkey as file_id, 'order_' || o_orderkey as name, (o_orderkey % 50)::int as start_line, o_orderkey || case when o_orderkey % 10 = 1 then '_r' else '' end as id, md5(o_orderkey || o_orderstatus || case when o_orderkey % 10 = 0 then 'x' else '' end) as hash from orders where year(o_orderdate) >= 1996),
changelog as (select * from (select strftime(ts, '%Y-%m-%d') as run_uuid, event_id, user_id as entity_id, user_id % 25 as file_id, case event_type when 'signup' then 'added' when 'error' then 'removed' when 'purchase' then 'modified' when 'click' then 'renamed' end as change_kind, ts from events) where change_kind is not null)
"""


def oracle(sql: str) -> str:
    if sql.lstrip().startswith("with recursive "):
        return f"with recursive {CTE.strip()}, {sql.lstrip()[15:]}"
    return f"with {CTE.strip()}\n{sql.strip()}" if not sql.lstrip().startswith("with ") else f"with {CTE.strip()}, {sql.lstrip()[5:]}"
