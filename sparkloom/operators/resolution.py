"""Resolution of references: candidates of ranked strategies in one union, the best by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import module_of
from .filters import base_name, is_stub
from .graph import cut

# Confidence of each strategy, best strategy first.
STRATEGIES = {
    "exact_match": 0.95, "package_alias": 0.85, "external_prefix": 0.85, "stdlib_method": 0.90, "receiver_param": 0.90, "receiver_assignment": 0.75,
    "receiver_type": 0.65, "parent_chain": 0.75, "sibling_module": 0.75, "relative_path": 0.85, "scope_qualified": 0.70,
}
AMBIGUOUS = 0.5


def by_name(entities: DataFrame, query: str) -> DataFrame:
    """Entities a name means: exact id, else dotted path, else exact name, else name up to its hash suffix, else stubs.

    One rung only. A dotted path is a module, or the end of one, and a name in its file. Of several rows on the rung, a MODULE gives way where exactly one other row is left.
    """
    stub = is_stub("entity_id")
    module, _, last = query.rpartition(".")
    dotted = (base_name() == last) & F.endswith(F.concat(F.lit("."), module_of(F.col("file_path"))), F.lit("." + module)) if module else F.lit(False)
    rung = F.when(F.col("entity_id") == query, 1).when(F.coalesce(dotted, F.lit(False)) & ~stub, 2).when((F.col("name") == query) & ~stub, 3).when((base_name() == query) & ~stub, 4).when((F.col("name") == query) & stub, 5)
    hits = entities.withColumn("rung", rung).where("rung is not null")
    others = F.sum(F.when(F.col("entity_type") != "MODULE", 1).otherwise(0)).alias("others")
    best = hits.groupBy("rung").agg(others).orderBy("rung").limit(1)
    return hits.join(F.broadcast(best), "rung").where("others <> 1 or entity_type <> 'MODULE'").drop("others")  # a single row


def resolve(stubs: DataFrame, candidates: dict[str, DataFrame]) -> DataFrame:
    """(stub, target, strategy, confidence, n_candidates): the first strategy's smallest target wins.

    candidates maps a strategy to (ref, target). Other distinct targets make a resolution ambiguous, confidence 0.5;
    stubs without a candidate stay, with confidence 0. stubs has (stub, ref).
    """
    ranked = None
    for rank, name in enumerate(STRATEGIES):
        if name in candidates:
            part = candidates[name].select("ref", "target", F.lit(rank).alias("rank"), F.lit(name).alias("strategy"), F.lit(STRATEGIES[name]).alias("c"))
            ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy("ref").agg(F.min(F.struct("rank", "target", "strategy", "c")).alias("b"), F.countDistinct("target").alias("n"))
    out = stubs.join(best, "ref", "left")
    confidence = F.when(F.col("b").isNull(), 0.0).when(F.col("n") > 1, AMBIGUOUS).otherwise(F.col("b.c"))
    return out.select("stub", F.col("b.target").alias("target"), F.col("b.strategy").alias("strategy"), confidence.alias("confidence"), F.coalesce("n", F.lit(0)).alias("n_candidates"))


def compress(links: DataFrame, rounds: int = 3) -> DataFrame:
    """(u, v) of the links u -> v whose chain ends, after at most 2^rounds further hops, in what is no stub.

    Pointer jumping over saved tables, then one hop more. Chains that run into a cycle of any length, that are longer,
    or that end in a stub without a link are dropped. links has one row a u; stubs begin with `unresolved:`.
    """
    first = now = cut(links.select("u", "v"))

    def hop(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select(F.col("u").alias("m"), F.col("v").alias("w")), F.col("v") == F.col("m"), "left").select("u", F.coalesce("w", "v").alias("v"))

    for _ in range(rounds):
        now = cut(hop(now, now))
    return hop(now, first).where(~is_stub("v"))


def retarget(rels: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges with resolved stub targets rewritten; the rest of the stubs at confidence 0. Row count stays the same."""
    r = resolved.select(F.col("stub").alias("target_id"), F.col("target").alias("_to"), F.col("confidence").cast("float").alias("_c"))
    out = rels.join(r, "target_id", "left")
    return out.select(*[F.coalesce("_to", "target_id").alias(c) if c == "target_id" else F.when(is_stub("target_id"), F.coalesce("_c", F.lit(0.0).cast("float"))).otherwise(F.col(c)).alias(c) if c == "confidence" else F.col(c) for c in rels.columns])


def render_edges(rels: DataFrame, service: DataFrame) -> DataFrame:
    """Distinct edges with derived inverse edges, and one STACK_BOUNDARY where the ends' services differ. service: (id, tag)."""
    e = rels.select("source_id", "target_id", "relation_type").distinct()
    back = e.where("relation_type in ('CALLS', 'IMPORTS')").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.when(F.col("relation_type") == "CALLS", "CALLED_BY").otherwise("IMPORTED_BY").alias("relation_type"))
    a, b = service.select(F.col("id").alias("source_id"), F.col("tag").alias("a")), service.select(F.col("id").alias("target_id"), F.col("tag").alias("b"))
    border = e.join(a, "source_id").join(b, "target_id").where("a <> b").select("source_id", "target_id", F.lit("STACK_BOUNDARY").alias("relation_type")).distinct()
    return e.unionByName(back).unionByName(border)


def capped_pairs(pairs: DataFrame, group: list[str], cap: int) -> DataFrame:
    """Greedy choice of pairs (a, b, w) in each group, best first, each id in at most cap pairs.

    The choice feeds back, so a group is one Arrow task; callers bound a group's pairs beforehand.
    """

    def choose(df):
        df = df.sort_values(["w", "a", "b"], ascending=[False, True, True])
        used, keep = {}, []
        for a, b in zip(df["a"], df["b"], strict=True):
            ok = used.get(a, 0) < cap and used.get(b, 0) < cap
            keep.append(ok)
            if ok:
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
        return df[keep]

    return pairs.groupBy(*group).applyInPandas(choose, pairs.schema)


def gaps(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end) of the stretches no span covers, between a key's first start and last end."""
    w = Window.partitionBy(key).orderBy("start", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_u", upto).where(F.col("start") > F.col("_u")).select(key, F.col("_u").alias("start"), F.col("start").alias("end"))


def prune_stubs(rels: DataFrame, common: list[str]) -> DataFrame:
    """Edges but those to stubs whose last segment is a common method name; run it after retarget, so only open stubs go."""
    last = F.regexp_extract("target_id", r"([^.:]*)$", 1)
    return rels.where(~(is_stub("target_id") & last.isin(*common)))
