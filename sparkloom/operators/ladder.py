"""The build-time ladder of stub resolution: every strategy proposes names, one equi-join finds what they mean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normal_path
from . import joins as J
from . import packages as K
from .filters import is_stub
from .resolution import AMBIGUOUS, STRATEGIES

_HASH = r"_\[[0-9a-fA-F]+\]$"
# Kinds of symbols.
TYPES, MODULES, MEMBERS = ("CLASS", "STRUCT", "TRAIT", "INTERFACE", "ENUM", "TYPE_ALIAS"), ("MODULE", "NAMESPACE"), ("FUNCTION", "METHOD", "CONSTRUCTOR", "PROPERTY")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _tries(df: DataFrame, rank: int, strategy: str, *names: Column, sub: Column | None = None) -> DataFrame:
    """Proposals of one strategy, the names in the order in which they are tried; null names are none."""
    steps = df.select("stub", (F.lit("") if sub is None else sub).alias("sub"), F.posexplode(F.array(*names)).alias("step", "name"))
    return steps.where("name is not null").select("stub", F.lit(rank).alias("rank"), "sub", "step", F.lit(strategy).alias("strategy"), "name")


def by_package(refs: DataFrame, modules: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ref, step, name): references whose leading parts, as they are or rewritten by an alias, end exactly one module's name.

    Rewritten names come before the reference itself; of one name the longest module that leaves a symbol comes first,
    the whole as a module last. modules: (module); aliases: (prefix, target, open).
    """
    tails = K.suffixes(modules).groupBy("suffix").agg(F.count("*").alias("c"), F.min("module").alias("module")).where("c = 1").drop("c")
    r = refs.select("ref").distinct()
    named = K.rewritten(r, aliases).select("ref", "candidate", F.lit(0).alias("own")).unionByName(r.select("ref", F.col("ref").alias("candidate"), F.lit(1).alias("own")))
    p = F.split("candidate", r"\.")
    heads = named.select("ref", "own", "candidate", p.alias("p")).select("*", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    heads = heads.select("ref", "own", "candidate", "n", F.size("p").alias("all"), F.array_join(F.slice("p", F.lit(1), F.col("n")), ".").alias("suffix"), F.array_join(F.slice("p", F.col("n") + 1, F.size("p")), ".").alias("rest"))
    name = F.when(F.col("rest") == "", F.col("module")).otherwise(F.concat_ws(".", "module", "rest"))
    left = F.when(F.col("n") == F.col("all"), F.col("all")).otherwise(F.col("all") - F.col("n"))
    return heads.join(tails, "suffix").select("ref", F.struct("own", "candidate", left.alias("left")).alias("step"), name.alias("name"))


def _siblings(s: DataFrame, symbols: DataFrame) -> DataFrame:
    """(stub, sub, name): bare references as members of what other stubs of the scope name.

    Names that mean anything but a module are left out, and those below which no symbol lies, so the join on the scope
    meets its imports alone.
    """
    cut = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    above = symbols.select(cut.alias("sub")).where("sub <> ''").distinct()
    other = symbols.where(~F.col("kind").isin(*MODULES)).select(F.col("name").alias("sub")).distinct()
    roots = s.select("scope", F.col("ref").alias("sub")).distinct().join(above, "sub", "left_semi").join(other, "sub", "left_anti")
    bare = s.where(~F.contains("ref", F.lit("."))).join(roots, "scope").where("sub <> ref")
    return bare.select("stub", "sub", F.concat_ws(".", "sub", "ref").alias("name"))


def proposals(stubs: DataFrame, symbols: DataFrame, aliases: DataFrame, parents: DataFrame, received: DataFrame, stdlib: list[str]) -> DataFrame:
    """(stub, rank, sub, step, strategy, name): all names that strategies but external_prefix would look a stub up by."""
    s = stubs.select("stub", "ref", "scope", "file_path")
    ref, path, last = F.col("ref"), F.col("file_path"), F.element_at(F.split("ref", r"\."), -1)
    rank = {name: i + 1 for i, name in enumerate(STRATEGIES)}

    def at(strategy: str, df: DataFrame, *names: Column, sub: Column | None = None) -> DataFrame:
        return _tries(df, rank[strategy], strategy, *names, sub=sub)

    crate = F.regexp_extract(path, r"^((?:[^/]+/)*?src)/", 1)
    own_crate = s.where(F.startswith(ref, F.lit("crate.")) & (crate != ""))
    packaged = by_package(s, symbols.where(F.col("kind").isin(*MODULES)).select(F.col("name").alias("module")), aliases)
    packaged = s.join(packaged, "ref").select("stub", F.lit(rank["package_alias"]).alias("rank"), F.lit("").alias("sub"), "step", F.lit("package_alias").alias("strategy"), "name")
    order = F.struct(F.lit(0).alias("own"), F.lit("").alias("candidate"), F.col("step").alias("left"))
    typed = s.join(received, "stub").withColumn("name", F.concat_ws(".", "type", last))
    member = typed.select("stub", F.element_at(F.create_map(*[F.lit(x) for k, v in rank.items() for x in (k, v)]), F.col("source")).alias("rank"), F.lit("").alias("sub"), F.lit(0).alias("step"), F.col("source").alias("strategy"), "name")
    chained = s.join(parents.select("stub", "parent").distinct(), "stub")
    absolute = F.startswith(ref, F.lit("/"))
    full = F.when(absolute, normal_path(ref)).otherwise(normal_path(F.concat_ws("/", _folder(path), ref)))
    ups = F.size(F.filter(F.split(ref, "/"), lambda x: x == ".."))
    inside = absolute | (path.isNotNull() & (ups <= F.size(F.filter(F.split(path, "/"), lambda x: x != "")) - 1))
    relative = s.where(F.rlike(ref, F.lit(r"^(\.{1,2}/|/(?!/))")) & inside).withColumn("full", full).where("full <> ''")
    spellings = [F.col("full"), F.translate("full", "/", "."), F.translate("full", "-", "_"), F.regexp_replace("full", r"\.[^./]*$", "")]
    folders = F.array_distinct(F.array(_folder(path), _folder(F.regexp_extract("scope", r"^([^#(]*)", 1))))
    near = s.select("stub", "ref", F.posexplode(folders).alias("i", "folder")).where("folder <> ''")
    near = near.withColumn("there", F.concat_ws("/", "folder", "ref"))
    parts = [
        _tries(own_crate, 0, "scope_qualified", F.concat(F.translate(crate, "/", "."), F.lit("."), F.expr("substring(ref, 7)"))),
        at("exact_match", s, ref),
        at("stdlib_method", s.where(F.contains(ref, F.lit(".")) & F.substring_index(ref, ".", 1).isin(*stdlib)), F.substring_index(ref, ".", 1)) if stdlib else None,
        member,
        at("parent_chain", chained, F.concat_ws(".", "parent", "ref"), sub=F.col("parent")),
        at("sibling_module", _siblings(s, symbols), F.col("name"), sub=F.col("sub")),
        at("relative_path", relative, *spellings),
        at("scope_qualified", near, F.col("there"), F.translate("there", "/", "."), sub=F.col("i").cast("string")),
    ]
    plain = reduce(DataFrame.unionByName, [p for p in parts if p is not None])
    return plain.withColumn("step", order).unionByName(packaged)


def climb(stubs: DataFrame, symbols: DataFrame, aliases: DataFrame, parents: DataFrame, received: DataFrame, externals: DataFrame, stdlib: list[str]) -> DataFrame:
    """(stub, target, strategy, confidence, candidates): the first strategy that finds something wins; one row a stub.

    Strategies in order: a `crate.` name in the importer's own crate (as scope_qualified), then those of STRATEGIES. A
    member of an external module is made as `external:<ref>`. Other distinct targets that are not external make a
    resolution ambiguous; candidates lists them, the winner first, and is empty where nothing is found. Stubs and
    the stub itself are never targets. A path that leaves the tree proposes nothing.

    stubs: (stub, ref, scope, file_path), one row a stub; symbols: (name, id, kind, external), of equal names the smallest id counts; aliases:
    (prefix, target, open); parents: (stub, parent), names of stubs that hold this one; received: (stub, type, source)
    as `receivers.infer` gives; externals: (module); stdlib: first parts of names of the standard library.
    """
    known = symbols.where(~is_stub("id")).select("name", "id", "kind", F.coalesce("external", F.lit(False)).alias("external"))
    exact = known.groupBy("name").agg(F.min(F.struct("id", "external")).alias("s"))
    tried = proposals(stubs, known, aliases, parents, received, stdlib)
    found = tried.join(exact, "name")
    hashed = known.where(F.col("kind").isin(*MEMBERS) & F.rlike("name", F.lit(_HASH))).groupBy(F.regexp_replace("name", _HASH, "").alias("name")).agg(F.min(F.struct("id", "external")).alias("s"))
    members = tried.where(F.startswith("strategy", F.lit("receiver_"))).withColumn("step", F.struct(F.lit(1).alias("own"), "step.candidate", "step.left"))
    hits = found.unionByName(members.join(hashed, "name")).where("s.id <> stub")
    hits = hits.groupBy("stub", "rank", "sub").agg(F.min(F.struct("step", "strategy", "s")).alias("b")).select("stub", "rank", "sub", "b.strategy", F.col("b.s.id").alias("target"), F.col("b.s.external").alias("external"))
    outer = J.longest_prefix(stubs.select("ref"), externals, "ref", "module").where("module is not null").select("ref").distinct()
    ghosts = stubs.join(outer, "ref").select("stub", F.lit(list(STRATEGIES).index("external_prefix") + 1).alias("rank"), F.lit("").alias("sub"), F.lit("external_prefix").alias("strategy"), F.concat(F.lit("external:"), "ref").alias("target"), F.lit(True).alias("external"))
    order = F.struct("rank", "sub", "target", "strategy", "external")
    every = hits.unionByName(ghosts).groupBy("stub").agg(F.min(order).alias("b"), F.array_sort(F.collect_list(order)).alias("all"))  # a stub's strategies and its scope's imports
    others = F.array_distinct(F.transform(F.filter("all", lambda x: ~x.external | (x.target == F.col("b.target"))), lambda x: x.target))
    sure = F.element_at(F.create_map(*[F.lit(x) for k, v in STRATEGIES.items() for x in (k, v)]), F.col("b.strategy"))
    out = stubs.select("stub").join(every.withColumn("candidates", others), "stub", "left")
    confidence = F.when(F.col("b").isNull(), 0.0).when(F.size("candidates") > 1, AMBIGUOUS).otherwise(sure)
    return out.select("stub", "b.target", "b.strategy", confidence.alias("confidence"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
