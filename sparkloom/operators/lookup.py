"""Where references lead: end points, dangling names, relative imports, re-exports, hierarchies, overrides, scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normal_path
from . import graph as G
from . import joins as J
from .filters import is_stub


def endpoints(ids: DataFrame, known: DataFrame, modules: DataFrame, names: DataFrame, stdlib: list[str]) -> DataFrame:
    """(id, kind, path): where each id lies.

    Other ids: a known row (direct), else an id that carries its path as its third field (embedded), else unresolved.
    Stubs, by the dotted name after `::`: the longest proper prefix that is a module, a standard library root, then the
    last part as a name: a bare name must be unique, a dotted one takes the module that shares most leading parts.
    known: (id, path); modules: (module, path), one row a module; names: (name, module, path).
    """
    i = ids.select("id").distinct()
    plain = i.where(~is_stub("id")).join(known.select("id", "path").distinct(), "id", "left")
    inner = F.startswith("id", F.lit("ent|"))
    kind = F.when(F.col("path").isNotNull(), "direct").when(inner, "embedded").otherwise("external_unresolved")
    plain = plain.select("id", kind.alias("kind"), F.coalesce("path", F.when(inner, F.get(F.split("id", r"\|"), F.lit(2)))).alias("path"))
    stubs = i.where(is_stub("id")).select("id", F.regexp_extract("id", "::(.*)$", 1).alias("ref"))
    refs = stubs.select("ref").distinct()
    mods = J.longest_prefix(refs, modules.select("module"), "ref", "module").join(modules.select("module", F.col("path").alias("m_path")), "module", "left").select("ref", "m_path")
    parts = F.split("ref", r"\.")
    last = refs.select("ref", parts.alias("p")).select("ref", F.element_at("p", -1).alias("name"), F.size("p").alias("k"), F.slice("p", F.lit(1), F.size("p") - 1).alias("lead"))
    cand = last.join(names.select("name", "module", F.col("path").alias("n_path")).distinct(), "name")
    same = F.zip_with("lead", F.split("module", r"\."), lambda x, y: F.coalesce(x == y, F.lit(False)))
    miss = F.coalesce(F.array_position(same, F.lit(False)), F.lit(0))
    cand = cand.withColumn("shared", F.when(miss == 0, F.size(same)).otherwise(miss - 1))
    won = cand.groupBy("ref", "k").agg(F.count("*").alias("c"), F.min(F.struct(-F.col("shared"), "module", "n_path")).alias("b")).where("k > 1 or c = 1").select("ref", F.col("b.n_path").alias("n_path"))
    root = F.get(parts, F.lit(0)).isin(*stdlib) if stdlib else F.lit(False)
    kind = F.when(F.col("ref") == "", "unresolved").when(F.col("m_path").isNotNull(), "module").when(root, "external_stdlib").when(F.col("n_path").isNotNull(), "name").otherwise("unresolved")
    path = F.when(F.col("m_path").isNotNull(), F.col("m_path")).when(~root, F.col("n_path"))
    return plain.unionByName(stubs.join(mods, "ref", "left").join(won, "ref", "left").select("id", kind.alias("kind"), path.alias("path")))


def relative_imports(refs: DataFrame, paths: DataFrame, suffixes: tuple[str, ...] = ("", ".ts", ".js", "/index.ts")) -> DataFrame:
    """(here, ref, path): imports that start with `.` or `/` against the importer's folder, the first spelling that is a file."""
    folder = F.regexp_replace("here", "[^/]*$", "")
    full = normal_path(F.when(F.startswith("ref", F.lit("/")), F.col("ref")).otherwise(F.concat(folder, F.col("ref"))))
    r = refs.where(F.rlike("ref", F.lit(r"^(\.|/)"))).select("here", "ref", full.alias("full")).distinct()
    spelled = r.select("here", "ref", "full", F.posexplode(F.array(*[F.lit(s) for s in suffixes])).alias("rank", "suffix")).withColumn("path", F.concat("full", "suffix"))
    return spelled.join(paths.select("path").distinct(), "path", "left_semi").groupBy("here", "ref").agg(F.min_by("path", "rank").alias("path"))


def siblings(refs: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(scope, ref, symbol): a bare name as a member of a module that the same scope imports; the smallest symbol wins.

    refs: (scope, ref); imports: (scope, module); symbols: (symbol).
    """
    made = refs.select("scope", "ref").distinct().join(imports.select("scope", "module").distinct(), "scope").withColumn("symbol", F.concat_ws(".", "module", F.element_at(F.split("ref", r"\."), -1)))
    return made.join(symbols.select("symbol").distinct(), "symbol", "left_semi").groupBy("scope", "ref").agg(F.min("symbol").alias("symbol"))


def hierarchy(classes: DataFrame, names: DataFrame) -> DataFrame:
    """(id, base_id): each class's base names, as an array, met with entities; of equal names the last by ord wins."""
    last = names.groupBy("name").agg(F.max_by("id", "ord").alias("base_id"))
    refs = classes.select("id", F.explode(F.array_distinct("bases")).alias("name"))
    return refs.join(last, "name").where("id <> base_id").select("id", "base_id").distinct()


def overrides(inherits: DataFrame, members: DataFrame) -> DataFrame:
    """(child, parent): members named as one of an ancestor of their class. inherits: (u, v); members: (owner, name, id)."""
    up = G.closure(inherits).where("u <> v")
    child = members.select(F.col("owner").alias("u"), "name", F.col("id").alias("child"))
    parent = members.select(F.col("owner").alias("v"), "name", F.col("id").alias("parent"))
    return up.join(child, "u").join(parent, ["v", "name"]).select("child", "parent").distinct()


def scoped(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, scope, symbol): the innermost scope that declares the name, then project, then external symbols.

    refs: (ref, scope) with dotted scopes; symbols: (name, scope, symbol, external); the outermost scope is ''.
    """
    p = F.filter(F.split("scope", r"\."), lambda x: x != "")
    wide = refs.select("ref", "scope").distinct().withColumn("p", p).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("p"))))
    wide = wide.select("ref", F.col("scope").alias("here"), "depth", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice("p", F.lit(1), F.greatest("depth", F.lit(1))), ".")).alias("scope"))
    hit = wide.join(symbols.withColumnRenamed("name", "ref"), ["ref", "scope"])
    return hit.groupBy("ref", "here").agg(F.min(F.struct("external", -F.col("depth"), "symbol")).alias("b")).select("ref", F.col("here").alias("scope"), F.col("b.symbol").alias("symbol"))


def remap(rels: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """rels with targets of replaced files renamed: old and new entities meet on (file_id, name, entity_type, start_line)."""
    keys = ["file_id", "name", "entity_type", "start_line"]
    ids = old.join(new.select(*keys, F.col("id").alias("to")), keys).where("id <> to").groupBy(F.col("id").alias("target_id")).agg(F.min("to").alias("to"))
    return rels.join(ids, "target_id", "left").withColumn("target_id", F.coalesce("to", "target_id")).drop("to").select(*rels.columns)


def reexports(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(alias, symbol): names that package files pass on, `from .mod import a, b as c` and `export { a as b } from './mod'`.

    files: (package, text), package dotted; symbols: (symbol). Only symbols that exist make an alias.
    """
    py, js = r"(?m)^from[ \t]+\.([\w.]*)[ \t]+import[ \t]+\(?([^()\n#]+)", r"export\s*\{([^}]*)\}\s*from\s*['\"]\./([\w/]+)['\"]"

    def found(pattern: str, mod: int, items: int) -> DataFrame:
        z = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(mod)).alias("m"), F.regexp_extract_all("text", F.lit(pattern), F.lit(items)).alias("i"))
        return files.select("package", F.inline(z).alias("m", "i")).select("package", F.translate("m", "/", ".").alias("m"), F.explode(F.split("i", ",")).alias("item"))

    each = found(py, 1, 2).unionByName(found(js, 2, 1)).withColumn("item", F.trim("item")).where("item <> '' and item <> '*'")
    name = F.regexp_extract("item", r"^(\w+)", 1)
    shown = F.element_at(F.split("item", r"\s+as\s+"), -1)
    made = each.select(F.concat_ws(".", "package", shown).alias("alias"), F.concat_ws(".", "package", F.nullif("m", F.lit("")), name).alias("symbol")).where("alias <> symbol").distinct()
    return made.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("alias", "symbol")


def receivers(calls: DataFrame, params: DataFrame, assigned: DataFrame) -> DataFrame:
    """(call_id, type, confidence): the type a call's variable has: its parameter annotation, else the last assignment at or before its line.

    calls: (call_id, scope, var, line); params: (scope, var, type); assigned: (scope, var, line, type).
    """
    by_param = params.groupBy("scope", "var").agg(F.min("type").alias("p"))
    c = calls.withColumn("k", F.struct("scope", "var"))
    near = J.as_of(c, assigned.select(F.struct("scope", "var").alias("k"), F.col("line").alias("at"), F.col("type").alias("a")), "k", "line", "at", "a")
    out = near.join(by_param, ["scope", "var"], "left")
    return out.select("call_id", F.coalesce("p", "a").alias("type"), F.when(F.col("p").isNotNull(), 0.90).when(F.col("a").isNotNull(), 0.75).otherwise(0.0).alias("confidence"))
