"""Module names beyond the file path: package markers, roots and aliases declared in manifests, dotted suffixes.

Manifests are few and read as whole texts; files, modules and references are joined on exact keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.text import plain_json

# Files that mark their folder as a package.
MARKERS = ("__init__.py", "__init__.pyi")


def _folder(path: str) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _folders(c: Column) -> Column:
    """The folder c and all above it but the root, outermost first."""
    parts = F.split(c, "/")
    return F.when(c != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def marked(files: DataFrame) -> DataFrame:
    """(path, module): the dotted name that starts at the outermost folder of the unbroken run of packages around a file.

    Decided once a folder, not once a file: the deepest folder above that is no package ends the run. Files outside
    packages give no row.
    """
    name = F.substring_index("path", "/", -1)
    packages = files.where(name.isin(*MARKERS)).select(_folder("path").alias("at")).distinct()
    folders = files.select(_folder("path").alias("folder")).where("folder <> ''").distinct()
    above = folders.select("folder", F.posexplode(_folders(F.col("folder"))).alias("depth", "at"))
    bare = above.join(packages.withColumn("package", F.lit(True)), "at", "left")
    start = bare.groupBy("folder").agg(F.coalesce(F.max(F.when(F.col("package").isNull(), F.col("depth"))), F.lit(-1)).alias("last_bare"))
    start = start.where(F.col("last_bare") + 1 < F.size(F.split("folder", "/")))
    kept = F.split("folder", "/")
    dotted = F.array_join(F.slice(kept, F.col("last_bare") + 2, F.size(kept)), ".")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return files.withColumn("folder", _folder("path")).join(start, "folder").select("path", F.when(stem == "__init__", dotted).otherwise(F.concat(dotted, F.lit("."), stem)).alias("module"))


def _under(folder: Column, child: Column) -> Column:
    """child below folder as a clean relative path; ./ and outer slashes go."""
    clean = F.regexp_replace(child, r"^(?:\./|/)+|^\.$|/+$", "")
    return F.array_join(F.filter(F.array(folder, clean), lambda x: x != ""), "/")


def _options(manifests: DataFrame) -> DataFrame:
    ts = manifests.where(F.rlike(F.substring_index("path", "/", -1), F.lit(r"^tsconfig.*\.json$")))
    return ts.select(_folder("path").alias("folder"), F.from_json(plain_json(F.col("text")), "compilerOptions struct<baseUrl: string, paths: map<string,array<string>>>").alias("j")).select("folder", "j.compilerOptions.*")


def roots(manifests: DataFrame) -> DataFrame:
    """(root): folders that manifests (path, text) declare as places where import paths begin; "" is the tree itself."""
    name, folder = F.substring_index("path", "/", -1), _folder("path")
    cargo = manifests.where(name == "Cargo.toml").select(_under(folder, F.lit("src")).alias("root"))
    where = F.regexp_extract("text", r"(?m)^\s*where\s*=\s*\[?([^\]\n]*)", 1)
    table = F.regexp_extract("text", r"(?m)^\s*package-dir\s*=\s*\{([^}\n]*)", 1)
    python = manifests.where(name == "pyproject.toml").select(folder.alias("folder"), F.explode(F.concat(F.regexp_extract_all(where, F.lit("[\"']([^\"']+)[\"']")), F.regexp_extract_all(table, F.lit("=\\s*[\"']([^\"']+)[\"']")))).alias("child"))
    section = F.regexp_extract("text", r"(?m)^\[options\.packages\.find\]\s*\n(?:(?!\[).*\n)*?where\s*=((?:[^\n]*)(?:\n[ \t]+[^\n]+)*)", 1)
    setup = manifests.where(name == "setup.cfg").select(folder.alias("folder"), F.explode(F.regexp_extract_all(section, F.lit(r"(\S+)"))).alias("child"))
    base = _options(manifests).where("baseUrl <> ''").select("folder", F.col("baseUrl").alias("child"))
    declared = python.unionByName(setup).unionByName(base).select(_under(F.col("folder"), F.col("child")).alias("root"))
    return cargo.unionByName(declared).distinct()


def aliases(manifests: DataFrame) -> DataFrame:
    """(prefix, target, open): names that manifests map to folders; an open one takes any rest, others end at a name's border."""
    go = manifests.where(F.substring_index("path", "/", -1) == "go.mod").select(_folder("path").alias("target"), F.regexp_extract("text", r"(?m)^\s*module\s+(\S+)", 1).alias("prefix"))
    go = go.where("prefix <> ''").select(F.translate("prefix", "/", ".").alias("prefix"), F.translate("target", "/", ".").alias("target"), F.lit(False).alias("open"))
    ts = _options(manifests).select("folder", F.explode("paths").alias("pattern", "targets")).where("size(targets) > 0")
    is_open = F.endswith("pattern", F.lit("*"))
    place = _under(F.col("folder"), F.regexp_replace(F.get("targets", F.lit(0)), r"\*$", ""))
    ts = ts.select(F.regexp_replace("pattern", r"\*$", "").alias("prefix"), F.when(is_open & (place != ""), F.concat(place, F.lit("/"))).otherwise(place).alias("target"), is_open.alias("open"))
    return go.unionByName(ts.where("prefix <> ''")).distinct()


def below_roots(files: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, module): the dotted path below each declared root that holds the file; a name equal to the whole path is left out."""
    ups = files.select("path", F.explode(_folders(_folder("path"))).alias("root"))
    rest = F.expr("substring(path, length(root) + 2)")
    return ups.join(declared.where("root <> ''").distinct(), "root").select("path", F.translate(F.regexp_replace(rest, r"\.[^./]*$", ""), "/", ".").alias("module"))


def suffixes(modules: DataFrame, module: str = "module") -> DataFrame:
    """(suffix, module): every dotted tail of names of two or more parts, the whole included; a lookup is one equi-join."""
    parts = F.split(module, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return modules.where(F.size(parts) > 1).select(F.explode(tails).alias("suffix"), F.col(module).alias("module")).distinct()


def rewritten(refs: DataFrame, declared: DataFrame, ref: str = "ref") -> DataFrame:
    """(ref, candidate): dotted names that aliases (prefix, target, open) give a reference, the reference itself excepted.

    Only beginnings as long as some prefix are looked up, so a reference meets its aliases by equality.
    """
    lengths = declared.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # one row, as long as the longest prefix at most
    heads = refs.select(F.col(ref).alias("ref")).distinct().crossJoin(F.broadcast(lengths)).select("ref", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("ref"))
    met = heads.withColumn("prefix", F.expr("left(ref, n)")).join(declared, "prefix")
    rest = F.expr("substring(ref, n + 1)")
    made = F.regexp_replace(F.translate(F.concat("target", rest), "/", "."), r"^\.+", "")
    return met.where(F.col("open") | F.rlike(rest, F.lit("^(?:$|[./])"))).select("ref", made.alias("candidate")).where("candidate <> '' and candidate <> ref").distinct()
