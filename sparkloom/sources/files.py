"""File trees as a source: binary scan, ignore patterns, language by extension then content, dependency manifests."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension, by file name, and by interpreter line.
EXTENSIONS = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "go": "go", "java": "java",
    "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "php": "php", "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala",
    "sc": "scala", "dart": "dart", "hs": "haskell", "lhs": "haskell", "jl": "julia", "erl": "erlang", "hrl": "erlang", "ml": "ocaml", "mli": "ocaml", "fml": "ocaml", "fsi": "ocaml", "lua": "lua",
    "r": "r", "rdata": "r", "rds": "r", "pl": "perl", "pm": "perl", "v": "verilog", "sv": "verilog", "vh": "verilog", "zig": "zig", "sh": "bash", "bash": "bash", "zsh": "bash", "fish": "bash", "ksh": "bash",
    "dash": "bash", "m": "objectivec", "mm": "objectivec", "agda": "agda", "hack": "hack", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "htm": "html", "css": "css",
    "scss": "css", "sass": "css", "less": "css", "md": "markdown", "markdown": "markdown", "mdown": "markdown", "mkd": "markdown", "mkdn": "markdown", "hcl": "hcl", "tf": "hcl", "tfvars": "hcl", "sql": "sql",
}
NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "jenkinsfile": "groovy"}
INTERPRETERS = {"python": "python", "node": "javascript", "bash": "bash", "sh": "bash", "ruby": "ruby"}
IGNORED = (".git/**", "node_modules/**", "**/node_modules/**", "**/__pycache__/**", "*.pyc", "dist/**", "build/**")


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of every file under root, relative paths; content is read only where a query needs it."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.select(F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "").alias("path"), "length", "content")


def ignored(path: Column, patterns=IGNORED) -> Column:
    """Whether any pattern fits; one expression, the patterns joined."""
    return F.rlike(path, F.lit("|".join(f"(?:^{fnmatch.translate(p).replace('(?s:', '(?:').replace('\\z', '$').replace('\\Z', '$')}$)" for p in patterns)))


def language(path: Column, content: Column | None = None) -> Column:
    """Language by extension, else by file name, else by the interpreter line; null where none tells."""

    def look(table: dict, key: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)

    name = F.lower(F.substring_index(path, "/", -1))
    found = [F.when(F.contains(name, F.lit(".")), look(EXTENSIONS, F.substring_index(name, ".", -1))), look(NAMES, name)]
    if content is not None:
        found.append(look(INTERPRETERS, F.regexp_extract(content, r"^#!\s*\S*/(?:env\s+)?([a-z]+)", 1)))
    return F.coalesce(*found)


def requirements(df: DataFrame, text: str = "text") -> DataFrame:
    """(path, manager, name, version) of requirements files: one row a named line, comments and options dropped."""
    lines = df.select("path", F.explode(F.split(text, "\n")).alias("line")).select("path", F.trim(F.regexp_replace("line", r"\s*#.*$", "")).alias("line"))
    name = F.regexp_extract("line", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return lines.where(name != "").select("path", F.lit("pip").alias("manager"), F.lower(F.regexp_replace(name, r"[-_.]+", "-")).alias("name"), F.nullif(F.regexp_extract("line", r"(?:==|>=|~=|<=|>|<)\s*([^,;\s]+)", 1), F.lit("")).alias("version"))


def package_json(df: DataFrame, text: str = "text") -> DataFrame:
    """(path, manager, name, version) of the dependencies and devDependencies of package.json files."""
    made = df.select("path", F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    every = F.map_concat(F.coalesce("j.devDependencies", F.create_map().cast("map<string,string>")), F.map_filter(F.coalesce("j.dependencies", F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key(F.col("j.devDependencies"), k), F.lit(False))))
    return made.select("path", F.lit("npm").alias("manager"), F.explode(every).alias("name", "version"))


def markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, kind, value): headers, list items, fenced-code openings and links of markdown texts."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    kinds = [("header", r"^#{1,6}\s+(.+?)\s*$"), ("item", r"^\s*(?:[-*+]|\d+\.)\s+(.+)$"), ("code", r"^\s*```(\w+)"), ("link", r"\[[^\]]*\]\(([^)\s]+)")]
    each = F.array_compact(F.array(*[F.when(F.rlike("line", F.lit(p)), F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", p, 1).alias("value"))) for k, p in kinds]))
    return lines.select(key, (F.col("i") + 1).alias("line_no"), F.inline(each))
