"""Predicates and projections over entities and relationships; each returns a Column or a narrower DataFrame."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import language

# Legacy relation types and their forward names; role bits; what a traversal may follow, by priority.
INVERSE = {"CALLED_BY": "CALLS", "IMPORTED_BY": "IMPORTS", "REFERENCED_IN": "READS", "CONTAINED_WITHIN": "CONTAINS"}
ROLES = {"definition": 1, "import": 2, "writeaccess": 4, "readaccess": 8, "generated": 16, "declaration": 32, "dynamic": 64, "heuristic": 128}
PRIORITY = {"CALLS": 0, "INHERITS": 1, "IMPLEMENTS": 1, "IMPORTS": 2, "READS": 3, "WRITES": 3, "CONTAINS": 4} | dict.fromkeys(["USES", "DEFINES", "OVERRIDES", "STACK_BOUNDARY", "WRAPPED_BY", "DEPENDS_ON_API", "CLEANED_BY", "HAS_ATTRIBUTE", "LINKS_TO", "IMPORTS_STYLE", "REFERENCES"], 5)

# Folders and file names of tests; characters that make a search a pattern; separators of a language's names.
TEST_FOLDERS = ("test", "tests", "testing", "spec", "specs", "__tests__", "test_utils")
TEST_FILE = r"(^test_.+|.+_test|.+\.test|.+\.spec)\.[^.]+$"
PATTERN_SIGNS = r"[.\[\]{}()*+?^$|\\]"
SEPARATORS = {
    "python": (".",), "typescript": (".", "/", "./", "@/"), "javascript": (".", "/", "./", "@/"), "rust": ("::",), "go": ("/", "."), "java": (".",), "kotlin": (".",), "scala": (".",),
    "csharp": (".",), "swift": (".",), "dart": (".", "package:"), "cpp": ("::",), "ruby": ("::",), "perl": ("::",), "php": ("\\", "::"), "r": ("::",), "haskell": (".",), "ocaml": (".",),
    "julia": (".",), "erlang": (":",), "lua": (".", ":"), "zig": (".",), "verilog": (".",),
}


def is_stub(col: str) -> Column:
    return F.startswith(F.col(col), F.lit("unresolved:"))


def name_matches(pattern: str, col: str = "name") -> Column:
    """Regular-expression search; patterns that do not compile, look around, or are over 200 characters search literally."""
    try:
        re.compile(pattern)
        fine = len(pattern) <= 200 and "(?=" not in pattern and "(?!" not in pattern and "(?<" not in pattern
    except re.error:
        fine = False
    return F.rlike(F.col(col), F.lit(pattern)) if fine else F.contains(F.col(col), F.lit(pattern))


def truthy(meta: str, key: str) -> Column:
    """Whether a JSON value is true in the loose sense: false, 0, "", [], {} and null are not, other strings are.

    The value's JSON type decides, so "false", "0" and "[]" in quotes are true. The cheap test comes first.
    """
    at = f"try_parse_json({meta}), \"$['{key}']\""
    kind, text = F.expr(f"schema_of_variant(try_variant_get({at}, 'variant'))"), F.expr(f"try_variant_get({at}, 'string')")
    true = (
        F.when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true").when(F.startswith(kind, F.lit("ARRAY")), text != "[]").when(F.startswith(kind, F.lit("OBJECT")), text != "{}")
        .when(kind == "VOID", F.lit(False)).otherwise(F.expr(f"try_variant_get({at}, 'double')") != 0)
    )
    return F.contains(F.col(meta), F.lit(f'"{key}"')) & F.coalesce(true, F.lit(False))


def quarantined(meta: str = "metadata_json") -> Column:
    return F.coalesce(truthy(meta, "bsg.noise") | truthy(meta, "bsg.quarantined"), F.lit(False))


def has_role(*names: str) -> Column:
    mask = reduce(lambda a, b: a | b, [ROLES[n.lower()] for n in names])
    return F.coalesce(F.col("roles"), F.lit(0)).bitwiseAND(F.lit(mask)) != 0


def confident(least: float) -> Column:
    """Confidence at least `least`, both as 32-bit floats; a missing confidence counts as 1."""
    if not 0 <= least <= 1:
        raise ValueError("confidence must lie in [0, 1]")
    return F.coalesce(F.col("confidence"), F.lit(1.0).cast("float")) >= F.lit(least).cast("float")


def forward(rels: DataFrame) -> DataFrame:
    """Legacy inverse types as forward ones, end points swapped, `reversed` set."""
    old = F.col("relation_type").isin(*INVERSE)
    kind = reduce(lambda acc, kv: acc.when(F.col("relation_type") == kv[0], kv[1]), INVERSE.items(), F.when(F.lit(False), "")).otherwise(F.col("relation_type"))
    return rels.withColumns({"source_id": F.when(old, F.col("target_id")).otherwise(F.col("source_id")), "target_id": F.when(old, F.col("source_id")).otherwise(F.col("target_id")), "relation_type": kind, "reversed": old})


def is_test_path(path: str = "file_path") -> Column:
    segments = F.slice(F.split(F.lower(path), "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    words = F.array(*[F.lit(x) for x in TEST_FOLDERS])
    return F.arrays_overlap(segments, words) | F.rlike(F.lower(F.substring_index(path, "/", -1)), F.lit(TEST_FILE))


def category(path: str = "file_path") -> Column:
    """TEST, CONFIG, DOC, INFRA or SOURCE from the path alone."""
    low = F.lower(path)
    return (
        F.when(is_test_path(path), "TEST").when(F.rlike(low, F.lit(r"\.(json|ya?ml|toml|ini|cfg|env)$")), "CONFIG").when(F.rlike(low, F.lit(r"\.(md|rst|txt)$")), "DOC")
        .when(F.rlike(low, F.lit(r"\.(tf|tfvars|hcl)$")), "INFRA").otherwise("SOURCE")
    )


def glob(pattern: str, path: str = "file_path") -> Column:
    """fnmatch over the lower-cased path; ** also stands for nothing, as do its slashes."""
    tries = {pattern, pattern.replace("**/", ""), pattern.replace("/**", "")}
    return F.rlike(F.lower(path), F.lit("|".join(f"^(?:{_glob(t.lower())})$" for t in sorted(tries))))


def _glob(pattern: str) -> str:
    return "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in re.sub(r"\*+", "*", pattern))


def metadata_predicate(value: Column, op: str, want=None) -> Column:
    """Metadata operator on a string value; a missing value satisfies only neq and not_in; unknown operators nothing."""
    made = {
        "exists": lambda: value.isNotNull(), "eq": lambda: value == F.lit(want), "neq": lambda: value.isNull() | (value != F.lit(want)), "in": lambda: value.isin(*want),
        "not_in": lambda: value.isNull() | ~value.isin(*want), "length_gt": lambda: F.length(value) > want, "length_lt": lambda: F.length(value) < want,
        "contains_any": lambda: reduce(lambda a, b: a | b, [F.contains(value, F.lit(w)) for w in want]), "contains_all": lambda: reduce(lambda a, b: a & b, [F.contains(value, F.lit(w)) for w in want]),
        "regex_match": lambda: F.rlike(value, F.lit(want)),
    }.get(op, lambda: F.lit(False))
    return F.coalesce(made(), F.lit(False))


def base_name(col: str = "name") -> Column:
    """Name without its parameter-hash suffix."""
    return F.regexp_replace(col, r"_\[[0-9a-fA-F]+\]$", "")


def score(query: str) -> Column:
    """Search score: how the name matches, kind, export, path and test weight."""
    name, low = base_name(), re.sub(r"[_\-.\s]", "", query).lower()
    match = F.when(name == query, 100).when(F.startswith(name, F.lit(query)), 60).when(F.contains(name, F.lit(query)), 30).otherwise(30 if re.search(PATTERN_SIGNS, query) else 10)
    kind = F.when(F.col("entity_type").isin("CLASS", "METHOD", "FUNCTION", "INTERFACE"), 40).when(F.col("entity_type") == "MODULE", 30).when(F.col("entity_type") == "EXTERNAL_SYMBOL", -25).when(F.col("entity_type") == "COMMENT_BLOCK", -40).otherwise(0)
    segment = F.exists(F.split("file_path", "/"), lambda s: F.contains(F.lower(F.regexp_replace(s, r"[_\-.\s]", "")), F.lit(low))) if low else F.lit(False)
    near = F.coalesce(F.contains(F.col("fqn"), F.lit(query)), F.lit(False)) | segment
    told = [k for k, signs in SEPARATORS.items() if any(x in query for x in signs)]
    mark = F.when(language(F.col("file_path")).isin(*told), 5).otherwise(0) if told else F.lit(0)
    return match + kind + F.when(F.col("is_exported"), 15).otherwise(0) + F.when(near, 20).otherwise(0) + mark - F.when(is_test_path(), 15).otherwise(0)


def search(entities: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Matching entities, best first, with a total order; one top-k node, no full sort."""
    hits = entities.where(name_matches(query) & ~is_stub("entity_id") & ~quarantined()).withColumn("score", score(query))
    return hits.orderBy(F.desc("score"), F.coalesce("start_line", F.lit(0)), "file_path", "entity_id").limit(limit)


def plain_category(path: str = "file_path") -> Column:
    """TEST, CONFIG, DOC or SOURCE as the rendered views have it: by words anywhere in the path, other rules than category()."""
    low = F.lower(path)
    doc = F.contains(low, F.lit("doc")) | F.endswith(path, F.lit(".md"))
    return F.when(F.contains(low, F.lit("test")), "TEST").when(F.rlike(path, F.lit(r"\.(ya?ml|json|toml)$")), "CONFIG").when(doc, "DOC").otherwise("SOURCE")


def cut_to_tokens(text: Column, most: int) -> Column:
    """text if its estimate fits, else its first 4 * most characters up to their last line end (all of them without one)."""
    head = F.left(text, F.lit(4 * most))
    tail = F.length(F.substring_index(head, "\n", -1))
    at = F.length(head) - tail - 1
    return F.when(tokens(text) <= most, text).when(at > 0, F.left(head, at)).otherwise(head)


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded down."""
    return F.expr("0") + F.floor(F.length(text) / 4)
