"""Code text as a source without a grammar: definitions, marker comments, glue between entities, TOML and YAML settings."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What opens a definition on a line, by entity type; words before the opening do not matter.
NAME = r"([\p{L}_][\p{L}\p{N}_]*)"
OPENINGS = {"FUNCTION": rf"(?:^[ \t]*def|function)\s+{NAME}\s*\(", "CLASS": rf"class\s+{NAME}"}
# Comment openings.
COMMENTS = ("#", "//", "/*", "*", "--", ";", "%", "<!--", '"""', "'''")


def definitions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, entity_type, start_line): definitions found line by line, several a line; one row a (name, type, line)."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line")).where(F.contains("line", F.lit("def")) | F.contains("line", F.lit("class")) | F.contains("line", F.lit("function")))

    def found(kind: str, opening: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(opening), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("entity_type")))

    each = F.concat(*[found(k, p) for k, p in OPENINGS.items()])
    return lines.select(key, (F.col("i") + 1).alias("start_line"), F.inline(F.array_distinct(each)))


def rationale(df: DataFrame, key: str, text: str, markers: tuple[str, ...] = ("WHY", "NOTE")) -> DataFrame:
    """(key, line, rationale_kind, value): comments that open with a marker and a colon."""
    p = r"(?:#|//|--|/\*|;|%)\s*(" + "|".join(markers) + r"):\s*(.*?)\s*(?:\*/)?\s*$"
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "t")).where(F.rlike("t", F.lit(p)))
    return lines.select(key, (F.col("i") + 1).alias("line"), F.lower(F.regexp_extract("t", p, 1)).alias("rationale_kind"), F.regexp_extract("t", p, 2).alias("value"))


def gap_kind(raw: Column) -> Column:
    """whitespace, separator, comment, import or code, by the text between two entities."""
    s = F.regexp_replace(raw, r"^\s+|\s+$", "")
    first = F.regexp_replace(F.substring_index(s, "\n", 1), r"\s+$", "")
    return (
        F.when(s == "", "whitespace").when(F.rlike(s, F.lit(r"^[=\-*]{3,}$")), "separator").when(_starts(first, COMMENTS), "comment")
        .when(_starts(first, ("import ", "from ", "#include", "use ", "require")) | F.contains(F.left(first, F.lit(20)), F.lit("import ")), "import").otherwise("code")
    )


def _starts(c: Column, heads: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in heads:
        out |= F.startswith(c, F.lit(h))
    return out


def settings(df: DataFrame, key: str, text: str, form: str) -> DataFrame:
    """(key, path, entity_type, value) of TOML or YAML texts: tables are SECTIONs and descended into, lists SECTIONs, the rest SETTINGs.

    Arrow batches, one text at a time; a text that does not parse gives no rows, a null text neither.
    """
    kind = df.schema[key].dataType.simpleString()

    def walk(path, v):
        if isinstance(v, dict):
            yield path, "SECTION", str(len(v))
            for k, x in v.items():
                yield from walk(f"{path}.{k}", x)
        elif isinstance(v, list):
            yield path, "SECTION", str(len(v))
        else:
            yield path, "SETTING", None if v is None else str(v).lower() if isinstance(v, bool) else str(v)

    def parse(batches):
        import pandas as pd

        if form == "toml":
            import tomllib

            load, wrong = tomllib.loads, tomllib.TOMLDecodeError
        else:
            import yaml

            load, wrong = yaml.safe_load, yaml.YAMLError
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text], strict=True):
                try:
                    made = load(t) if t else None
                except wrong:
                    continue
                if isinstance(made, dict):
                    rows += [(k, *r) for r in walk("root", made)]
            yield pd.DataFrame(rows, columns=[key, "path", "entity_type", "value"])

    return df.select(key, text).mapInPandas(parse, f"{key} {kind}, path string, entity_type string, value string")


def css_rules(df: DataFrame, key: str, css: str) -> DataFrame:
    """(key, selector, property, value) of flat CSS rules."""
    rule = df.select(key, F.inline(F.arrays_zip(F.regexp_extract_all(css, F.lit(r"([^{}]+)\{([^{}]*)\}"), F.lit(1)).alias("s"), F.regexp_extract_all(css, F.lit(r"([^{}]+)\{([^{}]*)\}"), F.lit(2)).alias("b"))))
    each = rule.select(key, F.trim("s").alias("selector"), F.explode(F.split("b", ";")).alias("d")).where(F.contains("d", F.lit(":")))
    return each.select(key, "selector", F.trim(F.substring_index("d", ":", 1)).alias("property"), F.trim(F.regexp_replace("d", "^[^:]*:", "")).alias("value"))
