"""Text sources: JSON settings, marker lines, definitions found by pattern where no grammar is at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_settings(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, path, entity_type, value): a DOCUMENT, a SECTION for the root, a SETTING a scalar of a flat object."""
    m = df.select(key, F.from_json(col, "map<string,string>").alias("m")).where("m is not null")
    fixed = m.select(key, F.inline(F.array(F.struct(F.lit("document").alias("path"), F.lit("DOCUMENT").alias("entity_type"), F.lit(None).cast("string").alias("value")), F.struct(F.lit("root").alias("path"), F.lit("SECTION").alias("entity_type"), F.size("m").cast("string").alias("value")))))
    return fixed.unionByName(m.select(key, F.explode("m").alias("k", "value")).select(key, F.concat(F.lit("root."), "k").alias("path"), F.lit("SETTING").alias("entity_type"), "value"))


def plain_json(text: Column) -> Column:
    """JSON without comments and trailing commas; quoted text stays as it is."""
    quoted = r'("(?:[^"\\]|\\.)*")'
    return F.regexp_replace(F.regexp_replace(text, quoted + r"|//[^\n]*|(?s:/\*.*?\*/)", "$1"), quoted + r"|,(?=\s*[}\]])", "$1")


def json_tree(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, path, entity_type, value) of JSON of any depth; texts with comments or trailing commas are read without them.

    An object is a SECTION (value: number of keys) and is descended; an array is a SECTION (number of items) and is
    not; anything else is a SETTING. A DOCUMENT for every text that gave rows; unreadable and null texts give none.
    """
    read = df.select(key, F.when(F.try_parse_json(col).isNotNull(), F.col(col)).otherwise(plain_json(F.col(col))).alias("_json")).where("_json is not null")

    def walk(batches):
        import json

        import pandas as pd

        for b in batches:
            out = []
            for k, s in zip(b[key], b["_json"], strict=True):
                try:
                    todo = [("root", json.loads(s))]
                except (ValueError, RecursionError):
                    continue
                out.append((k, "document", "DOCUMENT", None))
                while todo:
                    path, v = todo.pop()
                    if isinstance(v, (dict, list)):
                        out.append((k, path, "SECTION", str(len(v))))
                        if isinstance(v, dict):
                            todo += [(f"{path}.{n}", x) for n, x in v.items()]
                    else:
                        out.append((k, path, "SETTING", v if v is None or isinstance(v, str) else json.dumps(v)))
            yield pd.DataFrame(out, columns=[key, "path", "entity_type", "value"])

    kind = read.schema[key].dataType.simpleString()
    return read.mapInPandas(walk, f"`{key}` {kind}, path string, entity_type string, value string")


def text_definitions(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, line_no, entity_type, name): `def NAME(` and `class NAME` lines."""
    lines = df.select(key, F.posexplode(F.split(col, "\n")).alias("i", "line"))
    f, c = F.regexp_extract("line", r"^[ \t]*def (\w+)\(", 1), F.regexp_extract("line", r"^[ \t]*class (\w+)", 1)
    return lines.where((f != "") | (c != "")).select(key, (F.col("i") + 1).alias("line_no"), F.when(f != "", "FUNCTION").otherwise("CLASS").alias("entity_type"), F.when(f != "", f).otherwise(c).alias("name"))
