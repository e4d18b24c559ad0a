"""Symbols outside the tree as a dimension table: modules of standard libraries and packages, and what they export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, path: str) -> DataFrame:
    """(language, module, symbol) from JSON lines {"language", "module", "symbols": [...]}; a module without symbols has one row with null."""
    rows = spark.read.schema("language string, module string, symbols array<string>").json(path)
    return rows.where("module is not null").select("language", "module", F.explode_outer("symbols").alias("symbol")).distinct()


def external(refs: DataFrame, symbols: DataFrame, ref: str = "ref") -> DataFrame:
    """refs (ref, language, ...) with module and symbol where a known module is the ref, or its longest beginning at a dot.

    The ref's beginnings are looked up by equality; symbol is null where the rest is no export of the module. Refs
    without a known module are left out.
    """
    parts = F.split(ref, r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("n"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("module")))
    wide = refs.select(F.col(ref).alias("ref"), "language").distinct().select("ref", "language", F.inline(heads))
    modules = symbols.select("language", "module").distinct()
    best = wide.join(modules, ["language", "module"]).groupBy("ref", "language").agg(F.max_by("module", "n").alias("module"))
    rest = best.withColumn("symbol", F.get(F.split(F.expr("substring(ref, length(module) + 2)"), r"\."), F.lit(0)))
    known = symbols.where("symbol is not null").withColumn("exported", F.lit(True)).distinct()
    found = rest.join(known, ["language", "module", "symbol"], "left")
    return found.select("ref", "language", "module", F.when(F.col("exported"), F.col("symbol")).alias("symbol"))
