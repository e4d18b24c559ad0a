"""Scalar functions over identifiers and paths, all as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_tokens(c: Column) -> Column:
    """Distinct lower-case tokens of an identifier, split at case changes and other characters."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda x: x != ""))


def module_of(path: Column) -> Column:
    """Dotted module of a code path; package files stand for their folder; null for other files."""
    bare = F.regexp_replace(path, r"\.(py|ts|js|go|rs|java)$", "")
    folder = F.regexp_replace(bare, r"/(__init__|index|mod)$", "")
    return F.when(bare != path, F.translate(folder, "/", "."))


def normal_path(path: Column) -> Column:
    """Path without . and .. segments; .. above the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, empty, lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))), "/")


def any_token(c: Column, wanted: set[str]) -> Column:
    return F.arrays_overlap(name_tokens(c), F.array(*[F.lit(w) for w in sorted(wanted)]))


def title(c: Column) -> Column:
    return F.initcap(F.translate(c, "-_", "  "))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
