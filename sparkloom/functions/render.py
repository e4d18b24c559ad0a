"""Rows as text: markdown lines and JSON with sorted keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_line(key: Column, name: Column, path: Column) -> Column:
    return F.concat(F.lit("- `"), key, F.lit("` "), name, F.coalesce(F.concat(F.lit(" ("), path, F.lit(")")), F.lit("")))


def sorted_json(**fields: Column) -> Column:
    """One JSON object a row, keys in order, nulls kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"})
