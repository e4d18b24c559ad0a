"""Entities and references of Python source texts by its own grammar, one text at a time in Arrow batches."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def python(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, record, name, kind, owner, start_line, end_line) of definitions and references.

    Definitions are FUNCTION, METHOD, CLASS, CONSTANT (upper-case names of a module) and FIELD (annotated names of a
    class); references CALLS, IMPORTS, INHERITS. owner is the dotted definition around it, '' at the top. A text that
    does not parse gives no rows, a null text neither.
    """
    kind = df.schema[key].dataType.simpleString()

    def dotted(node):
        import ast

        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            head = dotted(node.value)
            return f"{head}.{node.attr}" if head else None
        return None

    def visit(node, owner, inside, out):
        import ast

        for n in ast.iter_child_nodes(node):
            at = getattr(n, "lineno", 0), getattr(n, "end_lineno", 0)
            here, within = owner, inside
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                what = "CLASS" if isinstance(n, ast.ClassDef) else "METHOD" if inside == "CLASS" else "FUNCTION"
                out.append(("definition", n.name, what, owner, *at))
                for b in getattr(n, "bases", []):
                    if dotted(b):
                        out.append(("reference", dotted(b), "INHERITS", f"{owner}.{n.name}".lstrip("."), *at))
                here, within = f"{owner}.{n.name}".lstrip("."), what
            elif isinstance(n, ast.Call) and dotted(n.func):
                out.append(("reference", dotted(n.func), "CALLS", owner, *at))
            elif isinstance(n, ast.Import):
                out += [("reference", a.name, "IMPORTS", owner, *at) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                head = "." * n.level + (n.module or "")
                out += [("reference", f"{head}.{a.name}" if n.module else head + a.name, "IMPORTS", owner, *at) for a in n.names]
            elif isinstance(n, ast.Assign) and inside == "MODULE":
                out += [("definition", x.id, "CONSTANT", owner, *at) for x in n.targets if isinstance(x, ast.Name) and x.id.isupper()]
            elif isinstance(n, ast.AnnAssign) and inside == "CLASS" and isinstance(n.target, ast.Name):
                out.append(("definition", n.target.id, "FIELD", owner, *at))
            visit(n, here, within, out)

    def parse(batches):
        import ast

        import pandas as pd

        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text], strict=True):
                if not t:
                    continue
                found = []
                try:
                    visit(ast.parse(t), "", "MODULE", found)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += [(k, *r) for r in found]
            yield pd.DataFrame(rows, columns=[key, "record", "name", "kind", "owner", "start_line", "end_line"])

    return df.select(key, text).mapInPandas(parse, f"{key} {kind}, record string, name string, kind string, owner string, start_line int, end_line int")
