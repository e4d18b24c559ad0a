"""Types of receivers: what the variable of a call holds, from signatures, defaults, assignments, class names and files."""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins as J
from .graph import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

# Names in annotations. A container is the type itself, a wrapper stands for what it holds, the rest give no type.
CONTAINERS = ("list", "dict", "set", "tuple", "frozenset", "List", "Dict", "Tuple", "Set", "FrozenSet", "Sequence", "Mapping", "MutableMapping", "Iterable", "Iterator", "Callable", "Awaitable", "Coroutine", "Promise", "Array", "ReadonlyArray", "Record", "Vec", "HashMap", "HashSet", "Option", "Result", "Maybe", "Literal")
WRAPPERS = ("Optional", "Union", "Annotated", "Type", "type", "Partial", "Required", "NotRequired", "ClassVar", "Final", "Box")
NO_TYPES = ("None", "NoneType", "null", "undefined", "void", "Any", "unknown", "never", "Self", "int", "str", "float", "bool", "bytes", "complex", "string", "number", "boolean", "object", "symbol", "bigint", "char", "i8", "i16", "i32", "i64", "i128", "u8", "u16", "u32", "u64", "u128", "usize", "isize", "f16", "f32", "f64")
SELVES = ("self", "this", "cls")

_MARK = re.compile(r"[(\[{]|[)\]}]|(?<![=-])>|=(?!>)|[<,:]")
_NAME = re.compile(r"\**\s*([A-Za-z_]\w*)\s*")


def type_in(text: Column) -> Column:
    """The type an annotation names: its first container, else its first capitalised name, else its first name; null where none is."""
    names = F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w*)"), F.lit(1))
    held = F.filter(names, lambda x: x.isin(*CONTAINERS))
    free = F.filter(names, lambda x: ~x.isin(*WRAPPERS, *NO_TYPES))
    upper = F.filter(free, lambda x: F.rlike(x, F.lit("^[A-Z]")))
    return F.coalesce(F.get(held, F.lit(0)), F.get(upper, F.lit(0)), F.get(free, F.lit(0)))


def return_type(signature: Column) -> Column:
    """The type behind `->` or, where there is no arrow, behind the colon after the parameters."""
    arrow = F.nullif(F.regexp_extract(signature, r"->[\s:]*([^={;]+)", 1), F.lit(""))
    colon = F.nullif(F.regexp_extract(signature, r"\)\s*:([^={;()]+)$", 1), F.lit(""))
    return type_in(F.coalesce(arrow, colon))


def split_parameters(signature: str | None) -> list[tuple[str, str | None, str | None]]:
    """(name, annotation, default) of each parameter. Commas, colons and equals signs count outside brackets only.

    Angle brackets are brackets up to a default's equals sign, comparisons after it. Own names of the instance and
    parts that do not begin with a plain name are left out; an unclosed list gives nothing.
    """
    text = signature if signature and "(" in signature else ""
    out, depth, begin, colon, equal = [], 0, None, None, None

    def close(end: int) -> None:
        name = _NAME.fullmatch(text[begin : min(x for x in (colon, equal, end) if x is not None)].strip())
        if name and name[1] not in SELVES:
            note = text[colon + 1 : end if equal is None else equal].strip() if colon is not None else None
            out.append((name[1], note or None, text[equal + 1 : end].strip() or None if equal is not None else None))

    for m in _MARK.finditer(text, max(text.find("("), 0)):
        sign = m.group()
        if sign in "([{" or (sign == "<" and equal is None):
            depth += 1
            begin = m.end() if begin is None else begin
        elif sign in ")]}" or (sign == ">" and equal is None):
            depth -= 1
            if depth == 0:
                close(m.start())
                return out
        elif depth == 1 and sign == ",":
            close(m.start())
            begin, colon, equal = m.end(), None, None
        elif depth == 1 and sign == ":" and equal is None and colon is None:
            colon = m.start()
        elif depth == 1 and sign == "=" and equal is None:
            equal = m.start()
    return []


def parameters(callables: DataFrame) -> DataFrame:
    """(scope, file_path, var, annotation, default) of callables (id, file_path, signature). Brackets nest, so this is an Arrow pass."""

    def parse(frames):
        for df in frames:
            df["p"] = [split_parameters(s) for s in df["signature"]]
            df = df.explode("p").dropna(subset=["p"])
            for i, c in enumerate(("var", "annotation", "default")):
                df[c] = [p[i] for p in df["p"]]
            yield df[["scope", "file_path", "var", "annotation", "default"]]

    slim = callables.where("signature is not null").select(F.col("id").alias("scope"), "file_path", "signature")
    return slim.mapInPandas(parse, "scope string, file_path string, var string, annotation string, default string")


def makers(callables: DataFrame, types: DataFrame) -> DataFrame:
    """(name, type): what calling a name gives, a type itself or a callable's return type; of equal names types first, then the smallest."""
    made = types.where("not module").select("name", F.lit(0).alias("r"), F.col("name").alias("type"))
    made = made.unionByName(callables.select("name", F.lit(1).alias("r"), return_type(F.col("signature")).alias("type")).where("type is not null"))
    return made.groupBy("name").agg(F.min(F.struct("r", "type")).alias("b")).select("name", "b.type")


def _made(rows: DataFrame, keys: list[str], names: Column, known: DataFrame) -> DataFrame:
    """keys and type: the first of the names, each also by its last part, that makes a type."""
    each = rows.select(*keys, F.posexplode(names).alias("i", "full"))
    each = each.select(*keys, F.col("i"), F.posexplode(F.array("full", F.element_at(F.split("full", r"\."), -1))).alias("j", "name"))
    return each.join(known, "name").groupBy(*keys).agg(F.min(F.struct("i", "j", "type")).alias("b")).select(*keys, "b.type")


def infer(calls: DataFrame, callables: DataFrame, types: DataFrame, assigned: DataFrame) -> DataFrame:
    """(call_id, type, source): the type of each call's receiver; type and source are null where nothing tells.

    In order: own names give the enclosing type and nothing else; the annotation of a parameter of the scope
    (receiver_param); its default's producer, then the last assignment at or before the call's line
    (receiver_assignment), which ends the search even if its own type is unknown; the variable as a type's name; the same
    parameter's annotation elsewhere in the file, of the smallest id (receiver_type). A receiver of several parts is a
    type or module by its whole name, or below the enclosing type, or nothing. Calls without a line see no assignment.

    calls: (call_id, scope, file_path, var, line); callables: (id, name, file_path, signature, owner); types: (name,
    module), modules marked; assigned: (scope, var, line, callee).
    """
    known, params = makers(callables, types), cut(parameters(callables).withColumn("note", type_in(F.col("annotation"))))  # signatures are parsed once
    calls_in = r"([A-Za-z_][\w.]*)(?=\s*\()|(?<=\()([A-Za-z_][\w.]*)(?=\))"
    by_default = _made(params.where("note is null and default is not null"), ["scope", "var"], F.regexp_extract_all("default", F.lit(calls_in), F.lit(0)), known)
    by_param = params.where("note is not null").groupBy("scope", "var").agg(F.min("note").alias("param"))
    by_file = params.where("note is not null").groupBy("file_path", "var").agg(F.min_by("note", F.struct("scope", "note")).alias("elsewhere"))
    bound = assigned.select("scope", "var", "line", "callee").distinct()
    bound = bound.join(_made(bound, ["callee"], F.array("callee"), known), "callee", "left")
    bound = bound.groupBy("scope", "var", "line").agg(F.max(F.coalesce("type", F.lit(""))).alias("a"))  # "": assigned, of unknown type
    c = calls.select("call_id", "scope", "file_path", "var", "line", F.struct("scope", "var").alias("k"))
    c = J.as_of(c, bound.select(F.struct("scope", "var").alias("k"), F.col("line").alias("at"), "a"), "k", "line", "at", "a").drop("k")
    c = c.join(callables.groupBy(F.col("id").alias("scope")).agg(F.min("owner").alias("owner")), "scope", "left")
    c = c.join(by_param, ["scope", "var"], "left").join(by_default.withColumnRenamed("type", "default"), ["scope", "var"], "left").join(by_file, ["file_path", "var"], "left")
    head = F.substring_index("var", ".", 1)
    c = c.withColumn("inner", F.when(head.isin(*SELVES), F.concat("owner", F.expr("substring(var, length(substring_index(var, '.', 1)) + 1)"))))
    named = types.groupBy("name").agg(F.bool_and("module").alias("module"))
    c = c.join(named.select(F.col("name").alias("var"), F.col("module").alias("v_module")), "var", "left")
    c = c.join(named.select(F.col("name").alias("inner"), F.col("module").alias("i_module")), "inner", "left")
    whole = F.when(F.col("i_module").isNotNull(), F.col("inner")).when(F.col("v_module").isNotNull(), F.col("var"))
    weak = F.when(F.col("a").isNull(), F.coalesce(F.when(~F.col("v_module"), F.col("var")), F.col("elsewhere")))
    flow = F.coalesce("default", F.nullif("a", F.lit("")))
    plain = ~F.contains("var", F.lit(".")) & ~F.col("var").isin(*SELVES)
    kind = F.when(F.col("var").isin(*SELVES), F.col("owner")).when(~plain, whole).otherwise(F.coalesce("param", flow, weak))
    source = F.when(plain & F.col("param").isNotNull(), "receiver_param").when(plain & flow.isNotNull(), "receiver_assignment").otherwise("receiver_type")
    return c.select("call_id", kind.alias("type"), F.when(kind.isNotNull(), source).alias("source"))
