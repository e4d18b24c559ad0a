"""What users add: data packs of sets and maps, extractors by language, built-in hooks as Columns, one print of it all."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pack:
    """Named sets and maps; under `languages` a key's entry stands in the place of the general one."""

    pack_id: str
    version: str = "1"
    sets: dict[str, set[str]] = field(default_factory=dict)
    maps: dict[str, dict[str, str]] = field(default_factory=dict)
    languages: dict[str, Pack] = field(default_factory=dict)

    def _own(self, kind: str, key: str, language: str | None):
        special = getattr(self.languages[language], kind) if language in self.languages else {}
        return special.get(key, getattr(self, kind).get(key))


class Packs:
    """Packs in order of registration. Sets are united over packs; of maps the later pack's value wins."""

    def __init__(self, packs: Iterable[Pack]):
        self.packs = list(packs)
        if len({p.pack_id for p in self.packs}) < len(self.packs):
            raise ValueError("two packs of one id")

    def words(self, key: str, language: str | None = None) -> set[str]:
        return set().union(*[p._own("sets", key, language) or set() for p in self.packs])

    def mapping(self, key: str, language: str | None = None) -> dict[str, str]:
        return {k: v for p in self.packs for k, v in (p._own("maps", key, language) or {}).items()}

    def _by_language(self, language: Column, make: Callable[[str | None], Column]) -> Column:
        out = make(None)
        for name in sorted({n for p in self.packs for n in p.languages}):
            out = F.when(language == name, make(name)).otherwise(out)
        return out

    def member(self, key: str, language: Column, value: Column) -> Column:
        """Whether value is in the set as the row's language has it; false for null."""
        return F.coalesce(self._by_language(language, lambda n: value.isin(*sorted(self.words(key, n)))), F.lit(False))

    def lookup(self, key: str, language: Column, value: Column) -> Column:
        """The map's value as the row's language has it, else null."""

        def make(n):
            pairs = [F.lit(x) for kv in sorted(self.mapping(key, n).items()) for x in kv]
            return F.try_element_at(F.create_map(*pairs), value) if pairs else F.lit(None).cast("string")

        return self._by_language(language, make)


def _plain(x):
    if isinstance(x, (set, frozenset)):
        return sorted(x)
    if isinstance(x, Pack):
        return {"sets": _plain(x.sets), "maps": x.maps, "languages": _plain(x.languages)}
    return {k: _plain(v) for k, v in x.items()} if isinstance(x, dict) else x


def fingerprint(packs: Iterable[Pack] = (), hooks: Iterable[tuple[str, str, tuple[str, ...], int]] = (), rules: Iterable[tuple[str, str, Iterable[str]]] = ()) -> str:
    """SHA-256 of a set of plugins, whatever their order: packs, hooks (id, version, stages, priority), rules (id, version, rule ids)."""
    lines = [("pack", p.pack_id, p.version, _plain(p)) for p in packs]
    lines += [("hook", i, v, [sorted(stages), priority]) for i, v, stages, priority in hooks]
    lines += [("rules", i, v, sorted(ids)) for i, v, ids in rules]
    return hashlib.sha256("\n".join(sorted(json.dumps(x, sort_keys=True) for x in lines)).encode()).hexdigest()


class Extractors:
    """Functions from files (path, language, text) to entities, by language; one plan over all of them."""

    def __init__(self):
        self._by_language: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, language: str, f: Callable[[DataFrame], DataFrame], replace: bool = False) -> None:
        if language in self._by_language and not replace:
            raise ValueError(language)
        self._by_language[language] = f

    def run(self, files: DataFrame, fallback: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Entities of all files; languages without an extractor go to the fallback, or give nothing."""
        known = sorted(self._by_language)
        parts = [self._by_language[n](files.where(F.col("language") == n)) for n in known]
        if fallback:
            parts.append(fallback(files.where(~F.coalesce(F.col("language").isin(*known), F.lit(False)))))
        if not parts:
            raise ValueError("no extractor")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out


# The built-in hooks. Metadata is a map<string,string> column.


def put(metadata: Column, values: dict[str, Column]) -> Column:
    """metadata with the values in place of its own; a null value leaves its key as it was."""
    new = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    old = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def stamp_language(metadata: Column, language: Column, ecosystem: Column) -> Column:
    """language on all but stubs, bsg.language (the ecosystem's name) on stubs too; nothing where the language is not known."""
    none = F.lit(None).cast("string")
    stub = F.coalesce(F.map_contains_key(metadata, F.lit("stub_resolution_state")) | F.map_contains_key(metadata, F.lit("reference_type")), F.lit(False))
    return put(metadata, {"language": F.when(~stub, language).otherwise(none), "bsg.language": F.when(language.isNotNull(), ecosystem).otherwise(none)})


def classify_comment(metadata: Column, language: Column, parsed: Column) -> Column:
    """A comment's marker word (_marker_text) turned into its kind; other rows as they were."""
    marker = F.try_element_at(metadata, F.lit("_marker_text"))
    kind = F.lower(F.trim(F.regexp_replace(marker, ":+$", "")))
    rest = F.map_filter(metadata, lambda k, v: k != "_marker_text")
    done = put(rest, {"rationale_kind": F.when(kind == "", "comment").otherwise(kind), "marker_comment": F.lit("true"), "language": language, "line_scan_fallback": F.when(~parsed, "true")})
    return F.when(marker.isNotNull(), done).otherwise(metadata)


def property_access(language: Column, declaration: Column, accessor: Column) -> Column:
    """write for setters and mutable properties by the declaration's text, else read."""
    by_language = (language == "python") & F.rlike(declaration, F.lit(r"(?m)^\s*@\w+\.setter\b"))
    by_language |= (language == "csharp") & F.rlike(declaration, F.lit(r"\{[^}]*\bset\b"))
    by_language |= (language == "kotlin") & F.rlike(declaration, F.lit(r"^\s*(?:\w+\s+)*var\b"))
    return F.when(F.coalesce(by_language, F.lit(False)) | F.coalesce(F.trim(accessor) == "set", F.lit(False)), "write").otherwise("read")


def prune_reason(name: Column, builtin: Column, noise: Column, imported: Column, crosses: Column) -> Column:
    """Why an open reference goes (empty_ref, builtin, noise_symbol, unimported_simple_name) or, with a leading +, stays."""
    clean = F.trim(name)
    return (
        F.when(F.coalesce(clean, F.lit("")) == "", "empty_ref").when(builtin, "builtin").when(noise, "noise_symbol")
        .when(F.rlike(clean, F.lit("[./:]")), "+qualified_name").when(imported, "+imported").when(crosses, "+cross_file_rel").otherwise("unimported_simple_name")
    )
