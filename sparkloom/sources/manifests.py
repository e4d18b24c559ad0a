"""Dependency manifests that are lines or tags: (path, manager, name, version), all by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Manager, file name pattern and the pattern whose groups are name and version.
FORMS = (
    ("go", r"(^|/)go\.mod$", r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v[\w.+-]+)"),
    ("gem", r"(^|/)Gemfile$", r"(?m)^\s*gem\s+['\"]([\w-]+)['\"](?:\s*,\s*['\"]([^'\"]*)['\"])?"),
    ("maven", r"(^|/)pom\.xml$", r"(?s)<dependency>.*?<artifactId>\s*([^<\s]+)\s*</artifactId>(?:(?!</dependency>).)*?(?:<version>\s*([^<\s]*)\s*</version>.*?)?</dependency>"),
    ("gradle", r"(^|/)build\.gradle(\.kts)?$", r"(?m)^\s*(?:implementation|api|compileOnly|testImplementation)\s*\(?['\"]([\w.-]+:[\w.-]+)(?::([\w.+-]+))?['\"]"),
    ("nuget", r"\.csproj$", r"<PackageReference\s+Include=\"([^\"]+)\"(?:\s+Version=\"([^\"]*)\")?"),
    ("cran", r"(^|/)DESCRIPTION$", r"(?m)^\s+([A-Za-z][\w.]*)(?:\s*\([<>=]+\s*([\w.-]+)\))?,?\s*$"),
    ("cpan", r"(^|/)cpanfile$", r"(?m)^\s*requires\s+['\"]([\w:]+)['\"](?:\s*,\s*['\"]?([\w.]+))?"),
    ("pub", r"(^|/)pubspec\.yaml$", r"(?m)^  ([a-z_][a-z0-9_]*):\s*(\^?[\d][\w.+-]*)\s*$"),
    ("swift", r"(^|/)Package\.swift$", r"\.package\(\s*url:\s*\"[^\"]*/([\w.-]+?)(?:\.git)?\"\s*,\s*from:\s*\"([^\"]+)\""),
    ("rebar", r"(^|/)rebar\.config$", r"\{\s*([a-z]\w*)\s*,\s*\"([^\"]+)\"\s*\}"),
    ("cargo", r"(^|/)Cargo\.toml$", r"(?m)^([a-z][\w-]*)\s*=\s*(?:\{[^}\n]*version\s*=\s*)?\"[\^~=]?(\d[\w.+-]*)\""),
)


def dependencies(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, manager, name, version) of all known manifest files of df; version null where none is named.

    Keys of a Cargo package section (name, version, edition, rust-version) are no dependencies.
    """
    def pairs(manager: str, pattern: str) -> Column:
        names, versions = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        return F.transform(F.arrays_zip(names.alias("n"), versions.alias("v")), lambda x: F.struct(F.lit(manager).alias("manager"), x["n"].alias("name"), F.nullif(x["v"], F.lit("")).alias("version")))

    found = [F.when(F.rlike(path, F.lit(file)), pairs(manager, p)) for manager, file, p in FORMS]
    each = df.select(path, F.inline(F.flatten(F.array_compact(F.array(*found)))))
    return each.where("not (manager = 'cargo' and name in ('name', 'version', 'edition', 'rust-version'))")


def workspace_rows(dependencies: DataFrame, own: DataFrame) -> DataFrame:
    """(scope, manager, name, version): external dependencies and the workspace's own packages, a package not twice."""
    mine = own.select(F.lit("workspace").alias("scope"), "manager", "name", "version").distinct()
    rest = dependencies.join(own.select("manager", "name").distinct(), ["manager", "name"], "left_anti")
    return mine.unionByName(rest.select(F.lit("dependency").alias("scope"), "manager", "name", "version").distinct())
