"""Lookups, sources, policies and rules on small hand-made inputs, odd values included."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import lookup, records, rules
from sparkloom.sources import code, extract, manifests
from sparkloom.streaming import changes


def test_manifest_forms(spark):
    rows = [
        ("a/pom.xml", "<dependency><groupId>g</groupId><artifactId>x</artifactId><version>1.2</version></dependency><dependency><artifactId>y</artifactId></dependency>"),
        ("build.gradle", "implementation 'g:lib:3.1'\napi(\"g:other\")\n"),
        ("p.csproj", '<PackageReference Include="J" Version="13.0" />'),
        ("Cargo.toml", '[package]\nname = "me"\nversion = "0.1"\n[dependencies]\nserde = "1.0"\ntokio = { features = ["x"], version = "1.2" }\n'),
        ("go.mod", None), ("notes.txt", "gem 'no'"), ("Gemfile", ""),
    ]
    got = sorted((r.manager, r.name, r.version) for r in manifests.dependencies(spark.createDataFrame(rows, "path string, text string")).collect())
    assert got == [("cargo", "serde", "1.0"), ("cargo", "tokio", "1.2"), ("gradle", "g:lib", "3.1"), ("gradle", "g:other", None), ("maven", "x", "1.2"), ("maven", "y", None), ("nuget", "J", "13.0")]


def test_extraction_skips_what_does_not_parse(spark):
    rows = [(1, "class A(b.C):\n  async def f(self): g()\n"), (2, "def ("), (3, None), (4, "")]
    got = [(r.k, r.record, r.name, r.kind, r.owner) for r in extract.python(spark.createDataFrame(rows, "k int, text string"), "k", "text").collect()]
    assert got == [(1, "definition", "A", "CLASS", ""), (1, "reference", "b.C", "INHERITS", "A"), (1, "definition", "f", "METHOD", "A"), (1, "reference", "g", "CALLS", "A.f")]


def test_settings_of_broken_and_nested_texts(spark):
    rows = [(1, "a: {b: [1, 2], c: true}"), (2, "a: ["), (3, None), (4, "- 1")]
    got = [(r.k, r.path, r.entity_type, r.value) for r in code.settings(spark.createDataFrame(rows, "k int, text string"), "k", "text", "yaml").collect()]
    assert got == [(1, "root", "SECTION", "1"), (1, "root.a", "SECTION", "2"), (1, "root.a.b", "SECTION", "2"), (1, "root.a.c", "SETTING", "true")]


def test_relative_imports_and_reexports(spark):
    refs = spark.createDataFrame([("a/b/c.ts", "../d"), ("a/b/c.ts", "./e"), ("a/b/c.ts", "lib"), ("a/b/c.ts", "/a/f.ts")], "here string, ref string")
    paths = spark.createDataFrame([("a/d/index.ts",), ("a/b/e.js",), ("a/b/e.ts",), ("a/f.ts",)], "path string")
    assert {(r.ref, r.path) for r in lookup.relative_imports(refs, paths).collect()} == {("../d", "a/d/index.ts"), ("./e", "a/b/e.ts"), ("/a/f.ts", "a/f.ts")}
    files = spark.createDataFrame([("p", "export { A as B, C } from './m/n'\nfrom . import own\n"), ("q", None)], "package string, text string")
    symbols = spark.createDataFrame([("p.m.n.A",), ("p.own",)], "symbol string")
    assert [(r.alias, r.symbol) for r in lookup.reexports(files, symbols).collect()] == [("p.B", "p.m.n.A")]


def test_greedy_files_stop_at_the_first_that_does_not_fit(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1)], "file_path string, n long")
    for most, want in ((2, set()), (5, {"a", "b"}), (6, {"a", "b"}), (8, {"a", "b", "c", "d"}), (100, {"a", "b", "c", "d"})):
        assert {r.file_path for r in records.greedy_files(counts, most).collect()} == want
    assert records.greedy_files(counts.limit(0), 5).count() == 0


def test_patterns_and_boundaries(spark):
    assert records.safe_regex(r"[(+]+x{2}") and not records.safe_regex("(x+y)*") and not records.safe_regex("a" * 251)
    kind = changes.boundary(F.col("p"), F.col("e"), F.col("d"))
    rows = [("sequencer", "deleted", True, "boundary"), ("sequencer/todo", "modified", False, "in_progress"), ("", "x", False, "ignore"), ("refs", "x", True, "boundary"), ("a/index", "x", False, "ignore")]
    df = spark.createDataFrame(rows, "p string, e string, d boolean, want string")
    assert df.where(kind != F.col("want")).count() == 0


def test_rules_from_text(spark):
    text = "rules:\n- {rule_id: a, matchers: {name_patterns: ['x']}}\n- {rule_id: b, priority: 2}\n"
    made = rules.load(text)
    assert rules.fingerprint(made) == rules.fingerprint(made[::-1]) != rules.fingerprint(made[:1])
    for wrong in ("schema_version: 9", "rules: [{rule_id: a, matchers: {name_patterns: ['[x']}}]"):
        with pytest.raises(ValueError):
            rules.load(wrong)
    e = spark.createDataFrame([(f"e{i}", "x" if i == 3 else "n", "f", "CLASS", None) for i in range(40)], "entity_id string, name string, file_path string, entity_type string, metadata_json string")
    assert {(r.rule_id, r.hits, r.verdict) for r in rules.sample_gate(e, made).collect()} == {("a", 1, "pass"), ("b", 40, "fail")}


def test_labels_are_carried_by_card(spark):
    old = spark.createDataFrame([(1, "x", None, "L1"), (2, "y", "z", "L2")], "id int, a string, b string, label string")
    new = spark.createDataFrame([(7, "x", None), (8, "y", "q")], "id int, a string, b string")
    assert [tuple(r) for r in records.carried(old, new, ["a", "b"]).collect()] == [(7, "L1")]


def test_cohesion_counts_parts(spark):
    from sparkloom.operators import communities

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("c", "d"), ("g", "g")], "u string, v string")
    members = spark.createDataFrame([(x, "one") for x in "abc"] + [(x, "two") for x in "defg"], "id string, community string")
    assert {tuple(r) for r in communities.cohesion(edges, members).collect()} == {("one", 3, 1), ("two", 4, 3)}


def test_hooks_run_by_priority_then_id(spark):
    from sparkloom.operators.hooks import Hooks

    hooks = Hooks(("before", "after"))
    for name, priority in (("b", 1), ("a", 1), ("z", 0)):
        hooks.add("before", name, lambda df, name=name: df.withColumn("s", F.concat("s", F.lit(name))), priority)
    with pytest.raises(ValueError):
        hooks.add("before", "a", lambda df: df)
    df = spark.createDataFrame([("",)], "s string")
    assert hooks.run("before", df).first().s == "zab" and hooks.run("after", df).first().s == ""
