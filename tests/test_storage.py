"""Packs, workspaces, packages, extensions and holds on small hand-made inputs."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import aggregates, extensions, filters, graph, history, packages
from sparkloom.plans.catalog import Catalog
from sparkloom.plans.workspaces import Workspace, Workspaces
from sparkloom.sources import html, text
from sparkloom.streaming import changes


def made(path, members, **head):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        if head:
            z.writestr("manifest.json", json.dumps(head))
        for name, data in members:
            z.writestr(name, data)
    return str(path)


def test_pack_round_trip_and_guards(spark, tmp_path):
    a, b = Catalog(spark, str(tmp_path / "a")), Catalog(spark, str(tmp_path / "b"))
    a.commit({"t": spark.range(50), "u": spark.range(3)}, {"t": "id"})
    b.commit({"old": spark.range(1)})
    archive = str(tmp_path / "p.zip")
    assert a.export_pack(archive) >= 2 and b.import_pack(archive) == 2
    assert b.table("t").count() == 50 and b.table("u").count() == 3 and b.table("old").count() == 1
    good = {"schema_version": "1", "tables": ["t"]}
    for k, (members, head) in enumerate([
        ([("t/../x", "1")], good), ([("t/a/b", "1")], good), ([("v/a", "1")], good), ([("/t/a", "1")], good), ([("t/a", "1")], {}),
        ([], {"schema_version": "0", "tables": ["t"]}), ([], {"schema_version": "1", "tables": ["../t"]}), ([], {"schema_version": "1", "tables": ["_manifest"]}),
        ([("t/a", b"0" * (3 << 20))], good),  # 1,000 times its packed size
    ]):
        with pytest.raises(ValueError):
            b.import_pack(made(tmp_path / f"bad{k}.zip", members, **head))
    with pytest.raises(ValueError):
        b.import_pack(archive, most=10)
    assert b.table("t").count() == 50 and b.collect_garbage()


def test_delete_runs_and_status(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.commit({"runs": spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "run_uuid string, n int"), "files": spark.range(2)})
    c.delete_runs(spark.createDataFrame([("a",), ("a",), ("x",)], "run_uuid string"))
    assert sorted(r.n for r in c.table("runs").collect()) == [2, 3] and c.table("files").count() == 2
    assert {(r.name, r.generation) for r in c.status().collect()} == {("files", 1), ("runs", 2)}


def test_workspaces(spark, tmp_path):
    w = Workspaces(spark, str(tmp_path / "w.json"))
    assert w.all() == [] and w.frame().count() == 0 and not w.remove("a")
    assert w.add(Workspace("a", "/x", debounce_ms="soon", sync_state="odd", watch_mode="?")) == Workspace("a", "/x")
    w.add(Workspace("b", "/y", debounce_ms=1))
    w.add(Workspace("a", "/x", watch=True))
    assert [(x.name, x.watch, x.debounce_ms) for x in w.all()] == [("a", True, 2000), ("b", False, 100)]
    with pytest.raises(ValueError):
        w.add(Workspace("c", "/y"))
    assert w.get("b").path == "/y" and w.get("z") is None and w.remove("b") and [x.name for x in w.all()] == ["a"]
    with pytest.raises(KeyError):
        w.table("t")


def test_package_runs(spark):
    paths = ["a/b/__init__.py", "a/b/c/__init__.py", "a/b/c/m.py", "a/n.py", "x/__init__.py", "x/y/z/__init__.py", "x/y/z/q.py", "x/y/r.py", "top.py"]
    got = dict(packages.marked(spark.createDataFrame([(p,) for p in paths], "path string")).collect())
    assert got == {"a/b/__init__.py": "b", "a/b/c/__init__.py": "b.c", "a/b/c/m.py": "b.c.m", "x/__init__.py": "x", "x/y/z/__init__.py": "z", "x/y/z/q.py": "z.q"}


def test_manifests(spark):
    texts = [
        ("tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"#u/*": ["./s//*"], "h": ["http://x"], "e": [], },}}'), ("p/tsconfig.app.json", "broken"), ("p/go.mod", "// c\nmodule q.io/r\n"),
        ("setup.cfg", "[metadata]\nname = x\n[options.packages.find]\nwhere =\n    one\n    two\n"), ("l/pyproject.toml", '[tool.setuptools]\npackage-dir = {"" = "code"}\n'), ("Cargo.toml", ""), ("n/package.json", "{}"),
    ]
    m = spark.createDataFrame(texts, "path string, text string")
    assert {r.root for r in packages.roots(m).collect()} == {"", "one", "two", "l/code", "src"}
    known = {tuple(r) for r in packages.aliases(m).collect()}
    assert {k for k in known if k[0] != "h"} == {("#u/", "s/", True), ("q.io.r", "p", False)}
    refs = spark.createDataFrame([("#u/k.T",), ("q.io.r",), ("q.io.rest",), ("q.io.r.v",), (None,), ("",)], "ref string")
    assert {tuple(r) for r in packages.rewritten(refs, packages.aliases(m)).collect()} == {("#u/k.T", "s.k.T"), ("q.io.r", "p"), ("q.io.r.v", "p.v")}
    none = m.where("false")
    assert packages.roots(none).count() == packages.aliases(none).count() == packages.rewritten(refs, packages.aliases(none)).count() == 0


def test_packs_hooks_and_prints(spark):
    p = extensions.Packs([extensions.Pack("a", sets={"s": {"x"}}, maps={"m": {"k": "1"}}), extensions.Pack("b", maps={"m": {"k": "2"}}, languages={"py": extensions.Pack("b.py", sets={"s": {"y"}}, maps={"m": {}})})])
    assert p.words("s") == {"x"} and p.words("s", "py") == {"x", "y"} and p.mapping("m") == {"k": "2"} and p.mapping("m", "py") == {"k": "1"}
    with pytest.raises(ValueError):
        extensions.Packs([p.packs[0], p.packs[0]])
    hooks = [("h", "1", ("s1", "s2"), 5), ("g", "1", ("s1",), 1)]
    one = extensions.fingerprint(p.packs, hooks)
    assert one == extensions.fingerprint(p.packs[::-1], hooks[::-1]) and one != extensions.fingerprint(p.packs, [("h", "1", ("s1",), 5), hooks[1]])
    rows = [("python", "@x.setter\ndef x(self): pass", None), ("csharp", "int X { get; set; }", None), ("csharp", "int X { get; }", None), ("kotlin", "private var x = 1", None), ("kotlin", "val x = 1", None), ("typescript", "x", " set "), (None, None, None)]
    d = spark.createDataFrame(rows, "language string, d string, a string").select(extensions.property_access(F.col("language"), F.col("d"), F.col("a")).alias("k"))
    assert [r.k for r in d.collect()] == ["write", "write", "read", "write", "read", "write", "read"]
    meta = F.create_map(F.lit("_marker_text"), F.col("t"), F.lit("a"), F.lit("b"))
    c = spark.createDataFrame([("TODO:", True), (":", False), (None, True)], "t string, parsed boolean").select(extensions.classify_comment(meta, F.lit("py"), F.col("parsed")).alias("m")).collect()
    assert c[0].m == {"a": "b", "rationale_kind": "todo", "marker_comment": "true", "language": "py"} and c[1].m["rationale_kind"] == "comment" and c[1].m["line_scan_fallback"] == "true"
    assert c[2].m == {"_marker_text": None, "a": "b"}


def test_cache_by_content(spark):
    f = spark.createDataFrame([("a", "1", "v"), ("b", "2", "v"), ("c", "3", "v")], "path string, hash string, variant string")
    asked = []

    def build(d):
        asked.append(sorted(r.path for r in d.collect()))
        return d.withColumn("n", F.lit(1))

    kept = spark.createDataFrame([("a", "1", "v", 9, "2024-01-09"), ("b", "old", "v", 9, "2024-01-09"), ("c", "3", "v", 9, "2023-01-01")], "path string, hash string, variant string, n int, built_at string").withColumn("built_at", F.to_timestamp("built_at"))
    out = {r.path: (r.n, r.reused) for r in history.reuse(f, kept, build, "2024-01-10", 30).collect()}
    assert out == {"a": (9, True), "b": (1, False), "c": (1, False)} and asked == [["b", "c"]]
    assert history.reuse(f, kept, build).where("reused").count() == 2


def test_queue_keeps_what_came_during_a_flush(spark):
    e = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), ("c", 9)], "path string, ts int")
    done = spark.createDataFrame([("a", 3), ("b", 3)], "path string, started int")
    assert {tuple(r) for r in changes.pending(e, done).collect()} == {("a", 5), ("c", 9)}
    scan = spark.createDataFrame([("b", "modified"), ("c", "unchanged")], "path string, change string")
    assert {r.path for r in changes.catch_up(changes.pending(e, done), scan).collect()} == {"a", "b", "c"}
    row = spark.range(1).select(*[changes.release_at(F.lit(100), F.lit(x).cast("int")).alias(f"x{i}") for i, x in enumerate([None, 90, 601, 99999])]).first()
    assert tuple(row) == (30100, 100, 1100, 30100)


def test_global_orders(spark):
    d = spark.createDataFrame([(i, c) for i, c in enumerate([3, None, 4, 5, 1])], "k long, c long")
    assert sorted(r.k for r in aggregates.budget_cut(d, "c", 7, ["k"]).collect()) == [0, 1, 2]
    assert sorted(r.k for r in aggregates.strided_sample(d, "k", 2).collect()) == [0, 2]
    assert sorted(r.k for r in aggregates.strided_sample(d, "k", 9).collect()) == [0, 1, 2, 3, 4]
    none = d.where("false")
    assert aggregates.budget_cut(none, "c", 7, ["k"]).count() == 0 and aggregates.strided_sample(none, "k", 2).count() == 0


def test_trees_of_json_and_html(spark):
    deep = "[" * 20 + "]" * 20
    rows = [(1, '{"a": {}, "b": [{"c": 1}], "d": true}'), (2, "nope"), (3, None), (4, "7"), (5, '{"u": "a, ] // b",} // c'), (6, deep)]
    got = {tuple(r) for r in text.json_tree(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    doc = {(i, "document", "DOCUMENT", None) for i in (1, 4, 5, 6)}
    assert got == doc | {(1, "root", "SECTION", "3"), (1, "root.a", "SECTION", "0"), (1, "root.b", "SECTION", "1"), (1, "root.d", "SETTING", "true"), (4, "root", "SETTING", "7"), (5, "root", "SECTION", "1"), (5, "root.u", "SETTING", "a, ] // b"), (6, "root", "SECTION", "1")}
    page = spark.createDataFrame([(1, "<P id=a ID='b' class=\"c d\"><br><link rel=icon href=x>"), (2, None), (3, "")], "page_id int, html string")
    e = {(r.ord, r.tag): r.attrs for r in html.attributes(page).collect()}
    assert e == {(0, "p"): {"id": "a", "class": "c d"}, (1, "br"): {}, (2, "link"): {"rel": "icon", "href": "x"}}
    assert {r.relation_type for r in html.graph(page).collect()} == {"CONTAINS"}


def test_cut_text_and_prunable(spark):
    d = spark.createDataFrame([("ab\ncdefgh",), ("abcdefghij",), ("\nabcdefghi",), ("ab",), ("",), (None,)], "t string")
    assert [r.c for r in d.select(filters.cut_to_tokens(F.col("t"), 1).alias("c")).collect()] == ["ab", "abcd", "\nabc", "ab", "", None]
    e = spark.createDataFrame([("a", "FUNCTION", None), ("b", "FUNCTION", True), ("c", "ENTRY_POINT", False), ("d", "EXTERNAL_SYMBOL", False), ("unresolved:d", "EXTERNAL_SYMBOL", False), ("e", None, None), ("f", "FUNCTION", False)], "entity_id string, entity_type string, is_exported boolean")
    r = spark.createDataFrame([("f", "z")], "source_id string, target_id string")
    assert {x.entity_id for x in graph.prunable(e, r).collect()} == {"a", "unresolved:d", "e"}
    assert {x.entity_id for x in graph.prunable(e, r, e.where("entity_id = 'a'"), False, False).collect()} == {"b", "c", "unresolved:d", "e"}
