"""The ladder of stub resolution and receiver typing on small inputs."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import calls, ladder, receivers, rules
from sparkloom.streaming import queue


@pytest.mark.parametrize(
    ("signature", "want"),
    [
        (None, []), ("", []), ("no list", []), ("def f()", []), ("def f(a", []),
        ("def f(self, a: Map[str, B] = {'x': 1}, *rest: C, **kw)", [("a", "Map[str, B]", "{'x': 1}"), ("rest", "C", None), ("kw", None, None)]),
        ("fn(a: Map<K, V>, b = x < y, c: D)", [("a", "Map<K, V>", None), ("b", None, "x < y"), ("c", "D", None)]),
        ("f(cb: (n: number) => void, d: E)", [("cb", "(n: number) => void", None), ("d", "E", None)]),
        ("[x] f(a=lambda: 1, {b}: P)", [("a", None, "lambda: 1")]),
    ],
)
def test_parameters_of_signatures(signature, want):
    assert receivers.split_parameters(signature) == want


def test_types_in_annotations(spark):
    rows = [("Optional[Store]", "Store"), ("User | list[int]", "list"), ("type[Foo]", "Foo"), ("int", None), (None, None), ("small.Big", "Big"), ("lower", "lower"), ("", None)]
    df = spark.createDataFrame(rows, "a string, w string").select("w", receivers.type_in(F.col("a")).alias("t"))
    assert all(r.t == r.w for r in df.collect())
    rows = [("def f() -> Store:", "Store"), ("f(a: B): Promise<C>", "Promise"), ("def f(a: B):", None), ("def f() -> None", None), (None, None)]
    df = spark.createDataFrame(rows, "a string, w string").select("w", receivers.return_type(F.col("a")).alias("t"))
    assert all(r.t == r.w for r in df.collect())


def inferred(spark, calls, callables=(), types=(), assigned=()):
    c = spark.createDataFrame(list(calls), "call_id string, scope string, file_path string, var string, line int")
    f = spark.createDataFrame(list(callables), "id string, name string, file_path string, signature string, owner string")
    t = spark.createDataFrame(list(types), "name string, module boolean")
    a = spark.createDataFrame(list(assigned), "scope string, var string, line int, callee string")
    return {r.call_id: (r.type, r.source) for r in receivers.infer(c, f, t, a).collect()}


def test_later_and_unknown_assignments(spark):
    calls = [("before", "s", "a", "v", 1), ("first", "s", "a", "v", 5), ("second", "s", "a", "v", 9), ("third", "s", "a", "v", 99), ("none", "s", "a", "v", None), ("null", None, None, None, None), ("v", "q", "a", "A", 3)]
    got = inferred(spark, calls, types=[("A", False), ("B", False)], assigned=[("s", "v", 5, "A"), ("s", "v", 9, "pkg.B"), ("s", "v", 90, "unknown")])
    assign = "receiver_assignment"
    assert got == {"before": (None, None), "first": ("A", assign), "second": ("B", assign), "third": (None, None), "none": (None, None), "null": (None, None), "v": ("A", "receiver_type")}


def test_own_names_and_chains(spark):
    fs = [("s", "m", "a", "def m(self: Wrong, a: int = 0)", "Own"), ("free", "f", "a", None, None)]
    calls = [("self", "s", "a", "self", 1), ("free", "free", "a", "self", 1), ("attr", "s", "a", "self.db", 1), ("other", "s", "a", "self.x", 1), ("mod", "s", "a", "pkg.sub", 1), ("plain", "s", "a", "pkg", 1), ("int", "s", "a", "a", 1)]
    got = inferred(spark, calls, fs, [("Own", False), ("Own.db", False), ("pkg.sub", True), ("pkg", True)])
    weak = "receiver_type"
    assert got == {"self": ("Own", weak), "free": (None, None), "attr": ("Own.db", weak), "other": (None, None), "mod": ("pkg.sub", weak), "plain": (None, None), "int": (None, None)}


def climbed(spark, stubs, symbols, aliases=(), parents=(), received=(), externals=(), stdlib=()):
    s = spark.createDataFrame(list(stubs), "stub string, ref string, scope string, file_path string")
    y = spark.createDataFrame(list(symbols), "name string, id string, kind string, external boolean")
    a = spark.createDataFrame(list(aliases), "prefix string, target string, open boolean")
    p = spark.createDataFrame(list(parents), "stub string, parent string")
    r = spark.createDataFrame(list(received), "stub string, type string, source string")
    e = spark.createDataFrame([(x,) for x in externals], "module string")
    out = ladder.climb(s, y, a, p, r, e, list(stdlib))
    return {x.stub: (x.target, x.strategy, float(x.confidence), list(x.candidates)) for x in out.collect()}


def test_first_strategy_wins_and_others_make_it_ambiguous(spark):
    stubs = [("a", "x.f", "d/m/C", "d/m.py"), ("b", "lib.f", "s", "d/m.py"), ("c", "f", "s", "m.py"), ("d", None, None, None)]
    symbols = [("x.f", "1", "FUNCTION", False), ("d.x.f", "2", "FUNCTION", None), ("d.m.x.f", "3", "FUNCTION", False), ("lib.f", "4", "FUNCTION", True), ("lib.f", "9", "FUNCTION", True), ("f", "unresolved:q", "FUNCTION", False), ("f", "c", "FUNCTION", False)]
    got = climbed(spark, stubs, symbols, externals=["lib"])
    assert got == {
        "a": ("1", "exact_match", 0.5, ["1", "2", "3"]),
        "b": ("4", "exact_match", 0.95, ["4"]),  # the made member is external and so no second meaning
        "c": (None, None, 0.0, []),  # neither a stub nor the stub itself
        "d": (None, None, 0.0, []),
    }


def test_own_crate_before_the_shared_name(spark):
    stubs = [("a", "crate.u.f", "s", "one/src/deep/m.rs"), ("b", "crate.u.f", "s", "src"), ("c", "crate.u.f", "s", "two/lib/m.rs")]
    symbols = [("crate.u.f", "any", "FUNCTION", False), ("one.src.u.f", "own", "FUNCTION", False)]
    got = climbed(spark, stubs, symbols)
    assert got["a"] == ("own", "scope_qualified", 0.5, ["own", "any"]) and got["b"][:2] == got["c"][:2] == ("any", "exact_match")


def test_module_suffixes_must_be_unique(spark):
    stubs = [("one", "app.x.Y", "s", "f"), ("two", "dup.Z", "s", "f"), ("whole", "app.x", "s", "f"), ("alias", "@/x.Y", "s", "f")]
    symbols = [("back.app.x", "m1", "MODULE", False), ("back.app.x.Y", "y", "CLASS", False), ("a.dup", "m2", "MODULE", False), ("b.dup", "m3", "MODULE", False), ("a.dup.Z", "z", "CLASS", False)]
    got = climbed(spark, stubs, symbols, aliases=[("@/", "app", True)])
    assert got["one"][:2] == ("y", "package_alias") and got["whole"][:2] == ("m1", "package_alias") and got["two"][0] is None
    assert got["alias"][0] is None  # the alias gives appx.Y: targets end in their own slash
    assert climbed(spark, stubs, symbols, aliases=[("@/", "app/", True)])["alias"][:2] == ("y", "package_alias")


def test_siblings_join_modules_only(spark):
    stubs = [("f", "Field", "s", "a"), ("m", "pyd", "s", "a"), ("k", "Klass", "s", "a"), ("else", "Field", "t", "a")]
    symbols = [("pyd.Field", "1", "CLASS", False), ("Klass", "2", "CLASS", False), ("Klass.Field", "3", "METHOD", False)]
    got = climbed(spark, stubs, symbols)
    assert got["f"] == ("1", "sibling_module", 0.75, ["1"]) and got["else"][0] is None and got["k"][:2] == ("2", "exact_match")


def test_relative_paths_stay_in_the_tree(spark):
    stubs = [("ok", "./b.ts", "", "x/a.ts"), ("up", "../b", "", "x/a.ts"), ("out", "../../b", "", "x/a.ts"), ("root", "/b", "", None), ("net", "//b", "", "x/a.ts"), ("top", "../b", "", "a.ts"), ("lost", "./b", "", None)]
    got = climbed(spark, stubs, [("x/b", "xb", "MODULE", False), ("b", "b", "MODULE", False)])
    assert {k: v[0] for k, v in got.items()} == {"ok": "xb", "up": "b", "out": None, "root": "b", "net": None, "top": None, "lost": None}


def test_members_with_hashes_after_exact_names(spark):
    stubs = [("a", "v.run", "", ""), ("b", "v.go", "", "")]
    symbols = [("T.run_[ff]", "hash", "METHOD", False), ("T.run", "exact", "METHOD", False), ("T.go_[0a]", "go", "METHOD", False), ("T.go_[0b]", "p", "CLASS", False)]
    got = climbed(spark, stubs, symbols, received=[("a", "T", "receiver_param"), ("b", "T", "receiver_type")])
    assert got == {"a": ("exact", "receiver_param", 0.9, ["exact"]), "b": ("go", "receiver_type", 0.65, ["go"])}


def test_ladder_of_nothing(spark):
    assert climbed(spark, [], []) == {} and inferred(spark, []) == {}


def flushed(df):
    return sorted((r.repo or "", str(r.first_at), str(r.last_at), str(r.flush_at), r.n, r.events, r.reason) for r in df.collect())


def events_of(spark, rows):
    df = spark.createDataFrame(rows, "repo string, t string, path string")
    return df.select("repo", F.to_timestamp("t").alias("ts"), "path")


def test_pending_queue_with_both_timers(spark):
    day = "2024-01-01 00:"
    quiet = [("q", f"{day}00:0{s}", f"f{s % 4}") for s in (0, 2, 4)] + [("q", f"{day}00:07", None)]
    stale = [("s", f"{day}{s // 60:02d}:{s % 60:02d}", "same") for s in range(0, 123, 2)]
    full = [(None, f"{day}10:00", f"p{i}") for i in range(7)] + [("none", None, "x")]
    got = flushed(queue.flushes(events_of(spark, quiet + stale + full), most=3))
    d = day
    assert got == [
        ("", f"{d}10:00", f"{d}10:00", f"{d}10:00", 3, 3, "threshold"), ("", f"{d}10:00", f"{d}10:00", f"{d}10:00", 3, 3, "threshold"), ("", f"{d}10:00", f"{d}10:00", f"{d}10:02", 1, 1, "debounce"),
        ("q", f"{d}00:00", f"{d}00:04", f"{d}00:06", 2, 3, "debounce"), ("q", f"{d}00:07", f"{d}00:07", f"{d}00:09", 1, 1, "debounce"),
        ("s", f"{d}00:00", f"{d}01:00", f"{d}01:00", 1, 31, "staleness"), ("s", f"{d}01:02", f"{d}02:02", f"{d}02:02", 1, 31, "staleness"),
    ]
    assert flushed(queue.flushes(events_of(spark, []))) == []


def test_pending_queue_of_a_stream(spark, tmp_path):
    """Three micro-batches end as one batch does; what the watermark has not passed still waits."""
    day = "2024-01-01 00:"
    batches = [
        [("a", f"{day}00:0{s}", f"f{s}") for s in (0, 1)] + [("b", f"{day}00:{s:02d}", "same") for s in range(0, 40, 2)],
        [("a", f"{day}00:02", "f2"), ("a", f"{day}00:30", "g")] + [("b", f"{day}{s // 60:02d}:{s % 60:02d}", "same") for s in range(40, 90, 2)] + [("c", f"{day}01:00", f"p{i}") for i in range(4)],
        [("end", "2024-01-01 05:00:00", "end")],
    ]
    for i, rows in enumerate(batches):
        events_of(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    every = [r for b in batches for r in b]
    schema = events_of(spark, every).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    q = queue.stream(stream, most=4).writeStream.outputMode("append").format("memory").queryName("pending").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    want = [r for r in flushed(queue.flushes(events_of(spark, every), most=4)) if r[0] != "end"]
    assert flushed(spark.table("pending")) == want and {r[-1] for r in want} == {"debounce", "staleness", "threshold"}


RELS = "source_id string, target_id string, relation_type string, roles int, confidence float, line int"


def test_edges_of_a_page_through_stubs(spark):
    rels = spark.createDataFrame(
        [("a", "unresolved:x", "CALLS", 8, 0.9, 5), ("a", "t", "CALLS", 8, None, 3), ("t", "b", "CALLED_BY", None, 0.2, 1), ("t", "t", "CALLS", 4, 1.0, 2), ("q", "unresolved:y", "CALLS", 8, 1.0, 1), ("u", "v", "CALLS", 8, 1.0, 1)], RELS
    )
    page = spark.createDataFrame([("t",), ("t",)], "id string")
    stubs = spark.createDataFrame([("unresolved:x", "t"), ("unresolved:y", "other"), ("unresolved:z", "unresolved:x")], "stub string, target string")

    def got(**kw):
        return {(r.source_id, r.target_id, r.relation_type, r.line, r.stub_id) for r in calls.page_edges(rels, page, stubs, **kw).collect()}

    plain, turned, own = ("a", "t", "CALLS", 3, None), ("b", "t", "CALLS", 1, None), ("t", "t", "CALLS", 2, None)
    assert got() == {plain, turned, own} and got(direction="outgoing") == {own} and got(least=0.5) == {plain, own}
    assert got(roles=("readaccess",), direction="incoming") == {plain} and got(types=["READS"]) == set()
    rels = rels.where("line = 5")
    assert got() == {("a", "t", "CALLS", 5, "unresolved:x")}
    with pytest.raises(ValueError):
        got(direction="sideways")


def test_entity_without_edges_and_unknown_names(spark):
    e = spark.createDataFrame([("i1", "one", "CLASS", "a.py"), ("i2", "two", "CLASS", "a.py")], "entity_id string, name string, entity_type string, file_path string")
    rels = spark.createDataFrame([("i2", "i2", "CALLS", 1, 1.0, 1), ("x", "unresolved:t", "CALLS", 1, 1.0, 2)], RELS)
    stubs = spark.createDataFrame([("unresolved:t", "i2")], "stub string, target string")
    assert [tuple(r) for r in calls.entity_card(e, rels, stubs, "one").collect()] == [("i1", None, None, None, None, None)]
    assert {tuple(r)[1:] for r in calls.entity_card(e, rels, stubs, "two").collect()} == {("i2", "i2", "CALLS", 1, False), ("x", "i2", "CALLS", 2, True)}
    assert calls.entity_card(e, rels, stubs, "none").count() == 0


def test_connections_and_views_of_small_tables(spark):
    rows = [("a", "b", "CALLS", None, 1.0, 9, "f", "g"), ("a", "c", "CALLS", None, 0.5, 2, "f", "g"), ("a", "d", "CALLS", None, None, 4, "f", "g"), ("a", "b", "CONTAINS", None, None, 4, "f", "g"), ("b", "a", "READS", None, 0.1, 4, "g", "f"), ("a", "z", "CALLS", None, None, 1, "f", None)]
    e = spark.createDataFrame(rows, RELS + ", source_file string, target_file string")
    names = spark.createDataFrame([("b", "bee"), ("c", "cee"), ("d", None)], "id string, name string")
    got = {(r.way, r.other, r.relation_type, r.n, r.max_confidence, tuple(r.via)) for r in calls.file_connections(e, names, "f").collect()}
    assert got == {("out", "g", "CALLS", 3, 1.0, ("cee", "bee")), ("in", "g", "READS", 1, 0.1, ("bee",))}
    assert calls.file_connections(e, names, "f", 0.2).where("way = 'in'").count() == 0
    d = spark.createDataFrame([("f", "g"), ("f", "g"), ("f", "h"), ("h", "f"), ("x", None)], "file string, target string")
    assert {(r.file, tuple(r.depends_on), tuple(r.required_by)) for r in calls.dependencies_view(d).collect()} == {("f", ("g", "h"), ("h",)), ("g", (), ("f",)), ("h", ("f",), ("f",))}
    old = spark.createDataFrame([("same", "1", "h"), ("more", "1", "h"), ("gone", "1", "h"), ("twice", "1", "h")], "file_path string, id string, hash string")
    new = spark.createDataFrame([("same", "1", "h"), ("more", "1", "h"), ("more", "2", None), ("new", "1", "h"), ("twice", "1", "h"), ("twice", "1", "h")], "file_path string, id string, hash string")
    assert {tuple(r) for r in calls.delta_view(old, new).collect()} == {("same", "unchanged", 1), ("more", "modified", 2), ("gone", "removed", 0), ("new", "added", 1), ("twice", "modified", 2)}


ENTITIES = "entity_id string, name string, entity_type string, file_path string, metadata_json string"


def test_edge_conditions_count_ends_that_satisfy_them(spark):
    e = spark.createDataFrame([("a", "Alpha", "CLASS", "a.py", '{"k": "v"}'), ("b", "Beta", "FUNCTION", "b.py", None), ("c", "Gamma", "CLASS", "c.py", "{}")], ENTITIES)
    rels = spark.createDataFrame([("a", "b", "calls", 1, 1.0, 1), ("a", "a", "CALLS", 1, 1.0, 1), ("b", "a", "INHERITS_FROM", 1, 1.0, 1), ("a", "gone", "CALLS", 1, 1.0, 1)], RELS)
    made = [
        rules.Rule("three_out", edges_all=(rules.Edge("CALLS", "outbound", 3),)), rules.Rule("own_twice", edges_all=(rules.Edge("CALLS", "either", 4),)),
        rules.Rule("to_function", edges_all=(rules.Edge("CALLS", "outbound", 1, types=("function",)),)), rules.Rule("known", edges_all=(rules.Edge("CALLS", "outbound", 3, types=("*",)),)),
        rules.Rule("alias", edges_any=(rules.Edge("INHERITS", "outbound", names=("^al",), metadata=(("k", "v"),)), rules.Edge("READS"))),
        rules.Rule("both", edges_all=(rules.Edge("CALLS", "inbound"),), edges_any=(rules.Edge("INHERITS", "outbound"),)),
    ]
    got = {r.entity_id: set(r.rule_ids) for r in rules.apply(e, made, rels).collect()}
    assert got == {"a": {"three_out", "own_twice", "to_function"}, "b": {"alias", "both"}, "c": set()}
    with pytest.raises(ValueError):
        rules.apply(e, made)


def test_conditions_on_bytes_text_and_gates(spark):
    schema = ENTITIES + ", raw_content string, start_byte long, end_byte long, content string, content_hash string, signature string"
    rows = [
        ("whole", "n", "T", "p", '{"k": "v"}', "é", 0, 2, "Some TEXT", "0a", "def f()"), ("gap", "n", "T", "p", "{}", "é", 0, 3, "", "fa", None), ("none", "n", "T", "p", None, None, 0, 3, None, None, None), ("odd", "n", "T", "p", "{}", "x", 5, 3, "x", "", ""),
    ]
    e = spark.createDataFrame(rows, schema)

    def got(**kw):
        return {r.entity_id for r in rules.apply(e, [rules.Rule("r", **kw)]).where("size(rule_ids) > 0").collect()}

    assert got(has_raw=True) == {"whole", "gap", "odd"} and got(has_raw=False) == {"none"}
    assert got(has_gap=True) == {"gap"} and got(has_gap=False) == {"whole"}
    assert got(start_from=1) == {"odd"} and got(end_to=2) == {"whole"} and got(hash_pattern="^.a|^$") == {"whole", "gap"}
    assert got(content=("text",)) == {"whole"} and got(gap_types=("t",)) == {"whole", "gap", "none", "odd"}
    assert got(when_all=(("k", "eq", "v"),)) == {"whole"} and got(when_any=(("k", "exists", None), ("z", "exists", None))) == {"whole"}
    assert got(regexes=(("signature", "DEF", True),)) == {"whole"} and got(regexes=(("signature", "DEF", False),)) == set() == got(regexes=(("name", "(", True),)) == got(regexes=(("elsewhere", ".*", True),))
    with pytest.raises(ValueError):
        rules.load('rules: [{rule_id: a, matchers: {ast_edges: [{edge: CALLS, min_count: 0}]}}]')
