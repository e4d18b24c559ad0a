"""Operators without an SQL form, on small hand-made inputs."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import names
from sparkloom.operators import filters, graph, resolution, rules
from sparkloom.plans.catalog import Catalog
from sparkloom.sources import html, text
from sparkloom.streaming import changes


def test_catalog_generations(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    assert cat.manifest() == {} and cat.table("files", "a int").count() == 0
    one = spark.createDataFrame([(i,) for i in range(9)], "a int")
    assert cat.commit({"files": one, "runs": one}, {"files": "a"}) == 1
    held = cat.table("files")
    assert cat.commit({"files": one.where("a < 3")}) == 2
    assert held.count() == 9 and cat.table("files").count() == 3 and cat.table("runs").count() == 9
    assert cat.table("files", generation=1).count() == 9
    assert cat.collect_garbage() == ["files/gen=1"] and cat.table("files").count() == 3
    with pytest.raises(KeyError):
        cat.table("none")


def test_trace_path_is_the_queue_search(spark):
    rng = random.Random(5)
    kinds = [("CALLS", 0), ("IMPORTS", 2), ("USES", 5)]
    nodes = [f"n{i:02d}" for i in range(14)]
    edges = [(a, b, *rng.choice(kinds)) for a in nodes for b in rng.sample(nodes, 2) if a != b]
    best = {}
    for u, v, r, p in edges:
        best[u, v] = min(best.get((u, v), (9, "")), (p, r))
    frame = spark.createDataFrame(edges, "u string, v string, relation_type string, priority int")
    for target in ("n05", "n09", "n00"):
        seen, queue = {"n00": None}, deque(["n00"])
        while queue:
            at = queue.popleft()
            for _, v in sorted((best[u, v][0], v) for u, v in best if u == at):
                if v not in seen:
                    seen[v] = at
                    queue.append(v)
        want, at = [], target
        while at is not None and at in seen:
            want.append(at)
            at = seen[at]
        got = [r.id for r in graph.trace_path(frame, "n00", target, 20).orderBy("hop").collect()]
        assert got == want[::-1]
    assert graph.trace_path(frame, "n00", "nowhere", 20).count() == 0


def test_closure_of_a_cycle_and_reach(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "u string, v string")
    assert {tuple(r) for r in graph.closure(e).collect()} == {(x, y) for x in "abc" for y in "abcd"}
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(60)], "u string, v string")
    assert graph.closure(chain).count() == 61 * 60 // 2
    assert {tuple(r) for r in graph.reach(e, spark.createDataFrame([("a",)], "id string"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_cycles_of_any_length_in_least_rotation(spark):
    rows = [("b", "a", "CALLS"), ("a", "b", "CALLS"), ("c", "a", "CALLS"), ("b", "c", "CALLS"), ("x", "x", "CALLS"), ("x", "x", "IMPORTS"), ("p", "q", "IMPORTS"), ("q", "r", "IMPORTS"), ("r", "s", "IMPORTS"), ("s", "p", "IMPORTS"), ("s", "t", "IMPORTS"), ("t", "u", "IMPORTS"), ("a", "p", "IMPORTS")]
    e = spark.createDataFrame(rows + rows[:3], "u string, v string, relation_type string")
    got = sorted((r.relation_type, "".join(r.nodes)) for r in graph.cycles(e).collect())
    assert got == [("CALLS", "ab"), ("CALLS", "abc"), ("CALLS", "x"), ("IMPORTS", "pqrs")]
    assert graph.cycles(e, longest=3).where("relation_type = 'IMPORTS'").count() == 0 and graph.cycles(e.limit(0)).count() == 0


def test_chains_drop_cycles_open_ends_and_the_deepest(spark):
    def stub(n):
        return f"unresolved:{n}"

    links = [(stub("a"), stub("b")), (stub("b"), "real"), (stub("open"), stub("nothing")), *[(stub(f"d{i}"), stub(f"d{i + 1}") if i < 9 else "deep") for i in range(10)]]
    for n in range(2, 8):
        links += [(stub(f"r{n}.{i}"), stub(f"r{n}.{(i + 1) % n}")) for i in range(n)]
    got = {r.u: r.v for r in resolution.compress(spark.createDataFrame(links, "u string, v string")).collect()}
    assert got == {stub("a"): "real", stub("b"): "real"} | {stub(f"d{i}"): "deep" for i in range(1, 10)}


def test_dotted_names_and_missing_hashes(spark):
    from sparkloom.operators import history

    rows = [("e1", "run", "FUNCTION", "src/app/core.py"), ("e2", "run", "FUNCTION", "src/lib/core.py"), ("e3", "app.core.run", "FUNCTION", "x.py"), ("unresolved:q", "run", "FUNCTION", "src/app/core.py")]
    e = spark.createDataFrame(rows, "entity_id string, name string, entity_type string, file_path string")
    assert [r.entity_id for r in resolution.by_name(e, "app.core.run").collect()] == ["e1"]
    assert {r.entity_id for r in resolution.by_name(e, "run").collect()} == {"e1", "e2"}
    old, new = [spark.createDataFrame(x, "id string, hash string") for x in ([("a", None), ("b", "1"), ("c", "2"), ("d", None)], [("a", None), ("b", None), ("c", "2"), ("n", None)])]
    assert {r.id: r.change for r in history.change_scan(old, new).collect()} == {"a": "unchanged", "b": "modified", "c": "unchanged", "d": "deleted", "n": "added"}


def test_greedy_merging_with_a_heap_is_the_plain_search():
    import random

    from sparkloom.operators import communities

    def plain(edges, total):
        near = {}
        for u, v, w in edges:
            near.setdefault(u, {})[v] = near.setdefault(v, {})[u] = w
        mass, of = {x: sum(ws.values()) for x, ws in near.items()}, {x: x for x in near}
        while gains := [g for a, ws in near.items() for b in ws if a < b and (g := (mass[a] * mass[b] / (2 * total * total) - ws[b] / total, a, b))[0] < -1e-12]:
            _, a, b = min(gains)
            for c, w in near.pop(b).items():
                del near[c][b]
                if c != a:
                    near[a][c] = near[c][a] = near[a].get(c, 0.0) + w
            mass[a] += mass.pop(b)
            of = {x: a if c == b else c for x, c in of.items()}
        return of

    rng = random.Random(8)
    for _ in range(20):
        pairs = {tuple(sorted(rng.sample("abcdefghijkl", 2))) for _ in range(rng.randint(1, 25))}
        edges = [(u, v, float(rng.choice([1, 2, 3, 6]))) for u, v in sorted(pairs)]
        total = sum(w for *_, w in edges)
        assert communities.merge_greedily(edges, total) == plain(edges, total)
    cliques = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0", 3.0)]
    assert len(set(communities.split_large(cliques, 1000.0, 2).values())) > 1


def test_a_merge_costs_the_neighbours_of_one_side(monkeypatch):
    import heapq

    from sparkloom.operators import communities

    # Leaves join the centre one by one; each used to push all pairs that the centre has left.
    n, calls = 400, Counter()
    edges = [("a", f"b{i:03}", 1.0 + i / n) for i in range(n)]
    for name in ("heappush", "heapreplace"):
        monkeypatch.setattr(heapq, name, lambda *x, f=getattr(heapq, name): (calls.update(["n"]), f(*x))[1])
    found = communities.merge_greedily(edges, 1e6)
    assert set(found) == {"a", *(x for e in edges for x in e[:2])} and set(found.values()) == {"a"}
    assert calls["n"] < 10 * len(edges)


def test_a_merge_enters_only_pairs_whose_weight_it_changed_and_keeps_few_objects(monkeypatch):
    import heapq
    import tracemalloc

    from sparkloom.operators import communities

    # Orders of a few parts, in a graph of 60 times this weight, so that one community takes in nearly all.
    rng, calls = random.Random(5), Counter()
    pairs = {(f"o{o:05}", f"p{p:04}") for o in range(6000) for p in rng.sample(range(800), 4)}
    edges = [(o, p, float(rng.choice([500_000, 950_000, 1_000_000]))) for o, p in sorted(pairs)]
    total = 60 * sum(w for *_, w in edges)
    for name in ("heappush", "heapreplace"):
        monkeypatch.setattr(heapq, name, lambda *x, f=getattr(heapq, name): (calls.update(["n"]), f(*x))[1])
    found = communities.merge_greedily(edges, total)
    assert len(found) == 6800 and calls["n"] < 2 * len(edges)
    tracemalloc.start()
    communities.merge_greedily(edges, total)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * len(edges)


def test_greedy_merging_around_nodes_with_many_neighbours():
    from sparkloom.operators import communities

    # All leaves weigh the same: the smallest names join the two centres first, until none gains.
    rng = random.Random(2)
    edges = [(c, f"n{i:03}", 1.0) for i in range(120) for c in rng.sample(["a", "b"], rng.randint(1, 2))]
    total, near = sum(w for *_, w in edges), Counter(x for e in edges for x in e[:2])
    found = communities.merge_greedily(edges, total)
    both = {x for x in near if x > "c" and near[x] == 2}
    assert set(found.values()) == {"a", "b"} and found["a"] == "a" and found["b"] == "b"
    assert all(found[v] == u for u, v, _ in edges if v not in both)


def test_components_by_contraction(spark):
    from sparkloom.operators import communities

    chain = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100 + (i * 7 + 3) % 50) for i in range(50)] + [(200, 205), (203, 205), (203, 204)]
    edges = spark.createDataFrame([(min(e), max(e)) for e in chain if e[0] != e[1]], "u long, v long").distinct()
    got = {r.n: r.component for r in communities.components(edges).collect()}
    want = {r.id: r.component for r in graph.connected(edges).collect()}
    assert got == {n: c for n, c in want.items() if n != c} and len(got) > 60


def test_search_scores(spark):
    rows = [("get_entity", "FUNCTION"), ("get_entity_[800748]", "FUNCTION"), ("get_entity_page", "FUNCTION"), ("the_get_entity_fn", "FUNCTION"), ("get_entity", "COMMENT_BLOCK"), ("get_entity", "EXTERNAL_SYMBOL"), ("get_entity", "MODULE")]
    e = spark.createDataFrame([(n, k, f"id{i}", "src/x.py", i, False, None, None) for i, (n, k) in enumerate(rows)], "name string, entity_type string, entity_id string, file_path string, start_line int, is_exported boolean, fqn string, metadata_json string")
    s = {r.entity_id: r.score for r in filters.search(e, "get_entity").collect()}
    assert s["id0"] == s["id1"] and s["id0"] - s["id2"] == 40 and s["id2"] - s["id3"] == 30
    assert s["id4"] < s["id5"] < s["id6"] < s["id0"]
    assert filters.search(e, "(a+").count() == 0


def test_loose_truth_of_metadata(spark):
    cases = {'{"bsg.noise":true}': True, '{"bsg.noise":false}': False, '{"bsg.noise":0}': False, '{"bsg.noise":1}': True, '{"bsg.noise":""}': False, '{"bsg.noise":[]}': False, '{"other":true}': False, "not json bsg.noise": False, None: False, '{"bsg.quarantined":"yes"}': True, '{"bsg.noise":"false"}': True, '{"bsg.noise":"0"}': True, '{"bsg.noise":"[]"}': True, '{"bsg.noise":{}}': False, '{"bsg.noise":{"a":0}}': True, '{"bsg.noise":[0]}': True, '{"bsg.noise":0.0}': False, '{"bsg.noise":-2.5}': True, '{"bsg.noise":null}': False}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "metadata_json string, want boolean")
    assert df.where(filters.quarantined() != F.col("want")).count() == 0


def test_metadata_operators_on_missing_values(spark):
    df = spark.createDataFrame([(None,), ("abc",)], "v string")
    want = {("exists", None): (False, True), ("eq", "abc"): (False, True), ("neq", "abc"): (True, False), ("in", ("abc",)): (False, True), ("not_in", ("abc",)): (True, False), ("length_gt", 2): (False, True), ("contains_all", ("a", "z")): (False, False), ("nonsense", 1): (False, False)}
    for (op, arg), answer in want.items():
        got = {r.v: r.x for r in df.select("v", filters.metadata_predicate(F.col("v"), op, arg).alias("x")).collect()}
        assert (got[None], got["abc"]) == answer, op


def test_rules_see_earlier_tags_and_conflicts(spark):
    e = spark.createDataFrame([("e1", "CLASS", "app/a.py", "Big", '{"k":"v"}'), ("e2", "FUNCTION", "lib/b.ts", "small", None)], "entity_id string, entity_type string, file_path string, name string, metadata_json string")
    made = [rules.Rule("a", 1, ("CLASS",), metadata=(("k", "eq", "v"),), add_tags=("t",), put={"x": "1"}), rules.Rule("b", 2, tags_any=("t",), put={"x": "2"}), rules.Rule("c", 0, files=("lib/**",))]
    got = {r.entity_id: r for r in rules.apply(e, made).collect()}
    assert got["e1"].rule_ids == ["a", "b"] and got["e1"].put == {"x": "2"} and got["e1"].tags == ["t"]
    assert got["e2"].rule_ids == ["c"] and got["e2"].put == {}
    assert rules.conflicts(made) == [("a", "b", "x")]


def test_names_and_paths(spark):
    row = spark.range(1).select(names.normal_path(F.lit("a/./b/../../c//d")).alias("p"), names.name_tokens(F.lit("getHTTPUser_name-x")).alias("t"), names.module_of(F.lit("pkg/sub/__init__.py")).alias("m"), names.module_of(F.lit("x.md")).alias("n"), names.title(F.lit("fooBAR baz_qux")).alias("i")).first()
    assert row.p == "c/d" and row.t == ["get", "httpuser", "name", "x"] and row.m == "pkg.sub" and row.n is None and row.i == "Foobar Baz Qux"


def test_sources(spark):
    pages = spark.createDataFrame([(1, '<P class="x"><a href="https://x.org">a</a><a href="/y">b</a></P>')], "page_id long, html string")
    assert [r.tag for r in html.elements(pages).orderBy("ord").collect()] == ["p", "a", "a"]
    assert {(r.href, r.kind) for r in html.links(pages).collect()} == {("https://x.org", "LINKS_TO"), ("/y", "LOCAL")}
    code = spark.createDataFrame([(1, "x\n  def run(a):\nclass Big:\n")], "k long, t string")
    assert {(r.line_no, r.entity_type, r.name) for r in text.text_definitions(code, "k", "t").collect()} == {(2, "FUNCTION", "run"), (3, "CLASS", "Big")}


def test_capped_pairs(spark):
    p = spark.createDataFrame([("g", "a", b, w) for b, w in (("b", 3), ("c", 2), ("d", 1))] + [("g", "b", "c", 1)], "g string, a string, b string, w int")
    assert {(r.a, r.b) for r in resolution.capped_pairs(p, ["g"], 2).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_streaming_flushes_match_batch(spark, tmp_path):
    rows = [("r", f"2024-01-01 00:00:{s:02d}", f"f{s % 3}", 10) for s in (0, 1, 2, 10, 11, 40)] + [("r", "2024-01-01 00:10:00", "end", 1)]
    df = spark.createDataFrame(rows, "repo string, t string, path string, size int").select("repo", F.to_timestamp("t").alias("ts"), "path", "size")
    df.write.parquet(str(tmp_path / "in"))
    batch = {(str(r.first_at), r.n, tuple(r.paths)) for r in changes.flushes(df).collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = changes.flushes(stream.where(changes.relevant())).writeStream.outputMode("append").format("memory").queryName("flushes").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(str(r.first_at), r.n, tuple(r.paths)) for r in spark.table("flushes").collect()}
    assert {n for _, n, _ in batch} == {3, 2, 1} and got == {b for b in batch if b[2] != ("end",)}


def test_communities_of_two_cliques(spark):
    from sparkloom.operators import communities

    def clique(names):
        return [(a, b, "CALLS", None) for a in names for b in names if a < b]

    rels = clique(["a1", "a2", "a3", "a4"]) + clique(["b1", "b2", "b3", "b4"]) + [("a1", "b1", "READS", 0.5), ("a2", "x", "IMPORTS", 1.0), ("y1", "y2", "READS", 1.0), ("a1", "a1", "CALLS", 1.0)]
    frame = spark.createDataFrame(rels, "source_id string, target_id string, relation_type string, confidence float")
    got = {r.id: r.community for r in communities.detect(frame, smallest=3).collect()}
    assert len({got[f"a{i}"] for i in range(1, 5)}) == 1 and len({got[f"b{i}"] for i in range(1, 5)}) == 1 and got["a1"] != got["b1"]
    assert got["x"] == got["a2"] and set(got) == {f"{k}{i}" for k in "ab" for i in range(1, 5)} | {"x", "y1", "y2"}
    again = {r.id: r.community for r in communities.detect(frame, share=0.1).collect()}
    assert set(again) == set(got) and all(again[x] == again["a1"] or again[x] != got["b1"] for x in ("a1", "a2"))
    profile = {r.community: (r.inner, r.outer) for r in communities.edge_profile(frame, spark.createDataFrame(list(got.items()), "id string, community string")).collect()}
    assert profile[got["b1"]] == (6, 1)


def plain_communities(rels, entities, smallest=3, share=0.25):
    """The whole method on one machine; of equal choices the smallest names."""
    from sparkloom.operators import communities

    file = {i: f for i, f, kind, meta in entities if not i.startswith("unresolved:") and kind != "EXTERNAL_SYMBOL" and "true" not in (meta or "")}
    near = {}
    for u, v, kind, conf in rels:
        w = communities.WEIGHTS[kind] * (1 if conf is None else conf)
        if u != v and w > 0 and u in file and v in file:
            near.setdefault(u, Counter())[v] += w
            near.setdefault(v, Counter())[u] += w
    deg = sorted(map(len, near.values()))
    hub = {x for x in near if len(near[x]) > deg[min(len(deg) - 1, int(0.99 * len(deg)))]}
    rest = sorted(set(near) - hub)
    most = max(1, int(share * len(rest)))

    def split(nodes, depth):
        if depth and (len(nodes) <= most or depth > 2):
            return [nodes]
        edges = [(u, v, w) for u in nodes for v, w in near[u].items() if v in nodes and u < v]
        found = communities.merge_greedily(edges, sum(e[2] for e in edges)) if edges else {}
        parts = {}
        for x in nodes:
            parts.setdefault(found.get(x, x), set()).add(x)
        if depth and len(parts) == 1:
            return [nodes]
        return [y for x in sorted(parts.values(), key=lambda x: (-len(x), min(x))) for y in split(x, depth + 1)]

    parts = split(set(rest), 0)
    small = sorted((x for x in parts if len(x) < smallest), key=len)
    sets, alone = [x for x in parts if len(x) >= smallest], []
    names, of = [min(x) for x in sets], {n: i for i, x in enumerate(sets) for n in x}
    for x in small:
        pull = Counter()
        for n in x:
            for m, w in near[n].items():
                if m in of:
                    pull[of[m]] += w
        if pull:
            of |= dict.fromkeys(x, max(pull, key=lambda i: (round(pull[i], 6), -i)))
        else:
            alone.append(x)
    for x in alone:
        of |= dict.fromkeys(x, len(names))
        names.append(min(x))
    for x in sorted(set(file) - set(near)):
        for key in (lambda f: f, lambda f: f.rsplit("/", 1)[0]):
            votes = Counter(of[y] for y in file if y in of and file[x] and file[y] and key(file[y]) == key(file[x]))
            if votes:
                of[x] = max(votes, key=lambda i: (votes[i], -i))
                break
    for x in sorted(hub):
        if best := [(-round(w, 6), y) for y, w in near[x].items() if y in of]:
            of[x] = of[min(best)[1]]
    return {x: names[i] for x, i in of.items()}, hub


@pytest.mark.parametrize("seed", [1, 2])
def test_communities_are_those_of_the_whole_method(spark, seed):
    from sparkloom.operators import communities

    rng = random.Random(seed)
    ids = [f"{k}{i:03}" for k in "mx" for i in range(110)]
    group = {x: rng.randrange(12) for x in ids}
    rels = [(*rng.sample([y for y in ids if group[y] == g], 2), rng.choice(["CALLS", "READS", "IMPORTS", "CONTAINS"]), rng.choice([None, 0.5, 0.25, 0.0])) for _ in range(300) for g in [rng.randrange(12)]]
    rels += [(*rng.sample(ids, 2), "READS", 0.5) for _ in range(25)] + [("h2", x, "READS", 0.25) for x in rng.sample(ids, 60)] + [("h1", x, "CALLS", 0.25) for x in rng.sample(ids, 50)] + [("h3", "h1", "CALLS", None), ("h1", "h2", "CALLS", None)]
    rels += [("h3", f"z{i:02}", "READS", 0.25) for i in range(40)] + [("unresolved:q", x, "CALLS", None) for x in ids[:90]] + [("bad", x, "CALLS", None) for x in ids[:80]] + [("ext", x, "CALLS", None) for x in ids[:80]]
    rels += [("p1", "p2", "READS", 0.5), ("p1", ids[0], "READS", 0.25), ("s1", "s2", "CALLS", None)]
    files = [f"d{g % 5}/f{g}.py" for g in range(12)]
    entities = [(x, files[group[x]], "CLASS", None) for x in ids] + [(x, "e/p.py", "CLASS", None) for x in ("p1", "p2", "s1", "s2", "h1", "h2", "h3")] + [(f"z{i:02}", "z.py", "CLASS", None) for i in range(40)]
    entities += [(f"i{i:03}", rng.choice([*files, *(f"d{g}/new{n}.py" for g in range(5) for n in range(4)), "alone/a.py", "z.py", "", None]), "CLASS", None) for i in range(160)]
    entities += [("bad", files[0], "CLASS", '{"bsg.noise":true}'), ("ext", files[0], "EXTERNAL_SYMBOL", None), ("unresolved:q", files[0], "CLASS", None)]
    frame = spark.createDataFrame(rels, "source_id string, target_id string, relation_type string, confidence float")
    e = spark.createDataFrame(entities, "id string, file_path string, entity_type string, metadata_json string")
    want, hub = plain_communities(rels, entities)
    assert hub >= {"h1", "h2"} and {"i", "h", "z"} <= {x[0] for x in want} and want["s1"] == want["s2"] == "s1" and want["p1"] == want["p2"] != "p1"
    rows = communities.detect(frame, entities=e).collect()
    assert {r.id: r.community for r in rows} == want and len(rows) == len(want)


def test_communities_of_odd_inputs(spark):
    from sparkloom.operators import communities

    edges, kinds = "source_id string, target_id string, relation_type string, confidence float", "id string, file_path string, entity_type string, metadata_json string"
    e = spark.createDataFrame([("a", "x/f", "CLASS", None), ("b", "x/f", "CLASS", None), ("c", None, None, None)], kinds)
    assert communities.detect(spark.createDataFrame([], edges), entities=e).collect() == []
    one = spark.createDataFrame([("a", "c", "CALLS", None), ("a", "c", "CALLS", 0.0), (None, "c", "CALLS", 1.0), ("a", "gone", "CALLS", 1.0), ("a", "b", "OTHER", 1.0)], edges)
    assert sorted(map(tuple, communities.detect(one, entities=e).collect())) == [("a", "a"), ("b", "a"), ("c", "a")]
    star = spark.createDataFrame([("h", f"l{i:03}", "CALLS", None) for i in range(150)], edges)
    got = dict(map(tuple, communities.detect(star).collect()))
    assert len(got) == 151 and got["h"] == "l000" and all(got[x] == x for x in got if x != "h")


def test_term_labels(spark):
    from sparkloom.operators import communities

    rows = [("c1", "loadOrder"), ("c1", "saveOrder"), ("c2", "loadUser"), ("c2", "saveUser")]
    got = {r.community: r.label for r in communities.term_labels(spark.createDataFrame(rows, "community string, name string"), 1).collect()}
    assert got == {"c1": "order", "c2": "user"}


def test_tags_and_implied_edges(spark):
    from sparkloom.operators import semantic

    e = spark.createDataFrame([("1", "OrderController", "CLASS", "src/a.py"), ("2", "checkToken", "FUNCTION", "src/b.py"), ("3", "plain", "FUNCTION", "src/c.py")], "id string, name string, entity_type string, file_path string")
    tags = semantic.tag(e, {"api": {"controller", "route"}, "auth": {"token"}}, {"api": {"CLASS"}})
    assert {r.id: r.tags for r in tags.collect()} == {"1": ["api"], "2": ["auth"], "3": []}
    rels = spark.createDataFrame([("1", "2", "CALLS"), ("3", "1", "CALLS"), ("3", "1", "DEPENDS_ON_API"), ("2", "1", "READS")], "source_id string, target_id string, relation_type string")
    got = {tuple(r) for r in semantic.implied_edges(rels, tags, [(None, "api", "DEPENDS_ON_API"), ("api", "auth", "WRAPPED_BY")]).collect()}
    assert got == {("1", "2", "WRAPPED_BY")}


def test_verdicts_and_tested_by(spark):
    from sparkloom.operators import semantic

    h = [("new", 1, 0, 0, 1.0), *[("dead", r, 0, 0, 1.0) for r in range(3)], ("wide", 1, 50, 1, 1.0), ("slow", 1, 5, 5, 6e6), ("good", 1, 5, 4, 1.0), ("dup", 1, 5, 1, 1.0)]
    got = {r.rule_id: r.verdict for r in semantic.verdicts(spark.createDataFrame(h, "rule_id string, run int, n long, unique_n long, avg_ns double"), 100).collect()}
    assert got == {"new": "regenerate", "dead": "disable", "wide": "regenerate", "slow": "shadow", "good": "promote", "dup": "shadow"}
    t = spark.createDataFrame([("t1", "run")], "test string, base string")
    o = spark.createDataFrame([("m1", "run"), ("m2", "run"), ("m3", "go")], "target string, base string")
    d = spark.createDataFrame([("t1", "m2")], "test string, target string")
    assert {(r.target, r.confidence) for r in semantic.tested_by(t, o, d).collect()} == {("m1", 0.65), ("m2", 0.85)}


def test_tested_by_never_pairs_all_tests_and_targets_of_a_base(spark):
    from sparkloom.operators import semantic

    names = [f"m{i:04}" for i in range(400)]
    tests = [("m0001", "a"), ("t", "a"), ("t", "b"), ("u", "c"), ("v", None), *[(f"x{i}", "a") for i in range(200)]]
    targets = [(x, "ab"[i % 2]) for i, x in enumerate(names)] + [(x, "a") for x in names[:8] * 2] + [(None, "a"), ("w", None)]
    direct = [("t", "m0000"), ("t", "m0000"), ("t", "m0399"), ("m0001", "m0003")]
    want = set()
    for t in {t for t, _ in tests}:
        bases = {b for x, b in tests if x == t and b}
        near = sorted({m for m, b in targets if b in bases and m and m != t})[:50]
        want |= {(t, m, 0.85 if (t, m) in direct else 0.65) for m in near}
    frames = [spark.createDataFrame(rows, f"{a} string, {b} string") for rows, a, b in ((tests, "test", "base"), (targets, "target", "base"), (direct, "test", "target"))]
    found = semantic.tested_by(*frames)
    got = found.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want

    def most_rows(node):
        below = [node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(most_rows, below)])

    rows = most_rows(found._jdf.queryExecution().executedPlan())
    assert 0 < rows <= len(tests) * 51


def test_file_sources(spark, tmp_path):
    from sparkloom.sources import files

    (tmp_path / "a" / "node_modules").mkdir(parents=True)
    (tmp_path / "a" / "x.py").write_text("pass")
    (tmp_path / "a" / "node_modules" / "y.js").write_text("1")
    (tmp_path / "run").write_text("#!/usr/bin/env python\n")
    t = files.tree(spark, str(tmp_path))
    got = {r.path: (r.lang, r.skip) for r in t.select("path", files.language(F.col("path"), F.col("content").cast("string")).alias("lang"), files.ignored(F.col("path")).alias("skip")).collect()}
    assert got == {"a/x.py": ("python", False), "a/node_modules/y.js": ("javascript", True), "run": ("python", False)}
    req = spark.createDataFrame([("r.txt", "Foo_Bar==1.2 # x\n# c\n-r other\nbaz>=3,<4\nplain\n")], "path string, text string")
    assert {(r.name, r.version) for r in files.requirements(req).collect()} == {("foo-bar", "1.2"), ("baz", "3"), ("plain", None)}
    pkg = spark.createDataFrame([("p.json", '{"dependencies":{"a":"1"},"devDependencies":{"b":"2","a":"0"}}'), ("q.json", '{"dependencies":{"c":"3"}}')], "path string, text string")
    assert {(r.path, r.name) for r in files.package_json(pkg).collect()} == {("p.json", "a"), ("p.json", "b"), ("q.json", "c")}
    md = spark.createDataFrame([(1, "# Top\n- item [x](http://y)\n```py\n")], "k int, t string")
    assert {(r.line_no, r.kind, r.value) for r in files.markdown(md, "k", "t").collect()} == {(1, "header", "Top"), (2, "item", "item [x](http://y)"), (2, "link", "http://y"), (3, "code", "py")}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    got = {r.id: r.component for r in graph.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
