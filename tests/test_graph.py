"""Operators on small graphs, against the values that they must have, and against plain Python on random ones."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from sourceweave import enrich
from sourceweave.operators import analytics, ask, cluster, graph, lookup, traverse
from sourceweave.server import Server

NODE = "seq long, id string, label string, file_type string, source_file string, source_location string, community int, norm_label string"
EDGE = "source string, target string, relation string, confidence string, seq long"


def make(spark, nodes, edges):
    n = [(i, x[0], x[1], x[3] if len(x) > 3 else "code", x[2], "L1", x[4] if len(x) > 4 else None, x[1].lower()) for i, x in enumerate(nodes)]
    e = [(s, t, r, c, i) for i, (s, t, r, c) in enumerate((x + ("INFERRED",))[:4] for x in edges)]
    return spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE)


@pytest.fixture(scope="module")
def chain(spark):
    return make(spark, [("x_a", "a()", "x.go"), ("x_b", "b()", "x.go"), ("y_c", "c()", "y.go")], [("x_a", "x_b", "calls"), ("x_b", "y_c", "calls")])


def test_chain(chain):
    n, e = chain
    assert [r.id for r in lookup.search(n, "^A").collect()] == ["x_a"]
    assert [(r.dir, r.label) for r in lookup.explain(n, e, "x_b").collect()] == [("<-", "a()"), ("->", "c()")]
    assert traverse.shortest_path(e, "x_a", "y_c") == ["x_a", "x_b", "y_c"]
    assert [h["forward"] for h in traverse.path_edges(e, "y_c", "x_a")] == [False, False]
    with pytest.raises(traverse.SameNodeError):
        traverse.path_edges(e, "x_a", "x_a")
    with pytest.raises(traverse.MaxHopsError) as err:
        traverse.path_edges(e, "x_a", "y_c", 1)
    assert err.value.hops == 2
    assert lookup.resolve_symbol(n, "b()").first().id == "x_b" and lookup.resolve_symbol(n, "x_").first() is None


def test_affected(spark):
    n, e = make(spark, [("add", "add()", "util.go"), ("compute", "compute()", "math.go"), ("run", "run()", "main.go"), ("lonely", "lonely()", "other.go")], [("compute", "add", "calls"), ("run", "compute", "calls")])
    got = lambda **k: [(r.change, r.id) for r in traverse.affected(n, e, ["util.go"], **k).collect()]
    assert got() == [("changed", "add"), ("impacted", "run"), ("impacted", "compute")]
    assert got(depth=1) == [("changed", "add"), ("impacted", "compute")]
    assert got(relations=["imports"]) == [("changed", "add")]


def test_diff_and_merge(spark):
    old = make(spark, [("add", "add", ""), ("compute", "compute", "")], [("compute", "add", "calls")])
    new = make(spark, [("sub", "sub", ""), ("compute", "compute", "")], [("compute", "sub", "calls")])
    assert lookup.diff_summary(lookup.diff_nodes(old[0], new[0]), lookup.diff_edges(old[1], new[1])) == "1 new node, 1 new edge, 1 node removed, 1 edge removed"
    assert lookup.diff_summary(lookup.diff_nodes(old[0], old[0]), lookup.diff_edges(old[1], old[1])) == "no changes"
    assert lookup.merge(old[0], new[0], ["id"]).count() == 3 and lookup.merge(old[1], new[1], lookup.KEY).count() == 2


def test_validate(spark):
    n, e = make(spark, [("a", "a", ""), ("a", "a", ""), ("", "", "")], [("a", "ghost", "calls")])
    assert [r.issue for r in lookup.validate(n, e).collect()] == ["duplicate node id: a (2 occurrences)", "edge a -> ghost [calls]: target missing", "node has empty id"]


def test_analytics(spark):
    nodes = [("fa", "a.go", "a.go"), ("fb", "b.go", "b.go"), *[(f"a{i}", f"A{i}()", "a.go", "code", 0) for i in (1, 2, 3)], *[(f"b{i}", f"B{i}()", "b.go", "code", 1) for i in (1, 2, 3)]]
    edges = [("fa", f"a{i}", "contains", "EXTRACTED") for i in (1, 2, 3)] + [("fb", f"b{i}", "contains", "EXTRACTED") for i in (1, 2, 3)] + [("a1", "a2", "calls"), ("a1", "a3", "calls"), ("b1", "b2", "calls"), ("a1", "b1", "calls"), ("fa", "fb", "imports_from", "EXTRACTED"), ("fb", "fa", "imports_from", "EXTRACTED")]
    n, e = make(spark, nodes, edges)
    gods = [r.id for r in analytics.god_nodes(n, e).collect()]
    assert gods[0] == "a1" and "fa" not in gods
    odd = analytics.surprising(n, e).collect()
    assert [(r.source, r.target, r.note) for r in odd] == [("a1", "b1", "bridges separate communities")]
    assert [(r.size, r.files) for r in traverse.import_cycles(n, e).collect()] == [(2, "b.go -> a.go")]


def triangles(spark):
    pairs = [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("b1", "b2"), ("b2", "b3"), ("b1", "b3"), ("a1", "b1")]
    return make(spark, [(x, x, "f") for x in ("a1", "a2", "a3", "b1", "b2", "b3")], [(*p, "calls") for p in pairs])


def test_a_path_of_many_hops(spark):
    ids = [f"n{k:03d}" for k in range(72)]
    e = spark.createDataFrame([(a, b, "calls", "EXTRACTED") if k % 2 else (b, a, "calls", "EXTRACTED") for k, (a, b) in enumerate(zip(ids, ids[1:]))], "source string, target string, relation string, confidence string")
    assert traverse.shortest_path(e, ids[0], ids[71]) == ids


def test_communities(spark, monkeypatch):
    n, e = triangles(spark)
    want = {0: {"a1", "a2", "a3"}, 1: {"b1", "b2", "b3"}}

    def groups(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.community, set()).add(r.id)
        return out

    assert groups(cluster.cluster(n, e)) == want
    co = spark.createDataFrame([(0, "a1"), (0, "a2"), (0, "a3"), (1, "b2"), (2, "b1"), (3, "a2"), (3, "b2")], "community int, id string")
    assert {r.community: r.cohesion for r in analytics.cohesion(e, co).collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0}
    spread = groups(cluster.louvain_rounds(n.select("id"), cluster.simple_edges(e)))
    pairs = cluster.simple_edges(e)
    local = cluster.louvain_local([r.id for r in n.select("id").collect()], [(r.u, r.v) for r in pairs.collect()])
    assert local == {r.id: r.community for r in cluster.louvain_rounds(n.select("id"), pairs).collect()}
    assert sorted(map(sorted, spread.values())) == [["a1", "a2", "a3"], ["b1", "b2", "b3"]]
    old = spark.createDataFrame([(0, "a1"), (0, "a2"), (0, "a3"), (1, "b1"), (1, "b2")], "community int, id string")
    new = spark.createDataFrame([(5, "a1"), (5, "a2"), (9, "b1"), (9, "b2"), (9, "a3"), (7, "z")], "community int, id string")
    assert groups(cluster.remap(old, new)) == {0: {"a1", "a2"}, 1: {"b1", "b2", "a3"}, 2: {"z"}}


def test_communities_of_many_nodes(spark, monkeypatch):
    """Over whole numbers, in Spark and in this process, the partition is that of plain Python; no round joins tables."""
    rng = random.Random(5)
    ids = [f"{'né'[k % 2]}{k}" for k in range(60)] + ["alone"]
    pairs = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(700)) if a // 20 == b // 20 or rng.random() < 0.05]
    n, e = make(spark, [(i, i, "f") for i in ids], [*((ids[a], ids[b], "calls") for a, b in pairs), ("n0", "unknown", "calls"), ("unknown", "other", "calls"), ("n0", "n0", "calls")])
    want = {r.id: r.community for r in cluster.cluster(n, e).collect()}
    monkeypatch.setattr(cluster, "LOCAL_EDGES", 0)
    monkeypatch.setattr(cluster, "louvain_rounds", lambda *_: pytest.fail("rounds of joins"))
    assert len(set(want.values())) > 3
    for held in (0, 10**6):
        monkeypatch.setattr(cluster.places, "HELD", held)
        found = cluster.cluster(n, e)
        assert found.dtypes == [("community", "int"), ("id", "string")] and {r.id: r.community for r in found.collect()} == want and found.count() == 61


def test_paths_on_random_graphs(spark):
    rng = random.Random(3)
    for _ in range(3):
        ids = [f"n{i}" for i in range(14)]
        pairs = {(rng.choice(ids), rng.choice(ids)) for _ in range(20)}
        _, e = make(spark, [(i, i, "f") for i in ids], [(a, b, "calls") for a, b in pairs])
        adj = {i: sorted({b for a, b in pairs if a == i} | {a for a, b in pairs if b == i}) for i in ids}
        best, front = {"n0": ["n0"]}, ["n0"]
        while front:
            step = {}
            for u in front:
                for v in adj[u]:
                    if v not in best:
                        step[v] = min(step.get(v, best[u] + [v]), best[u] + [v])
            best |= step
            front = list(step)
        for t in ids[1::4]:
            assert traverse.shortest_path(e, "n0", t) == best.get(t, [])


def test_paths_write_what_they_reach(spark, monkeypatch):
    """Links that the search does not pass are not written; with frontiers too wide for every worker the path is the same."""
    pairs = [("a", "b1"), ("b2", "a"), ("b1", "c"), ("b2", "c"), ("d", "c"), *((f"x{k}", f"y{k % 7}") for k in range(2000))]
    e = spark.createDataFrame([(*p, "calls", "EXTRACTED") for p in pairs], "source string, target string, relation string, confidence string")
    rows, level = [], traverse.level
    monkeypatch.setattr(traverse, "level", lambda df: rows.append((out := level(df)).count()) or out)
    assert traverse.shortest_path(e, "a", "d") == ["a", "b1", "c", "d"] and sum(rows) < 50
    assert traverse.shortest_path(e, "a", "y1") == [] and traverse.shortest_path(e, "a", "b2") == ["a", "b2"]
    monkeypatch.setattr(traverse, "NARROW", 1)
    assert traverse.shortest_path(e, "a", "d") == ["a", "b1", "c", "d"] and max(rows) > 2000


def test_path_edges_filter_links_first(spark, monkeypatch):
    e = spark.createDataFrame([("a", "b", "calls", "EXTRACTED"), ("c", "b", "uses", "INFERRED"), ("x", "y", "calls", "EXTRACTED")], "source string, target string, relation string, confidence string")
    monkeypatch.setattr(traverse, "shortest_path", lambda *_: ["a", "b", "c"])
    plans, collect = [], type(e).collect
    monkeypatch.setattr(type(e), "collect", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or collect(df))
    assert [(h["relation"], h["forward"]) for h in traverse.path_edges(e, "a", "c")] == [("calls", True), ("uses", False)]
    assert "IN (a,b,c)" in plans[-1]


def test_ask(spark):
    n, e = make(spark, [("auth_validate", "authValidate()", "auth.go"), ("auth_check", "checkToken()", "auth.go"), ("util_log", "log()", "util.go"), ("noise", "unrelated()", "n.go")], [("auth_validate", "auth_check", "calls"), ("auth_check", "util_log", "calls")])
    for mode in ("bfs", "dfs"):
        text = ask.ask(n, e, "how does authValidate work", mode)
        assert text.startswith(f"Traversal: {mode.upper()} depth=2 | Start: [authValidate()] | 3 nodes found") and "log()" in text and "unrelated" not in text
        assert "EDGE authValidate() --calls [INFERRED]--> checkToken()" in text
    assert "truncated" in ask.ask(n, e, "authValidate", budget=20)
    assert ask.ask(n, e, "zzzz") == "No matching nodes found."
    scored = spark.createDataFrame([("a", "a", "a", 1000.0, 1), ("b", "b", "b", 1.0, 1), ("c", "c", "c", 0.9, 1)], "id string, label string, norm string, score double, label_bytes long")
    assert [r.id for r in ask.seeds(scored).collect()] == ["a"]


def test_assembly(spark):
    n, _ = make(spark, [("a", "a", "x.go"), ("b", "b", "y.ts"), ("c", "c", "z.go")], [("a", "a", "calls")])
    e = spark.createDataFrame([("a", "c", "calls", "INFERRED", 0), ("a", "b", "calls", "INFERRED", 1), ("a", "ghost", "calls", "INFERRED", 2), ("A", "c", "calls", "INFERRED", 3)], "source string, target string, relation string, confidence string, ord long")
    got = graph.reconcile_edges(n, e, F.lower).collect()
    assert [(r.source, r.target, r.ord) for r in got] == [("a", "c", 3)]  # links are ordered by their ends as they were


def test_server(spark):
    n, e = make(spark, [("f1", "one()", "a.go", "code", 0), ("f2", "two()", "b.go", "code", 0), ("f3", "three()", "b.go", "code", 1)], [("f1", "f2", "calls"), ("f2", "f3", "calls", "EXTRACTED")])
    s = Server(n, e)
    call = lambda name, **a: s.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}}))["result"]
    assert "Traversal: BFS depth=6" in call("query_graph", question="one", depth=99)["content"][0]["text"]
    assert "Degree: 2" in call("get_node", label="two()")["content"][0]["text"]
    assert "<- one()" in call("get_neighbors", label="f2", relation_filter="CALL")["content"][0]["text"]
    assert "(2 nodes)" in call("get_community", community_id=0)["content"][0]["text"]
    assert "two()" in call("god_nodes", top_n=1)["content"][0]["text"]
    assert "EXTRACTED: 50%" in call("graph_stats")["content"][0]["text"]
    assert "(2 hops)" in call("shortest_path", source="f1", target="f3")["content"][0]["text"]
    assert call("shortest_path", source="f1", target="f1")["isError"] and call("get_node", label="zzz")["isError"]
    assert s.handle("{")["error"]["code"] == -32700 and s.handle('{"id": 1, "method": "x"}')["error"]["code"] == -32601
    assert s.handle('{"id": 1, "method": "tools/call", "params": {"name": "x"}}')["error"]["code"] == -32602
    out = io.StringIO()
    s.run(io.StringIO('{"id": 1, "method": "initialize"}\n\n{"id": 2, "method": "tools/list"}\n'), out)
    first, second = map(json.loads, out.getvalue().splitlines())
    assert first["result"]["protocolVersion"] == "2024-11-05" and len(second["result"]["tools"]) == 7


def test_enrich(spark):
    notes = spark.createDataFrame([("d1", "a.md", "text one", 0), ("d2", "b.md", "text two", 1), ("d3", "c.md", "boom", 2)], "id string, file string, content string, seq long")
    nodes = spark.createDataFrame([("d1",), ("d2",), ("d3",), ("core",)], "id string")

    def backend(id_, file, content):
        if content == "boom":
            raise ValueError
        return [{"id": "concept_x", "label": "X", "file_type": "code"}, {"id": "core", "label": "no"}], [
            {"source": id_, "target": "concept_x", "relation": "cites", "confidence": "EXTRACTED"},
            {"source": id_, "target": "ghost", "relation": "cites"},
            {"source": id_, "target": "core", "relation": "calls"},
        ]

    cache = enrich.read_notes(notes, backend).persist()
    found, links = enrich.collect(cache, nodes)
    assert [(r.id, r.file_type) for r in found.collect()] == [("concept_x", "semantic_concept")]
    assert sorted((r.source, r.target, r.confidence) for r in links.collect()) == [("d1", "concept_x", "INFERRED"), ("d2", "concept_x", "INFERRED")]

    def never(*_):
        raise AssertionError

    again = enrich.read_notes(notes, never, cache)
    assert again.count() == 3 and enrich.collect(again, nodes)[1].count() == 2
