"""Graph kernels on a small graph and against plain Python on random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomstone.operators import graph

#: Three ways into a hub, a cycle of three behind it, a pair that calls each other, and one that calls itself.
EDGES = [
    ("root", "left"), ("root", "mid"), ("root", "right"), ("left", "hub"), ("mid", "hub"), ("right", "hub"), ("hub", "x"), ("x", "y"), ("y", "hub"),
    ("p", "q"), ("q", "p"), ("solo", "solo"),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(EDGES, "src string, dst string")


def vals(df):
    return sorted(tuple(r) for r in df.collect())


def test_answers_on_a_small_graph(small):
    assert vals(graph.who_calls(small, "hub")) == [("left",), ("mid",), ("right",), ("y",)]
    assert vals(graph.impact_by_depth(small, "hub").select("node", "depth")) == [("left", 1), ("mid", 1), ("right", 1), ("root", 2), ("x", 2), ("y", 1)]
    assert vals(graph.reachable_from(small, "root")) == [("hub",), ("left",), ("mid",), ("right",), ("x",), ("y",)]
    assert vals(graph.chokepoints(small, "y")) == [("hub",), ("root",), ("x",)]
    assert vals(graph.chokepoints(small, "hub")) == [("root",)]
    assert vals(graph.chokepoints(small, "p")) == vals(graph.chokepoints(small, "root")) == []
    groups = {(r["kind"], tuple(r["members"])) for r in graph.recursion_clusters(small).collect()}
    assert groups == {("mutual", ("hub", "x", "y")), ("mutual", ("p", "q")), ("direct", ("solo",))}
    assert vals(graph.shortest_length(small, "root", "y")) == [(4,)] and vals(graph.shortest_length(small, "y", "root")) == [(None,)]
    assert graph.shortest_path(small, "root", "y").first()["path"] == ["root", "left", "hub", "x", "y"]
    assert graph.shortest_path(small, "y", "root").count() == 0
    assert {tuple(r["path"]) for r in graph.paths_between(small, "root", "hub").collect()} == {("root", w, "hub") for w in ("left", "mid", "right")}
    assert graph.paths_between(small, "root", "root").count() == 0


def test_paths_to_marks_what_is_cut(small):
    got = {(tuple(r["path"]), r["truncated"]) for r in graph.paths_to(small, "y").collect()}
    assert got == {(("root", w, "hub", "x", "y"), False) for w in ("left", "mid", "right")}
    cut = {(tuple(r["path"]), r["truncated"]) for r in graph.paths_to(small, "y", 3).collect()}
    assert cut == {(("hub", "x", "y"), False), (("hub", "x", "y"), True)}


def test_paths_to_ends_where_all_callers_lead_back(spark):
    e = spark.createDataFrame([("a", "t"), ("b", "a"), ("a", "b"), ("t", "b"), ("c", "a"), (None, "c"), ("c", "c"), ("t", "t")], "src string, dst string")
    got = {(">".join(r["path"]), r["truncated"]) for r in graph.paths_to(e, "t").collect()}
    assert got == {("b>a>t", False), ("c>a>t", False)}
    assert graph.paths_to(e, "nobody").count() == 0


def test_edges_are_read_once_however_long_the_paths(spark):
    read = spark.sparkContext.accumulator(0)
    see = F.udf(lambda x: (read.add(1), x)[1], "string").asNondeterministic()
    e = spark.createDataFrame([(f"n{i}.f", f"n{i + 1}.f") for i in range(6)], "src string, dst string").coalesce(1).withColumn("src", see("src"))
    assert [tuple(r) for r in graph.paths_to(e, "n6.f").select(F.size("path"), "truncated").collect()] == [(7, False)]
    assert read.value == 6
    assert graph.change_impact(e, "n6.f").first() is None and read.value == 12
    assert graph.change_impact(e, "n5.f").first()["max_depth"] == 6 and read.value == 18


def test_components_are_not_sent_through_the_driver(spark, monkeypatch):
    plans = []
    real = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), real(df, label))[1])
    e = spark.createDataFrame([(i, (i * 3 + 1) % 40) for i in range(40)], "src long, dst long")
    graph.strong_components(e).collect()
    assert any("SortMergeJoin" in p for _, p in plans) and not [label for label, p in plans if "Broadcast" in p]


def plain_dominators(edges, target):
    """Nodes without which no node that has no callers reaches the target, by trying each."""
    callers = {}
    for a, b in edges:
        callers.setdefault(b, set()).add(a)

    def reached(avoid):
        seen, todo = {target}, [target]
        while todo:
            for a in callers.get(todo.pop(), ()):
                if a != avoid and a not in seen:
                    seen.add(a)
                    todo.append(a)
        return seen

    above = reached(None)
    roots = {n for n in above if n not in callers} - {target}
    return sorted((n,) for n in above - {target} if not (roots - {n}) & reached(n)) if roots else []


def test_chokepoints_equal_plain_python(spark):
    rng = random.Random(7)
    for no in range(6):
        n = 14
        edges = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(17 + 2 * no)) if a != b and b > 0 and (b > a - 3)} | {(0, 1), (1, 2)})
        frame = spark.createDataFrame(edges, "src long, dst long")
        assert vals(graph.chokepoints(frame, n - 1)) == plain_dominators(edges, n - 1), edges


def test_chains_end_as_defined(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "<builtin>.list.append"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    from pyspark.sql import functions as F

    calls = calls.withColumn("kind", graph.edge_kind(F.col("dst")))
    got = {(tuple(r["hops"]), r["ending"]) for r in graph.walk_chains(calls, "a", 3).collect()}
    assert got == {(("b", "<builtin>.list.append"), "leaf"), (("b", "a"), "cycle"), (("b", "c", "d"), "truncated")}


def test_dead_code_depends_on_and_hotspots(spark):
    e = spark.createDataFrame([("m.main", "m.K.a"), ("m.K.a", "m.K.b"), ("x.f", "m.K.b"), ("domain", "x.f")], "src string, dst string")
    assert vals(graph.dead_code(e)) == [("domain", True), ("m.main", True)]
    assert vals(graph.depends_on(e, "m.K.")) == [("m.main",), ("x.f",)]
    assert vals(graph.hotspots(e, 1)) == [("in", "m.K.b", 2), ("out", "domain", 1)]
    row = graph.change_impact(e, "K.b").first()
    assert graph.change_impact(e, "nothing").count() == 0 and row is None
    row = graph.change_impact(e, "x.f").first()
    assert (row["target"], row["direct_callers"], row["affected"], row["max_depth"], row["regression_risk"]) == ("x.f", 1, 1, 2, "LOW")


def plain_scc(edges):
    nodes = {x for e in edges for x in e}
    out = {}

    def reach(a, pairs):
        seen, q = {a}, deque([a])
        while q:
            x = q.popleft()
            for s, d in pairs:
                if s == x and d not in seen:
                    seen.add(d)
                    q.append(d)
        return seen

    back = [(d, s) for s, d in edges]
    for n in nodes:
        out[n] = min(reach(n, edges) & reach(n, back))
    return out


def test_random_graphs(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 25), rnd.randint(0, 25)) for _ in range(36)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in graph.strong_components(df).collect()} == plain_scc(edges)
    target = edges[0][1]
    seen, q = {target: 0}, deque([target])
    while q:
        x = q.popleft()
        for s, d in edges:
            if d == x and s not in seen:
                seen[s] = seen[x] + 1
                q.append(s)
    seen.pop(target)
    assert {r["node"]: r["depth"] for r in graph.impact_by_depth(df, target).collect()} == seen


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.impact_of(none, "x").count() == graph.strong_components(none).count() == graph.dead_code(none).count() == 0


def test_hotspots_count_callers_once_and_calls_each_time(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_A_TASK", 2)
    e = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("a", "y"), ("c", "a"), ("c", "a"), (None, "x")], "src string, dst string")
    assert vals(graph.hotspots(e, 2)) == [("in", "a", 1), ("in", "x", 2), ("out", "a", 3), ("out", "c", 2)]


def test_split_id(spark):
    df = spark.createDataFrame([("pkg.mod.Cls.run",), ("pkg.f",), ("f",), ("p.Cls",)], "node string").withColumn("at", graph.split_id())
    assert [tuple(r["at"]) for r in df.collect()] == [("pkg.mod", "Cls", "run"), ("pkg", None, "f"), ("", None, "f"), ("p", "Cls", None)]
