"""Graph kernels over an edge table (src, dst). An edge reads "src calls dst".

Closures run as a frontier loop: each round joins the frontier with the edges, drops what was seen by an anti join and
settles the new frontier, so a round's plan is small whatever the depth, and cycles end by themselves. Path kernels grow
arrays of nodes and guard against repeats; their number of rounds is the depth bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.tables import settle, union_all

DELEGATION_NAMES = (
    "equals", "hashcode", "tostring", "iterator", "of", "close", "read", "write", "isopen", "length", "size", "charat",
    "subsequence", "stream", "isempty", "get", "from", "run", "start", "stop", "filter", "execute",
)
#: Entry points by name, a fixed value.
ENTRY_WORDS = ("main", "test_", "__init__")
TRUNCATED = "...(truncated)"


def edge_kind(callee) -> F.Column:
    """internal, builtin or external, by the callee's prefix."""
    return F.when(callee.startswith("<builtin>."), "builtin").when(callee.startswith("<external>."), "external").otherwise("internal")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, merge: bool = False) -> DataFrame:
    """(node, depth): what the seeds (node) reach along src -> dst, with the first depth; seeds have depth 0.

    With `merge` no round is sent through the driver, for seeds that are a share of the graph.
    """
    whole = (lambda df: df.hint("merge")) if merge else (lambda df: df)
    edges = settle(edges.select("src", "dst"), "closure-edges")  # once, not once a round
    frontier = settle(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = whole(frontier).join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        step = step.join(whole(union_all(seen).select("node")), "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = settle(step, "frontier")
        if frontier.isEmpty():
            break
        seen.append(frontier)
        if len(seen) > 4:  # a round reads few tables, however many rounds there were
            seen = [settle(union_all(seen), "seen")]
    return union_all(seen)


def one_node(edges: DataFrame, node) -> DataFrame:
    kind = edges.schema["src"].dataType
    return edges.sparkSession.range(1).select(F.lit(node).cast(kind).alias("node"))


def who_calls(edges: DataFrame, target) -> DataFrame:
    return edges.where(F.col("dst") == target).select(F.col("src").alias("caller")).distinct()


def impact_by_depth(edges: DataFrame, target, max_depth: int | None = 25) -> DataFrame:
    """(node, depth) of all direct and indirect callers, the target left out even on a cycle."""
    return closure(reversed_edges(edges), one_node(edges, target), max_depth).where(F.col("node") != target)


def impact_of(edges: DataFrame, target) -> DataFrame:
    return impact_by_depth(edges, target, None).select("node")


def impact_of_many(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Union of the impacts of several targets (node), none of which counts itself."""
    return closure(reversed_edges(edges), targets).join(targets, "node", "left_anti").select("node")


def reachable_from(edges: DataFrame, source) -> DataFrame:
    return closure(edges, one_node(edges, source)).where(F.col("node") != source).select("node")


def shortest_length(edges: DataFrame, source, target) -> DataFrame:
    """One row (length): hops of a shortest path; 0 for the node itself, null if there is none."""
    found = closure(edges, one_node(edges, source)).where(F.col("node") == target)
    return found.agg(F.min("depth").cast("long").alias("length"))


def shortest_path(edges: DataFrame, source, target) -> DataFrame:
    """One row (path) with the smallest of the shortest paths, by the order of its nodes; none if there is none."""
    depths = settle(closure(edges, one_node(edges, source)), "depths")
    goal = depths.where(F.col("node") == target).first()
    if goal is None:
        return edges.sparkSession.createDataFrame([], f"path array<{edges.schema['src'].dataType.simpleString()}>")
    paths = one_node(edges, target).select(F.array("node").alias("path"))
    for depth in range(goal["depth"] - 1, -1, -1):
        before = depths.where(F.col("depth") == depth).select("node")
        step = paths.join(edges, F.element_at("path", 1) == F.col("dst")).join(before, F.col("src") == before.node)
        # of the ways into the same first node, the smaller continuation is enough
        paths = settle(step.groupBy("src").agg(F.min("path").alias("path")).select(F.concat(F.array("src"), "path").alias("path")), "paths")
    return paths.agg(F.min("path").alias("path"))


def paths_between(edges: DataFrame, source, target, max_nodes: int = 8) -> DataFrame:
    """(path): simple forward paths of at most max_nodes nodes; a path stops at the target; none from a node to itself."""
    edges = edges.select("src", "dst")
    live = one_node(edges, source).where(F.lit(source) != F.lit(target)).select(F.array("node").alias("path"))
    found = []
    for _ in range(max_nodes - 1):
        step = live.join(edges, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = settle(step.select(F.concat("path", F.array("dst")).alias("path")), "paths")
        found.append(step.where(F.element_at("path", -1) == target))
        live = step.where(F.element_at("path", -1) != target)
    return union_all(found)


def paths_to(edges: DataFrame, target, max_nodes: int = 8, limit: int | None = None) -> DataFrame:
    """(path, truncated): simple chains that end in the target and begin at a node without callers outside the chain.

    A chain of max_nodes nodes that could go on is given as it is, and once more with truncated set. `limit` keeps the
    first ones by length, then by their nodes.
    """
    edges = settle(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "paths-edges")  # once, not once a round
    callers = edges.groupBy("dst").agg(F.count("src").alias("callers"))
    live = one_node(edges, target).select(F.array("node").alias("path"))
    done = []
    for size in range(1, max_nodes + 1):
        step = live.join(edges, F.element_at("path", 1) == F.col("dst"), "left")
        step = settle(step.select("path", "src", F.array_contains("path", F.coalesce("src", F.element_at("path", 1))).alias("back")), "paths")
        if size > 1:
            # A chain ends at a node without callers, or where all callers are in the chain: only those that lead back are counted.
            done.append(step.where("src IS NULL").select("path", F.lit(False).alias("truncated")))
            back = step.where("back AND src IS NOT NULL")
            if not back.isEmpty():
                stuck = back.groupBy("path").agg(F.count("src").alias("n")).join(callers, F.element_at("path", 1) == F.col("dst")).where("n = callers")
                done.append(stuck.select("path", F.lit(False).alias("truncated")))
        more = step.where("NOT back")
        if size == max_nodes:
            cut = more.select("path").distinct()
            done += [cut.select("path", F.lit(x).alias("truncated")) for x in (False, True)]
        elif more.isEmpty():
            break
        live = more.select(F.concat(F.array("src"), "path").alias("path"))
    out = union_all(done) if done else live.select("path", F.lit(False).alias("truncated")).limit(0)
    return out if limit is None else out.orderBy(F.size("path"), "path", "truncated").limit(limit)


def walk_chains(calls: DataFrame, start, max_hops: int = 6) -> DataFrame:
    """(hops, ending): call chains from a node over calls (src, dst, kind), one per choice of edges.

    ending is leaf (an external or builtin callee, or a callee without calls), cycle (a node of the chain again) or
    truncated (max_hops reached).
    """
    node = calls.schema["src"].dataType.simpleString()
    live = one_node(calls, start).select(F.array().cast(f"array<{node}>").alias("hops"), F.array("node").alias("nodes"))
    done = []
    for hop in range(1, max_hops + 1):
        step = live.join(calls.select("src", "dst", "kind"), F.element_at("nodes", -1) == F.col("src"), "left")
        cyc, inner = F.array_contains("nodes", F.coalesce("dst", "src", F.element_at("nodes", -1))), F.col("kind") == "internal"
        ending = F.when(F.col("dst").isNull(), F.when(F.size("hops") > 0, "leaf")).when(~inner, "leaf").when(cyc, "cycle").when(F.lit(hop >= max_hops), "truncated").otherwise("open")
        hops = F.when(F.col("dst").isNull(), F.col("hops")).otherwise(F.concat("hops", F.array("dst")))
        step = settle(step.select(hops.alias("hops"), F.when(F.col("dst").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array("dst"))).alias("nodes"), ending.alias("ending")), "chains")
        done.append(step.where("ending IS NOT NULL AND ending <> 'open'").select("hops", "ending"))
        live = step.where("ending = 'open'").select("hops", "nodes")
    return union_all(done)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def dead_code(edges: DataFrame, nodes: DataFrame | None = None, words: tuple[str, ...] = ENTRY_WORDS) -> DataFrame:
    """(node, likely_entry_point): nodes that nothing calls. An entry word counts anywhere in the name."""
    # What is no callee of an edge can only be a caller.
    nodes = nodes if nodes is not None else edges.select(F.col("src").alias("node")).distinct()
    quiet = nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    name = F.col("node").cast("string")
    entry = F.lit(False)
    for word in words:
        entry = entry | F.contains(name, F.lit(word))
    return quiet.select("node", entry.alias("likely_entry_point"))


def caller_verdicts(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, callers, verdict) of targets (node): no visible caller is a known unknown, not proof that there is none."""
    found = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("callers"))
    out = targets.select("node").join(found, "node", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return out.withColumn("verdict", F.when(F.col("callers") == 0, "KNOWN_UNKNOWN").otherwise("OBSERVED"))


def annotate_hops(chains: DataFrame, types: DataFrame) -> DataFrame:
    """chains (hops, ending) as hops in order with callee_type where types (fid, type) has the callee; null elsewhere."""
    known = types.select(F.col("fid").alias("callee"), F.col("type").alias("callee_type"))
    flat = chains.withColumn("chain", F.monotonically_increasing_id()).select("chain", "ending", F.posexplode("hops").alias("at", "callee"))
    return flat.join(known, "callee", "left").select("chain", "at", "callee", "callee_type", "ending")


def depends_on(edges: DataFrame, prefix: str) -> DataFrame:
    """(caller): callers of nodes under the prefix that are not under it themselves."""
    return edges.where(F.col("dst").startswith(prefix) & ~F.col("src").startswith(prefix)).select(F.col("src").alias("caller")).distinct()


#: Edges of one task where each is told apart, on average.
EDGES_A_TASK = 1_000_000


def hotspots(edges: DataFrame, top: int = 15) -> DataFrame:
    """(direction, node, degree): the top nodes by distinct callers (in) and by calls (out); zeros go after the cut."""
    edges = settle(edges.select("src", "dst"), "hotspot-edges")
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // EDGES_A_TASK))
    callers = edges.repartition(tasks, "src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("src").alias("degree"))
    called = edges.repartition(tasks, "src").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    degrees = union_all([x.select(F.lit(w).alias("direction"), "node", "degree") for w, x in (("in", callers), ("out", called))])
    rank = F.row_number().over(Window.partitionBy("direction").orderBy(F.desc("degree"), "node"))
    return degrees.withColumn("rank", rank).where(F.col("rank") <= top).select("direction", "node", "degree")


def edge_stats(calls: DataFrame) -> DataFrame:
    """One row: internal, external and builtin edges, callers with an internal edge, nodes of internal edges."""
    kind = F.col("kind")
    count = lambda k: F.count_if(kind == k)
    inner = calls.where(kind == "internal")
    nodes = nodes_of(inner).agg(F.count("*").alias("internal_nodes"))
    stats = calls.agg(count("internal").alias("internal_edges"), count("external").alias("external_edges"), count("builtin").alias("builtin_edges"), F.countDistinct(F.when(kind == "internal", F.col("src"))).alias("callers"))
    return stats.crossJoin(nodes)  # one row each


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each strongly connected component, for every node.

    Forward and backward colouring: every node takes the smallest node that reaches it; the nodes of a colour that reach
    its root back within the colour are that root's component and leave the graph.
    """
    left = settle(edges.select("src", "dst").distinct().where("src <> dst"), "scc-edges")
    rest, done = settle(nodes_of(edges), "scc-nodes"), []
    while not rest.isEmpty():
        color = settle(rest.select("node", F.col("node").alias("color")), "scc-colors")
        while True:
            into = left.join(color.hint("merge"), left.src == color.node).groupBy("dst").agg(F.min("color").alias("least"))
            step = color.join(into.hint("merge"), color.node == into.dst, "left").select("node", F.least("color", "least").alias("color"), (F.col("least") < F.col("color")).alias("moved"))
            step = settle(step, "scc-colors")
            color = step.select("node", "color")
            if step.where("moved").isEmpty():
                break
        a, b = color.toDF("src", "src_color"), color.toDF("dst", "dst_color")
        within = settle(left.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("src_color = dst_color").select("src", "dst"), "scc-within")
        found = settle(closure(reversed_edges(within), color.where("node = color").select("node"), merge=True).join(color.hint("merge"), "node").select("node", F.col("color").alias("component")), "scc-found")
        done.append(found)
        gone = found.select("node")
        gone = gone.hint("merge")
        rest = settle(rest.join(gone, "node", "left_anti"), "scc-nodes")
        left = settle(within.join(gone, within.src == gone.node, "left_anti").join(gone, F.col("dst") == gone.node, "left_anti"), "scc-edges")
    return union_all(done) if done else rest.select("node", F.col("node").alias("component"))


def recursion_clusters(edges: DataFrame) -> DataFrame:
    """(kind, members): mutual cycles, and self-loops split by names that delegation often binds wrongly."""
    sizes = strong_components(edges).groupBy("component").agg(F.array_sort(F.collect_list(F.col("node").cast("string"))).alias("members")).where(F.size("members") > 1)
    loops = edges.where("src = dst").select(F.col("src").cast("string").alias("node")).distinct()
    short = F.lower(F.element_at(F.split("node", r"\."), -1))
    kind = F.when(short.isin(*DELEGATION_NAMES), "direct_name_artifact").otherwise("direct")
    return sizes.select(F.lit("mutual").alias("kind"), "members").union(loops.select(kind, F.array("node")))


def chokepoints(edges: DataFrame, target) -> DataFrame:
    """(node): strict dominators of the target from all nodes without callers; none if no such node reaches it.

    Every dominator lies on any one way to the target, so one shortest way from a root is taken. Its nodes have their
    places on it; every other ancestor has the smallest place from which it is reached without a later node of the way
    (-1 from another root). A node of the way is passed by if a later one is entered from a smaller place.
    """
    above = settle(impact_by_depth(edges, target, None).select("node", "depth").union(one_node(edges, target).withColumn("depth", F.lit(0))), "ancestors")
    inner = settle(edges.select("src", "dst").distinct().join(above, F.col("src") == above.node, "left_semi").join(above, F.col("dst") == above.node, "left_semi"), "ancestor-edges")
    roots = settle(above.join(inner.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"), "roots")
    start = roots.orderBy("depth", "node").first()
    if start is None or start["depth"] == 0:
        return above.select("node").limit(0)
    way = shortest_path(inner, start["node"], target).select(F.posexplode("path").alias("place", "node"))
    way = settle(way.select("node", F.col("place").cast("long").alias("place")), "way")
    others = roots.join(way, "node", "left_anti").select("node", F.lit(-1).cast("long").alias("place"))
    reached, frontier = settle(others, "reached"), settle(way.union(others), "reaching")
    entered = []
    while not frontier.isEmpty():
        step = frontier.join(inner, frontier.node == inner.src).groupBy(F.col("dst").alias("node")).agg(F.min("place").alias("place"))
        onto = step.join(way.withColumnRenamed("place", "own"), "node", "left")
        entered.append(settle(onto.where("own IS NOT NULL").select("own", "place"), "entered"))
        old = reached.withColumnRenamed("place", "old")
        frontier = settle(onto.where("own IS NULL").join(old, "node", "left").where("old IS NULL OR place < old").select("node", "place"), "reaching")
        reached = settle(reached.union(frontier).groupBy("node").agg(F.min("place").alias("place")), "reached")
    jumps = settle(union_all(entered).groupBy("own").agg(F.min("place").alias("place")).where("place < own - 1"), "jumps")
    passed = way.join(jumps.withColumnRenamed("place", "from_place"), F.col("place").between(F.col("from_place") + 1, F.col("own") - 1), "left_semi")  # places of one way only
    return way.where(F.col("node") != F.lit(target)).join(passed.select("node"), "node", "left_anti").select("node")


def module_adjacency(imports: DataFrame) -> DataFrame:
    """(src, dst) of imports (module, target: dotted): the longest prefix of a target that is another module."""
    modules = imports.select(F.col("module").alias("dst")).distinct()
    parts = F.split("target", r"\.")
    tried = imports.select("module", "target", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("rank", "dst"))
    hit = tried.distinct().join(modules, "dst").where("dst <> module")
    return hit.groupBy("module", "target").agg(F.min_by("dst", "rank").alias("dst")).select(F.col("module").alias("src"), "dst").distinct()


def dead_clusters(quiet: DataFrame, top: int = 10) -> DataFrame:
    """(module, n): the top-level modules with most nodes that nothing calls."""
    return quiet.groupBy(F.split("node", r"\.")[0].alias("module")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(top)


def split_id(node: str = "node") -> F.Column:
    """struct(module, class, name) of a dotted id: the first capitalised segment is the class."""
    parts = F.split(node, r"\.")
    at = F.array_position(F.transform(parts, lambda p: p.rlike(r"^\p{Lu}")), F.lit(True)).cast("int")
    rest = F.slice(parts, at + 1, F.greatest(F.size(parts) - at, F.lit(0)))
    plain = F.struct(
        F.concat_ws(".", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("module"), F.lit(None).cast("string").alias("class"), F.element_at(parts, -1).alias("name")
    )
    return F.when(at == 0, plain).otherwise(
        F.struct(F.concat_ws(".", F.slice(parts, F.lit(1), at - 1)).alias("module"), F.element_at(parts, at).alias("class"), F.when(F.size(rest) > 0, F.concat_ws(".", rest)).alias("name"))
    )


def change_impact(edges: DataFrame, wanted: str) -> DataFrame:
    """One row about a change of the target: callers, affected nodes, modules and classes, depth and regression risk.

    The target is the id itself or else the smallest caller id that contains the wanted text; no row if there is none.
    """
    edges = settle(edges.select("src", "dst"), "impact-edges")  # four questions follow
    callers = edges.select(F.col("src").alias("node")).distinct().where(F.contains("node", F.lit(wanted)))
    best = callers.orderBy(F.col("node") != wanted, "node").first()
    spark = edges.sparkSession
    if best is None:
        return spark.createDataFrame([], "target string, direct_callers long, affected long, modules long, classes long, max_depth int, public_api boolean, regression_risk string")
    target = best["node"]
    hit = impact_of(edges, target).withColumn("at", split_id())
    facts = hit.agg(F.count("*").alias("affected"), F.countDistinct("at.module").alias("modules"), F.countDistinct(F.when(F.col("at.class").isNotNull(), F.concat_ws(".", "at.module", "at.class"))).alias("classes"))
    depth = paths_to(edges, target).agg(F.coalesce(F.max(F.size("path") + F.col("truncated").cast("int")), F.lit(0)).alias("max_depth"))
    direct = who_calls(edges, target).agg(F.count("*").alias("direct_callers"))
    row = spark.range(1).select(F.lit(target).alias("target")).crossJoin(direct).crossJoin(facts).crossJoin(depth)  # one row each
    name = F.coalesce(split_id("target")["name"], F.element_at(F.split("target", r"\."), -1))
    row = row.withColumn("public_api", ~name.startswith("_"))
    met = F.col("public_api").cast("int") + (F.col("max_depth") >= 3).cast("int") + (F.col("affected") >= 3).cast("int")
    return row.withColumn("regression_risk", F.when(met == 3, "HIGH").when(met == 2, "MEDIUM").otherwise("LOW"))
