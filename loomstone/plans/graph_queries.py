"""Graph kernels on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import graph
from loomstone.plans.edges import EVENT_SQL, NAT_SQL, SYNTHETIC_SQL, event_flow, natural, part_count, synthetic
from loomstone.plans.registry import query
from loomstone.tables import load

#: Two tripling steps from 17, modulo the number of parts.
FAR_SQL, FAR = "(SELECT 157 % n FROM N)", 157


@query(f"WITH {NAT_SQL} SELECT DISTINCT src AS caller FROM E WHERE dst = 'n3'")
def q_who_calls(spark, d):
    return graph.who_calls(natural(spark, d), "n3")


def _up(edges: str, target: str) -> str:
    return f"WITH RECURSIVE {edges}, R(node) AS (SELECT {target} UNION SELECT E.src FROM E JOIN R ON E.dst = R.node) SELECT node FROM R WHERE node <> {target}"


@query(_up(NAT_SQL, "'r1'"))
def q_impact_of(spark, d):
    return graph.impact_of(natural(spark, d), "r1")


@query(_up(SYNTHETIC_SQL, "17"))
def q_impact_of_sparse(spark, d):
    return graph.impact_of(synthetic(spark, d), 17)


@query(f"WITH RECURSIVE {SYNTHETIC_SQL}, R(node, depth) AS (SELECT 17, 0 UNION SELECT E.src, depth + 1 FROM E JOIN R ON E.dst = R.node WHERE depth < 25) SELECT node, min(depth)::INT AS depth FROM R WHERE node <> 17 GROUP BY 1")
def q_impact_depth(spark, d):
    return graph.impact_by_depth(synthetic(spark, d), 17)


@query(f"WITH RECURSIVE {SYNTHETIC_SQL}, R(node) AS (SELECT 3 UNION SELECT E.dst FROM E JOIN R ON E.src = R.node) SELECT node FROM R WHERE node <> 3")
def q_reachable(spark, d):
    return graph.reachable_from(synthetic(spark, d), 3)


@query(f"""WITH RECURSIVE {SYNTHETIC_SQL}, P(path) AS (SELECT [17::BIGINT] UNION ALL SELECT list_append(path, E.dst) FROM P JOIN E ON E.src = path[-1]
  WHERE len(path) < 8 AND path[-1] <> {FAR_SQL} AND NOT list_contains(path, E.dst)) SELECT array_to_string(path, '>') AS path FROM P WHERE path[-1] = {FAR_SQL}""")  # fmt: skip
def q_paths_between(spark, d):
    return graph.paths_between(synthetic(spark, d), 17, FAR % part_count(spark, d)).select(F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


@query(f"""WITH RECURSIVE {NAT_SQL}, U AS (SELECT DISTINCT src, dst FROM E), P(path) AS (SELECT ['r2'] UNION ALL SELECT list_prepend(U.src, path) FROM P JOIN U ON U.dst = path[1] WHERE len(path) < 8)
SELECT array_to_string(path, '>') AS path, false AS truncated FROM P WHERE len(path) > 1 AND path[1] NOT IN (SELECT dst FROM U)""")  # fmt: skip
def q_paths_to(spark, d):
    out = graph.paths_to(natural(spark, d), "r2")
    return out.select(F.concat_ws(">", "path").alias("path"), "truncated")


@query(f"""WITH RECURSIVE {EVENT_SQL}, P(hops, nodes, ending) AS (SELECT []::VARCHAR[], ['view'], 'open' UNION ALL
  SELECT list_append(hops, E.dst), list_append(nodes, E.dst), CASE WHEN list_contains(nodes, E.dst) THEN 'cycle' WHEN len(hops) + 1 >= 4 THEN 'truncated' ELSE 'open' END
  FROM P JOIN E ON E.src = nodes[-1] WHERE ending = 'open') SELECT array_to_string(hops, '>') AS hops, ending FROM P WHERE ending <> 'open'""")  # fmt: skip
def q_chains(spark, d):
    calls = event_flow(spark, d).withColumn("kind", graph.edge_kind(F.col("dst")))
    return graph.walk_chains(calls, "view", 4).select(F.concat_ws(">", "hops").alias("hops"), "ending")


@query(f"WITH {NAT_SQL} SELECT node, contains(node, 'main') OR contains(node, 'test_') OR contains(node, '__init__') AS likely_entry_point FROM (SELECT src AS node FROM E UNION SELECT dst FROM E) WHERE node NOT IN (SELECT dst FROM E)")
def q_dead_code(spark, d):
    return graph.dead_code(natural(spark, d))


@query(f"WITH {NAT_SQL} SELECT DISTINCT src AS caller FROM E WHERE starts_with(dst, 'c1') AND NOT starts_with(src, 'c1')")
def q_depends_on(spark, d):
    return graph.depends_on(natural(spark, d), "c1")


def _scc(edges: str) -> str:
    return f"""WITH RECURSIVE {edges}, V AS (SELECT src AS node FROM E UNION SELECT dst FROM E),
R(a, b) AS (SELECT node, node FROM V UNION SELECT a, E.dst FROM R JOIN E ON E.src = R.b)
SELECT x.a AS node, min(x.b) AS component FROM R x JOIN R y ON x.a = y.b AND x.b = y.a GROUP BY 1"""


@query(_scc(SYNTHETIC_SQL))
def q_scc(spark, d):
    return graph.strong_components(synthetic(spark, d))


@query(_scc(EVENT_SQL))
def q_scc_events(spark, d):
    return graph.strong_components(event_flow(spark, d))


CHOKE = "E AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey // 4, p_partkey FROM part WHERE p_partkey >= 8)"


@query(f"""WITH RECURSIVE {CHOKE}, A(node) AS (SELECT 75::BIGINT UNION SELECT E.src FROM E JOIN A ON E.dst = A.node),
R(avoid, node) AS (SELECT c.node, r.node FROM A c, A r WHERE c.node <> 75 AND r.node <> c.node AND r.node NOT IN (SELECT dst FROM E)
  UNION SELECT avoid, E.dst FROM R JOIN E ON E.src = R.node WHERE E.dst <> avoid)
SELECT node FROM A WHERE node <> 75 AND node NOT IN (SELECT avoid FROM R WHERE node = 75)""")  # fmt: skip
def q_chokepoints(spark, d):
    k = load(spark, d, "part").where("p_partkey > 0")
    two = k.selectExpr("p_partkey DIV 2 AS src", "p_partkey AS dst")
    return graph.chokepoints(two.union(k.where("p_partkey >= 8").selectExpr("p_partkey DIV 4", "p_partkey")), 75)


@query(f"""WITH {NAT_SQL}, N AS (SELECT src AS node FROM E UNION SELECT dst FROM E),
I AS (SELECT node, count(DISTINCT src) AS degree FROM N LEFT JOIN E ON dst = node GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15),
O AS (SELECT node, count(src) AS degree FROM N LEFT JOIN E ON src = node GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
SELECT 'in' AS direction, node, degree FROM I WHERE degree > 0 UNION ALL SELECT 'out', node, degree FROM O WHERE degree > 0""")  # fmt: skip
def q_hotspots(spark, d):
    return graph.hotspots(natural(spark, d))


@query(f"WITH RECURSIVE {SYNTHETIC_SQL}, R(node, depth) AS (SELECT 17, 0 UNION SELECT E.dst, depth + 1 FROM E JOIN R ON E.src = R.node WHERE depth < 30) SELECT min(depth)::BIGINT AS length FROM R WHERE node = {FAR_SQL}")
def q_shortest_len(spark, d):
    return graph.shortest_length(synthetic(spark, d), 17, FAR % part_count(spark, d))


@query(f"""WITH RECURSIVE {SYNTHETIC_SQL}, R(node, path) AS (SELECT 17::BIGINT, [17::BIGINT] UNION ALL SELECT E.dst, list_append(path, E.dst) FROM E JOIN R ON E.src = R.node WHERE len(path) < 8 AND NOT list_contains(path, E.dst))
SELECT array_to_string(path, '>') AS path FROM R WHERE node = {FAR_SQL} ORDER BY len(path), path LIMIT 1""")  # fmt: skip
def q_shortest_path(spark, d):
    return graph.shortest_path(synthetic(spark, d), 17, FAR % part_count(spark, d)).select(F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


KINDED = f"{NAT_SQL}, K AS (SELECT *, CASE WHEN starts_with(src, 'o') THEN 'external' WHEN starts_with(dst, 'r') THEN 'builtin' ELSE 'internal' END AS kind FROM E)"


@query(f"""WITH {KINDED} SELECT count(*) FILTER (kind = 'internal') AS internal_edges, count(*) FILTER (kind = 'external') AS external_edges,
count(*) FILTER (kind = 'builtin') AS builtin_edges, count(DISTINCT src) FILTER (kind = 'internal') AS callers,
(SELECT count(*) FROM (SELECT src FROM K WHERE kind = 'internal' UNION SELECT dst FROM K WHERE kind = 'internal')) AS internal_nodes FROM K""")  # fmt: skip
def q_edge_stats(spark, d):
    kind = F.when(F.col("src").startswith("o"), "external").when(F.col("dst").startswith("r"), "builtin").otherwise("internal")
    return graph.edge_stats(natural(spark, d).withColumn("kind", kind))


@query(f"""WITH RECURSIVE {NAT_SQL}, T AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_nationkey = 4), R(node) AS (SELECT node FROM T UNION SELECT E.src FROM E JOIN R ON E.dst = R.node)
SELECT node FROM R WHERE node NOT IN (SELECT node FROM T)""")  # fmt: skip
def q_class_impact(spark, d):
    targets = load(spark, d, "customer").where("c_nationkey = 4").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return graph.impact_of_many(natural(spark, d), targets)


@query(f"""WITH RECURSIVE {NAT_SQL}, U AS (SELECT DISTINCT src, dst FROM E), A(node) AS (SELECT src FROM U WHERE dst = 'n7' UNION SELECT U.src FROM U JOIN A ON U.dst = A.node),
P(path) AS (SELECT ['n7'] UNION ALL SELECT list_prepend(U.src, path) FROM P JOIN U ON U.dst = path[1] WHERE len(path) < 8 AND NOT list_contains(path, U.src)),
D AS (SELECT coalesce(max(len(path)), 0)::INT AS max_depth FROM P WHERE len(path) > 1 AND path[1] NOT IN (SELECT dst FROM U)),
F AS (SELECT 'n7' AS target, (SELECT count(DISTINCT src) FROM E WHERE dst = 'n7') AS direct_callers, count(*) AS affected,
  count(DISTINCT regexp_replace(node, '[.]?[^.]*$', '')) AS modules, count(DISTINCT node) FILTER (regexp_matches(node, '(^|[.])[A-Z]')) AS classes FROM A)
SELECT *, NOT starts_with(target, '_') AS public_api,
  CASE (NOT starts_with(target, '_'))::INT + (max_depth >= 3)::INT + (affected >= 3)::INT WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS regression_risk FROM F, D""")  # fmt: skip
def q_change_impact(spark, d):
    return graph.change_impact(natural(spark, d), "n7")


_MODULES = "'p' || p_size || '.' || lower(replace(p_brand, '#', ''))"
_IMPORTS = f"I AS (SELECT DISTINCT {_MODULES} AS module, 'p' || (p_size * 3 % 50 + 1) || '.' || lower(replace(p_brand, '#', '')) || '.f' || p_partkey % 5 AS target FROM part)"


@query(f"""WITH {_IMPORTS}, M AS (SELECT DISTINCT module AS dst FROM I), T AS (SELECT module, target, unnest(range(1, 4)) AS n, string_split(target, '.') AS s FROM I),
C AS (SELECT module, target, n, array_to_string(s[1:n], '.') AS dst FROM T), H AS (SELECT module, target, max_by(C.dst, n) AS dst FROM C JOIN M USING (dst) WHERE dst <> module GROUP BY 1, 2)
SELECT DISTINCT module AS src, dst FROM H""")  # fmt: skip
def q_module_adjacency(spark, d):
    module = F.concat(F.lit("p"), "p_size", F.lit("."), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    target = F.concat(F.lit("p"), F.col("p_size") * 3 % 50 + 1, F.lit("."), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".f"), F.col("p_partkey") % 5)
    return graph.module_adjacency(load(spark, d, "part").select(module.alias("module"), target.alias("target")).distinct())


@query("""WITH E AS (SELECT DISTINCT 'm' || l_suppkey % 7 || '.o' || l_orderkey AS src, 'k' || l_partkey % 3 || '.p' || l_partkey AS dst FROM lineitem)
SELECT string_split(node, '.')[1] AS module, count(*) AS n FROM (SELECT DISTINCT src AS node FROM E) WHERE node NOT IN (SELECT dst FROM E) GROUP BY 1 ORDER BY n DESC, module LIMIT 10""")  # fmt: skip
def q_dead_clusters(spark, d):
    li = load(spark, d, "lineitem")
    edges = li.select(F.concat(F.lit("m"), F.col("l_suppkey") % 7, F.lit(".o"), "l_orderkey").alias("src"), F.concat(F.lit("k"), F.col("l_partkey") % 3, F.lit(".p"), "l_partkey").alias("dst")).distinct()
    return graph.dead_clusters(graph.dead_code(edges))
