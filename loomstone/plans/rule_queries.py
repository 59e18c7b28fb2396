"""Decision rules and word classes on rows made from the driver tables; the SQL states each rule anew."""

from __future__ import annotations

import builtins
import keyword

from pyspark.sql import functions as F

from loomstone.functions import paths, text, words
from loomstone.operators import calls, cognition, decisions, govern
from loomstone.plans.registry import query
from loomstone.tables import load


def pick(names, key: str, step: int = 1):
    """One of `names` by a key column, as the SQL's `[key // step % n + 1]`."""
    return F.element_at(F.array(*(F.lit(x) for x in names)), F.expr(f"CAST({key} DIV {step} % {len(names)} + 1 AS INT)"))


def picked(names, key: str, step: int = 1) -> str:
    return "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in names) + f"][{key} // {step} % {len(names)} + 1]"


def listed(names) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(names)) + ")"


DECISIONS, ACTIONS = ("SAFE", "REVIEW", "BLOCK"), ("AUTO_APPLY", "BATCH_APPROVAL", "INDIVIDUAL_APPROVAL", "FREEZE_PATCH")


@query(f"""WITH P AS (SELECT event_id, {picked(DECISIONS, "event_id")} AS decision, {picked(ACTIONS, "event_id", 3)} AS raw FROM events)
SELECT event_id, CASE WHEN raw <> 'AUTO_APPLY' OR decision = 'SAFE' THEN raw WHEN decision = 'REVIEW' THEN 'BATCH_APPROVAL' ELSE 'INDIVIDUAL_APPROVAL' END AS action FROM P""")
def q_reconcile_action(spark, d):
    return load(spark, d, "events").select("event_id", decisions.reconcile_action(pick(DECISIONS, "event_id"), pick(ACTIONS, "event_id", 3)).alias("action"))


#: Bodies of functions, with and without a last line break.
BODIES = ("return a", "x = 1\nreturn x", "t = 0\nfor i in a:\n    t += i\nreturn t", "a\nb\nc\nd\n", "a\nb\nc\n", "x = 1\ny = 2\nz = x\nw = y\nv = z\nu = w\nreturn u", "", "x += 1", "if a == b:\n    pass")
_BODY = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BODIES)) + " END"


@query(f"""WITH B AS (SELECT p_partkey, {_BODY} AS code FROM part), L AS (SELECT *, CASE WHEN code = '' THEN 0 ELSE len(string_split(regexp_replace(code, '\n$', ''), chr(10))) END AS lines FROM B)
SELECT p_partkey, CASE WHEN lines <= 3 THEN 4 WHEN lines <= 6 THEN 2 ELSE 1 END - CASE WHEN contains(code, 'for ') THEN 3 ELSE 0 END - CASE WHEN contains(code, '+=') THEN 2 ELSE 0 END
  + CASE WHEN length(code) - length(replace(code, '=', '')) <= 1 THEN 2 ELSE 0 END AS points FROM L""")  # fmt: skip
def q_quality_points(spark, d):
    return load(spark, d, "part").select("p_partkey", text.quality_points(pick(BODIES, "p_partkey")).alias("points"))


TOKENS = (
    "match", "None", "conf.py", "index.HTML", "GET", "a.Cookie", "sqlalchemy.orm", "Flaskish", "SECRET_KEY", "AB", "json.dumps", "x.time", "len", "Foo.print", "ValueError",
    "app", "user.email", "Model.save", "thing", "verylongwordindeed", "two_words", "Klass", "klass.run", "x2", "12", "own_pkg.thing", "Request", "is", "data.csv", "ROLE",
)
OWN = ("own_pkg",)


@query(f"""WITH T AS (SELECT p_partkey, {picked(TOKENS, "p_partkey")} AS t, p_size % 2 = 0 AS role FROM part), S AS (SELECT *, string_split(t, '.')[1] AS head, string_split(t, '.')[-1] AS tail FROM T)
SELECT p_partkey, CASE WHEN tail IN {listed({*keyword.kwlist, *keyword.softkwlist, "match", "case", "type"})} OR t IN {listed({*keyword.kwlist, *keyword.softkwlist})} THEN 'keyword'
  WHEN regexp_matches(t, '(?i)^.*[.](py|html|txt|cfg|ini|toml|yaml|yml|json|rst|md|jinja2?|css|js|po|pot|mo)$') THEN 'filename'
  WHEN t IN {listed(words.HTTP_WORDS)} OR tail IN {listed(words.HTTP_WORDS)} THEN 'http'
  WHEN head IN {listed({*words.DEPENDENCY_WORDS, *OWN})} OR t IN {listed({*words.DEPENDENCY_WORDS, *OWN})} OR tail IN {listed({*words.DEPENDENCY_WORDS, *OWN})} THEN 'dependency'
  WHEN regexp_matches(t, '^[A-Z][A-Z0-9_]{{2,}}$') THEN 'config'
  WHEN tail IN {listed(words.STDLIB_WORDS)} OR head IN {listed(words.STDLIB_WORDS)} OR t IN {listed(words.STDLIB_WORDS)} THEN 'stdlib'
  WHEN tail IN {listed(dir(builtins))} THEN 'builtin' WHEN tail IN {listed(words.EXAMPLE_WORDS)} OR t IN {listed(words.EXAMPLE_WORDS)} THEN 'example'
  WHEN contains(t, '.') AND NOT role THEN 'member' WHEN NOT role AND NOT contains(t, '.') AND t = lower(t) AND t <> upper(t) AND length(t) < 14 THEN 'prose' ELSE 'api' END AS class FROM S""")  # fmt: skip
def q_doc_token(spark, d):
    return load(spark, d, "part").select("p_partkey", paths.doc_token_class(pick(TOKENS, "p_partkey"), F.col("p_size") % 2 == 0, OWN).alias("class"))


DOMAINS = ("FINANCE_SYSTEM", "Web", "ml_pipeline", "CLI_TOOL", "GAME_ENGINE", "", "ERP_SYSTEM", "data", "cli_tool")


@query(f"""WITH P AS (SELECT s_suppkey, upper({picked(DOMAINS, "s_suppkey")}) AS a, upper({picked(DOMAINS, "s_suppkey", 9)}) AS b FROM supplier),
K AS (SELECT *, a IN {listed(words.CORE_DOMAINS)} AS ac, b IN {listed(words.CORE_DOMAINS)} AS bc, a IN {listed(words.SERVING_DOMAINS)} AS asv, b IN {listed(words.SERVING_DOMAINS)} AS bsv FROM P)
SELECT s_suppkey, CASE WHEN a = b OR b = '' THEN 'NONE' WHEN (ac AND bsv) OR (bc AND asv) THEN 'RESOLVED_BY_SUBSUMPTION' ELSE 'DOMAIN_CONFLICT_DETECTED' END AS status FROM K""")  # fmt: skip
def q_subsumption(spark, d):
    return load(spark, d, "supplier").select("s_suppkey", cognition.subsumption(pick(DOMAINS, "s_suppkey"), pick(DOMAINS, "s_suppkey", 9)).alias("status"))


NAMES = ("url_for", "response_class", "append", "get", "run", "_private", "Session", "9lives", "", None, "session_class", "\u00e9t\u00e9")
PATTERNS = ("attribute_call", "parse_error", "name_call_unresolved", "attribute_call")


@query(f"""WITH P AS (SELECT p_partkey, {picked(NAMES, "p_partkey")} AS name, {picked(PATTERNS, "p_partkey", 12)} AS pattern FROM part)
SELECT p_partkey, CASE WHEN pattern = 'parse_error' THEN 'parse_error' WHEN name IS NULL OR name = '' THEN 'attribute_type_unknown' WHEN name IN {listed(words.FRAMEWORK_HELPERS)} THEN 'framework_helper'
  WHEN name IN {listed(words.CLASS_ALIASES)} THEN 'class_alias' WHEN name IN {listed(words.BUILTIN_METHODS)} THEN 'builtin_like'
  WHEN name[1] <> upper(name[1]) THEN 'name_suggests_object_method_unconfirmed' WHEN name[1] <> lower(name[1]) THEN 'name_suggests_external_class_unconfirmed' ELSE 'attribute_type_unknown' END AS cause FROM P""")  # fmt: skip
def q_unresolved_cause(spark, d):
    return load(spark, d, "part").select("p_partkey", calls.unresolved_cause(pick(NAMES, "p_partkey"), pick(PATTERNS, "p_partkey", 12)).alias("cause"))


@query("""SELECT s_suppkey, ((f > 0)::INT + (l > 0)::INT + (c > 0 OR m > 0 OR l > 0 OR t > 0)::INT + (p > 0 OR l > 0 OR f > 0)::INT) / 4 AS score
FROM (SELECT s_suppkey, s_suppkey % 2 AS f, s_suppkey // 2 % 2 AS l, s_suppkey // 4 % 2 AS c, s_suppkey // 8 % 2 AS m, s_suppkey // 16 % 2 AS t, s_suppkey // 32 % 2 AS p FROM supplier)""")  # fmt: skip
def q_discovery_score(spark, d):
    bit = lambda n: F.expr(f"s_suppkey DIV {n} % 2")
    return load(spark, d, "supplier").select("s_suppkey", cognition.discovery_score(bit(1), bit(2), bit(4), bit(8), bit(16), bit(32)).alias("score"))


TYPES = ("NLP_TOOL", "ML_PIPELINE", "CLI_TOOL", "WEB_APPLICATION", "GIS_SYSTEM", "DATA_ENGINEERING", "ERP_SYSTEM", "DATABASE_SYSTEM")
_SIGNALS = f"S AS (SELECT o_custkey AS repo, {picked(TYPES, 'o_orderkey')} AS type, (1 + o_orderkey % 3)::DOUBLE AS weight FROM orders)"


def _signals(spark, d):
    return load(spark, d, "orders").select(F.col("o_custkey").alias("repo"), pick(TYPES, "o_orderkey").alias("type"), (F.col("o_orderkey") % 3 + 1).cast("double").alias("weight"))


@query(f"""WITH RECURSIVE {_SIGNALS}, H(type, below) AS (VALUES {", ".join(f"('{k}', {list(v)})" for k, v in words.TYPE_HIERARCHY.items())}),
Q AS (SELECT repo, type, sum(weight) AS w FROM S GROUP BY 1, 2 HAVING sum(weight) >= 2),
O AS (SELECT repo, list(type ORDER BY w DESC, type) AS types, list(w ORDER BY w DESC, type) AS weights FROM Q GROUP BY 1),
R(repo, types, weights, here, i) AS (SELECT repo, types, weights, types, 1 FROM O UNION ALL
  SELECT repo, types, weights, CASE WHEN list_contains(here, types[i]) AND below IS NOT NULL THEN list_filter(here, lambda x: NOT list_contains(below, x)) ELSE here END, i + 1
  FROM R LEFT JOIN H ON H.type = types[i] WHERE i <= len(types)),
F AS (SELECT repo, here[1] AS best, len(here) AS n, weights[list_position(types, here[1])] AS w1, weights[list_position(types, here[2])] AS w2 FROM R WHERE i = len(types) + 1),
A AS (SELECT DISTINCT repo FROM S)
SELECT repo, CASE WHEN best IS NULL THEN 'UNKNOWN' WHEN n > 1 AND w2 / w1 >= 0.5 AND w1 / w2 < 1.8 THEN 'MONOREPO' ELSE best END AS type FROM A LEFT JOIN F USING (repo)""")  # fmt: skip
def q_application_types(spark, d):
    return decisions.application_types(_signals(spark, d))


@query(f"""WITH {_SIGNALS}, C AS (SELECT c_custkey AS repo, CASE WHEN c_custkey % 3 = 0 THEN 'Django' END AS framework FROM customer),
T AS (SELECT repo, max(w) AS top, sum(w) AS total FROM (SELECT repo, type, sum(weight) AS w FROM S GROUP BY 1, 2) GROUP BY 1)
SELECT repo, CASE WHEN total IS NULL THEN (framework IS NOT NULL)::INT / 2 ELSE (1 + (framework IS NOT NULL)::INT + (top / total >= 0.5 OR framework IS NOT NULL)::INT + (top >= 2)::INT) / 4 END AS score FROM C LEFT JOIN T USING (repo)""")  # fmt: skip
def q_classification_score(spark, d):
    frameworks = load(spark, d, "customer").select(F.col("c_custkey").alias("repo"), F.when(F.col("c_custkey") % 3 == 0, "Django").alias("framework"))
    return cognition.classification_score(_signals(spark, d), frameworks)


@query("""WITH P AS (SELECT c_custkey AS repo, c_custkey % 2 AS dep, c_custkey // 2 % 2 AS conf, c_custkey // 4 % 2 AS sig, c_custkey // 8 % 2 AS py, c_custkey // 16 % 2 AS ext, c_custkey // 32 % 2 AS lang,
  ['UNKNOWN', 'MONOREPO', 'CLI_TOOL'][c_custkey // 64 % 3 + 1] AS type, (c_custkey % 10) / 10 AS score FROM customer)
SELECT repo, concat_ws(',', CASE WHEN dep = 0 AND conf = 0 THEN 'no_dependency_or_config_files' END, CASE WHEN sig = 0 AND py > 0 THEN 'no_framework_signals' END, CASE WHEN type = 'MONOREPO' THEN 'several_types' END,
  CASE WHEN ext > 0 THEN 'unknown_extensions' END, CASE WHEN py = 0 AND type = 'UNKNOWN' AND lang > 0 THEN 'languages_without_classification' END, CASE WHEN score < 0.4 AND type = 'UNKNOWN' THEN 'low_classification_score' END) AS warnings FROM P""")  # fmt: skip
def q_warnings(spark, d):
    bit = lambda n: F.expr(f"c_custkey DIV {n} % 2")
    profile = load(spark, d, "customer").select(
        F.col("c_custkey").alias("repo"), bit(1).alias("dependency_files"), bit(2).alias("config_files"), bit(4).alias("signals"), bit(8).alias("python_files"), bit(16).alias("unknown_extensions"),
        bit(32).alias("languages"), pick(("UNKNOWN", "MONOREPO", "CLI_TOOL"), "c_custkey", 64).alias("type"), (F.col("c_custkey") % 10 / 10).alias("score"),
    )
    return cognition.warnings(profile).select("repo", F.concat_ws(",", "warnings").alias("warnings"))


GATES = ("APPROVED", "REVIEW_REQUIRED", "BLOCKED")


@query(f"""WITH P AS (SELECT c_custkey AS repo, {picked(GATES, "c_custkey")} AS gate, c_custkey % 101 AS misses, c_custkey // 3 % 4 AS unresolved FROM customer),
R AS (SELECT repo, 'HIGH' AS severity FROM P WHERE gate = 'REVIEW_REQUIRED' UNION ALL SELECT repo, 'MEDIUM' FROM P WHERE misses > 50 UNION ALL SELECT repo, 'LOW' FROM P WHERE unresolved > 0)
SELECT repo, severity FROM R UNION ALL SELECT repo, 'LOW' FROM P WHERE repo NOT IN (SELECT repo FROM R)""")
def q_recommendations(spark, d):
    reports = load(spark, d, "customer").select(F.col("c_custkey").alias("repo"), pick(GATES, "c_custkey").alias("gate"), (F.col("c_custkey") % 101).alias("in_repo_misses"), F.expr("c_custkey DIV 3 % 4").alias("unresolved"))
    return cognition.recommendations(reports).select("repo", "severity")


STATES, ENGINES = ("COMPLETE", "REVIEW_REQUIRED", "BLOCKED", "M2_ERROR", "DONE", None), (None, "ENGINE_ERROR", "READY")
_REPORTS = f"""P AS (SELECT o_orderkey AS repo, CASE WHEN o_orderkey % 29 = 0 THEN 'boom' END AS error, {picked(STATES, "o_orderkey")} AS status, {picked(GATES, "o_orderkey", 6)} AS gate,
  CASE WHEN o_orderkey // 2 % 3 = 0 THEN 'told' END AS reason, CASE WHEN o_orderkey // 5 % 2 = 0 THEN o_orderkey // 10 % 3 END AS guesses, o_orderkey % 4 AS base, o_orderkey // 4 % 2 AS added,
  CASE WHEN o_orderkey // 7 % 3 > 0 THEN o_orderkey % 5 END AS total, {picked(ENGINES, "o_orderkey", 11)} AS engine, o_orderkey // 13 % 2 AS caps FROM orders)"""


@query(f"""WITH {_REPORTS}, F AS (SELECT repo, unnest([CASE WHEN error IS NOT NULL THEN 'pipeline error' END, CASE WHEN error IS NULL AND (status IS NULL OR status = 'DONE') THEN 'unknown status' END,
  CASE WHEN error IS NULL AND status IS DISTINCT FROM 'COMPLETE' AND coalesce(total, 0) > 0 THEN 'edges without completion' END, CASE WHEN error IS NULL AND status = 'COMPLETE' AND guesses <> 0 THEN 'guesses' END,
  CASE WHEN error IS NULL AND status = 'COMPLETE' AND guesses IS NOT NULL AND total <> base + added THEN 'edge provenance' END, CASE WHEN error IS NULL AND status = 'COMPLETE' AND engine = 'ENGINE_ERROR' AND caps > 0 THEN 'capabilities of a failed engine' END,
  CASE WHEN error IS NULL AND status = 'REVIEW_REQUIRED' AND gate <> 'REVIEW_REQUIRED' THEN 'review without its gate' END, CASE WHEN error IS NULL AND status = 'BLOCKED' AND reason IS NULL THEN 'block without a reason' END]) AS failure FROM P)
SELECT repo, failure FROM F WHERE failure IS NOT NULL""")  # fmt: skip
def q_invariants(spark, d):
    k = lambda n, m: F.expr(f"o_orderkey DIV {n} % {m}")
    reports = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("repo"), F.when(k(1, 29) == 0, "boom").alias("error"), pick(STATES, "o_orderkey").alias("status"), pick(GATES, "o_orderkey", 6).alias("gate"), F.when(k(2, 3) == 0, "told").alias("reason"),
        F.when(k(5, 2) == 0, k(10, 3)).alias("guesses"), k(1, 4).alias("base_edges"), k(4, 2).alias("added_edges"), F.when(k(7, 3) > 0, k(1, 5)).alias("total_edges"), pick(ENGINES, "o_orderkey", 11).alias("engine_status"), k(13, 2).alias("capabilities"),
    )
    return govern.invariant_violations(reports)


KINDS = (*words.PATCH_SCORES, "something else")
_HAS = " OR ".join(f"(list_contains(ta, '{x}') AND list_contains(tb, '{y}')) OR (list_contains(ta, '{y}') AND list_contains(tb, '{x}'))" for x, y in words.OPPOSING)
TAG_SETS = ("", "BACKUP_OPERATION", "DELETE_OPERATION", "FILE_WRITE,STATE_MUTATION", "FILE_READ", "AUTH_OPERATION,FILE_READ")


@query(f"""WITH G AS (SELECT s_suppkey AS owner, list_filter(string_split({picked(TAG_SETS, "s_suppkey")}, ','), lambda x: x <> '') AS tags FROM supplier WHERE s_suppkey % 7 <> 0),
B AS (SELECT *, CASE WHEN list_has_any(tags, {list(words.HIGH_IMPACT)}) THEN 'HIGH' WHEN len(tags) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM G),
P AS (SELECT s.s_suppkey AS left_id, s.s_suppkey + 1 AS right_id, s.s_suppkey % 3 AS sem, coalesce(a.tags, []) AS ta, coalesce(b.tags, []) AS tb, coalesce(a.risk, 'LOW') AS ra, coalesce(b.risk, 'LOW') AS rb,
  (a.owner IS NULL)::INT + (b.owner IS NULL)::INT AS missing, {picked(KINDS, "s.s_suppkey")} AS kind FROM supplier s LEFT JOIN B a ON a.owner = s.s_suppkey LEFT JOIN B b ON b.owner = s.s_suppkey + 1),
Q AS (SELECT *, CASE sem WHEN 2 THEN 100 ELSE 25 END AS semantic, list_distinct(list_concat(ta, tb)) AS al, list_intersect(ta, tb) AS sh, {_HAS} AS opp,
  greatest(CASE ra WHEN 'HIGH' THEN 100 WHEN 'MEDIUM' THEN 50 ELSE 0 END, CASE rb WHEN 'HIGH' THEN 100 WHEN 'MEDIUM' THEN 50 ELSE 0 END) AS base FROM P),
H AS (SELECT *, list_has_any(al, {list(words.HIGH_IMPACT)}) AS hi FROM Q),
S AS (SELECT *, (semantic * 4 + 6 * CASE WHEN len(al) = 0 THEN least(base, 20) WHEN hi THEN greatest(base, 60) ELSE base END) // 10 AS raw FROM H),
D AS (SELECT *, CASE WHEN opp THEN greatest(raw, 90) ELSE raw END AS s, CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in words.PATCH_SCORES.items())} ELSE 50 END AS patch FROM S),
E AS (SELECT *, CASE WHEN opp OR (sem = 2 AND len(sh) = 0) THEN 'BLOCK' WHEN hi THEN CASE WHEN s >= 80 THEN 'BLOCK' ELSE 'REVIEW' END WHEN s >= 80 THEN 'BLOCK' WHEN s >= 25 THEN 'REVIEW' ELSE 'SAFE' END AS decision,
  CASE WHEN patch >= 80 THEN 'FREEZE_PATCH' WHEN patch >= 60 THEN 'INDIVIDUAL_APPROVAL' WHEN patch >= 30 THEN 'BATCH_APPROVAL' ELSE 'AUTO_APPLY' END AS raw_action FROM D)
SELECT left_id, right_id, decision, s::INT AS fusion_score, missing, CASE WHEN raw_action <> 'AUTO_APPLY' OR decision = 'SAFE' THEN raw_action WHEN decision = 'REVIEW' THEN 'BATCH_APPROVAL' ELSE 'INDIVIDUAL_APPROVAL' END AS action FROM E""")  # fmt: skip
def q_pair_actions(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey")
    tags = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("owner"), F.filter(F.split(pick(TAG_SETS, "s_suppkey"), ","), lambda x: x != "").alias("tags"))
    tags = tags.withColumn("risk", decisions.tag_risk(F.col("tags")))
    third = F.col("s_suppkey") % 3
    pairs = s.select(F.col("s_suppkey").alias("left_id"), (F.col("s_suppkey") + 1).alias("right_id"), F.lit(0.7499).alias("semantic_score"), F.when(third == 0, "SAFE").when(third == 1, "REVIEW").otherwise("BLOCK").alias("semantic_decision"), pick(KINDS, "s_suppkey").alias("kind"))
    out = decisions.pair_actions(pairs, tags)
    return out.select("left_id", "right_id", F.col("fusion_decision").alias("decision"), "fusion_score", F.size("missing").alias("missing"), "action")
