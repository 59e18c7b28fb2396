"""Decisions, scores and text measures on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import paths, text, words
from loomstone.operators import decisions, govern, joins
from loomstone.plans.registry import query
from loomstone.tables import load

BAND = "CASE WHEN s >= 80 THEN '{3}' WHEN s >= 60 THEN '{2}' WHEN s >= 30 THEN '{1}' ELSE '{0}' END"
LABEL, ACTION = (BAND.format(*(b[i] for b in words.BANDS)) for i in (1, 2))
SCORES = "S AS (SELECT l_orderkey, l_linenumber, greatest(0, least(100, (l_quantity * 3 - 10)::INT)) AS s FROM lineitem)"


@query(f"WITH {SCORES} SELECT l_orderkey, l_linenumber, s AS score, {LABEL} AS label, {ACTION} AS action FROM S")
def q_risk_band(spark, d):
    s = (F.col("l_quantity") * 3 - 10).cast("int")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", decisions.clamp(s).alias("score"), decisions.band(s, 1).alias("label"), decisions.band(s, 2).alias("action"))


@query(f"WITH {SCORES} SELECT {LABEL} AS label, count(*) AS n, sum(s)::BIGINT AS total FROM S GROUP BY 1")
def q_band_range_join(spark, d):
    s = load(spark, d, "lineitem").select(decisions.clamp((F.col("l_quantity") * 3 - 10).cast("int")).alias("s"))
    bands = decisions.band_table(spark)  # four rows
    return s.join(F.broadcast(bands), F.col("s").between(F.col("low"), F.col("high"))).groupBy("label").agg(F.count("*").alias("n"), F.sum("s").alias("total"))


@query("SELECT p_partkey, count(l_partkey) AS uses, CASE WHEN count(l_partkey) = 0 THEN 'Low' WHEN count(l_partkey) <= 3 THEN 'Medium' WHEN count(l_partkey) <= 7 THEN 'High' ELSE 'Critical' END AS level, count(DISTINCT l_orderkey) AS dependents FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def q_degree_class(spark, d):
    uses = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("uses"), F.countDistinct("l_orderkey").alias("dependents"))
    parts = load(spark, d, "part").select("p_partkey").join(uses, F.col("p_partkey") == F.col("l_partkey"), "left")
    uses = F.coalesce("uses", F.lit(0))
    return parts.select("p_partkey", uses.alias("uses"), decisions.usage_level(uses).alias("level"), F.coalesce("dependents", F.lit(0)).alias("dependents"))


@query("""WITH O AS (SELECT o_custkey, count(*) AS orders, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1),
P AS (SELECT c_custkey, CASE WHEN coalesce(orders, 0) = 0 THEN 0 WHEN orders <= 2 THEN 1 ELSE 2 END + CASE WHEN coalesce(kinds, 0) >= 3 THEN 2 ELSE 0 END
  + CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END + CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN c_acctbal < 0 THEN 2 ELSE 0 END AS points FROM customer LEFT JOIN O ON o_custkey = c_custkey)
SELECT c_custkey, points, CASE WHEN points = 0 THEN 'Low' WHEN points <= 2 THEN 'Medium' ELSE 'High' END AS risk FROM P""")  # fmt: skip
def q_risk_points(spark, d):
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.countDistinct("o_orderpriority").alias("kinds"))
    c = load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    told = decisions.risk_summary(F.coalesce("orders", F.lit(0)), F.coalesce("kinds", F.lit(0)), F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") % 5 == 0, F.col("c_acctbal") >= 0)
    return c.select("c_custkey", told["points"].alias("points"), told["risk"].alias("risk"))


#: Event types as behaviour calls.
EVENT_CALLS = {"click": "store.append", "purchase": "db.commit", "error": "os.remove", "signup": "auth.login", "view": "noop"}
_CALLS = "CASE event_type WHEN 'click' THEN 'append' WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'login' ELSE 'noop' END"
_DICT = "D(call, tag) AS (VALUES " + ", ".join(f"('{c}', '{t}')" for t, cs in words.BEHAVIOUR_CALLS.items() for c in cs.split()) + ")"
_TAGS = f"""{_DICT}, T AS (SELECT user_id * 31 + day(ts) AS owner, {_CALLS} AS call FROM events),
G AS (SELECT owner, coalesce(list_sort(list(DISTINCT tag) FILTER (tag IS NOT NULL)), []) AS tags FROM T LEFT JOIN D USING (call) GROUP BY 1),
B AS (SELECT owner, tags, CASE WHEN list_has_any(tags, {list(words.HIGH_IMPACT)}) THEN 'HIGH' WHEN len(tags) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM G)"""


def _user_tags(spark, d):
    call = F.lit("noop")
    for k, v in EVENT_CALLS.items():
        call = F.when(F.col("event_type") == k, v).otherwise(call)
    calls = load(spark, d, "events").select((F.col("user_id") * 31 + F.dayofmonth("ts")).alias("owner"), call.alias("call"))
    return decisions.behaviour_tags(calls)


@query(f"WITH {_TAGS} SELECT owner, array_to_string(tags, ',') AS tags, risk FROM B")
def q_behaviour_tags(spark, d):
    return _user_tags(spark, d).select("owner", F.concat_ws(",", "tags").alias("tags"), "risk")


@query(f"""WITH {_TAGS}, P AS (SELECT a.owner, a.tags AS ta, b.tags AS tb, a.risk AS ra, b.risk AS rb, (a.owner * 7) % 101 AS pct, CASE (a.owner % 3) WHEN 0 THEN 'SAFE' WHEN 1 THEN 'REVIEW' ELSE 'BLOCK' END AS sem
  FROM B a JOIN B b ON b.owner = a.owner + 1),
Q AS (SELECT *, CASE WHEN sem = 'BLOCK' THEN 100 ELSE 100 - pct END AS semantic, list_distinct(list_concat(ta, tb)) AS al, list_intersect(ta, tb) AS sh,
  greatest(CASE ra WHEN 'HIGH' THEN 100 WHEN 'MEDIUM' THEN 50 ELSE 0 END, CASE rb WHEN 'HIGH' THEN 100 WHEN 'MEDIUM' THEN 50 ELSE 0 END) AS base,
  {" OR ".join(f"(list_contains(ta, '{x}') AND list_contains(tb, '{y}')) OR (list_contains(ta, '{y}') AND list_contains(tb, '{x}'))" for x, y in words.OPPOSING)} AS opp FROM P),
H AS (SELECT *, list_has_any(al, {list(words.HIGH_IMPACT)}) AS hi FROM Q),
F0 AS (SELECT *, semantic * 4 + 6 * CASE WHEN len(al) = 0 THEN least(base, 20) WHEN hi THEN greatest(base, 60) ELSE base END AS tenths FROM H),
F1 AS (SELECT *, CASE WHEN tenths % 10 = 5 THEN CASE WHEN (tenths // 10) % 2 = 0 THEN tenths // 10 ELSE tenths // 10 + 1 END ELSE (tenths + 5) // 10 END AS raw FROM F0),
F2 AS (SELECT *, CASE WHEN opp THEN greatest(raw, 90) ELSE raw END AS s FROM F1)
SELECT owner, s::INT AS fusion_score,
  CASE WHEN opp OR (sem = 'BLOCK' AND len(sh) = 0) THEN 'BLOCK' WHEN hi THEN CASE WHEN s >= 80 THEN 'BLOCK' ELSE 'REVIEW' END WHEN s >= 80 THEN 'BLOCK' WHEN s >= 25 THEN 'REVIEW' ELSE 'SAFE' END AS fusion_decision,
  CASE WHEN opp THEN 'CRITICAL' WHEN hi OR (sem = 'BLOCK' AND len(sh) = 0) THEN CASE WHEN s >= 80 THEN 'CRITICAL' WHEN s >= 60 THEN 'HIGH' WHEN s >= 30 THEN 'MEDIUM' ELSE 'LOW' END
    WHEN s >= 80 THEN 'CRITICAL' WHEN s >= 50 THEN 'HIGH' WHEN s >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS fusion_level,
  opp AS opposing FROM F2""")  # fmt: skip
def q_fusion(spark, d):
    a = _user_tags(spark, d)
    b = a.select((F.col("owner") - 1).alias("owner"), F.col("tags").alias("tags_b"), F.col("risk").alias("risk_b"))
    pairs = a.select("owner", F.col("tags").alias("tags_a"), F.col("risk").alias("risk_a")).join(b, "owner")
    pct = (F.col("owner") * 7) % 101
    third = F.col("owner") % 3
    # a quarter of a thousandth keeps the cut to whole points clear of binary fractions
    pairs = pairs.withColumns({"semantic_score": (pct - 0.00025) / 100.0, "semantic_decision": F.when(third == 0, "SAFE").when(third == 1, "REVIEW").otherwise("BLOCK")})
    return decisions.fuse(pairs).select("owner", "fusion_score", "fusion_decision", "fusion_level", "opposing")


_COS = "(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"


@query(f"""WITH P AS (SELECT a.vec_id, {_COS} AS emb, a.label = b.label AS dom, a.vec_id % 2 = 0 AS eff, (a.vec_id % 10) / 10.0 AS lex FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
C AS (SELECT *, lex * 0.2 + emb * 0.5 + CASE WHEN dom THEN 0.2 ELSE 0 END + CASE WHEN eff THEN 0.1 ELSE 0 END AS conf FROM P)
SELECT vec_id, CASE WHEN round(conf, 2) >= 0.8 AND NOT eff THEN 'SAFE' WHEN emb >= 0.8 OR round(conf, 2) >= 0.5 OR (dom AND NOT eff AND emb >= 0.35) THEN 'REVIEW' ELSE 'BLOCK' END AS decision FROM C""")  # fmt: skip
def q_semantic(spark, d):
    a = load(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    pair = a.join(b, "vec_id").withColumn("emb", text.cosine(F.col("embedding"), F.col("other")))
    out = decisions.semantic_decision((F.col("vec_id") % 10) / 10.0, F.col("emb"), F.col("label") == F.col("other_label"), F.col("vec_id") % 2 == 0)
    return pair.select("vec_id", out["decision"].alias("decision"))


@query(f"""WITH R AS (SELECT a.vec_id, b.vec_id AS other_id, round({_COS}, 6) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rn
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT vec_id, other_id, cosine FROM R WHERE rn <= 3""")  # fmt: skip
def q_cosine_topk(spark, d):
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    asked = load(spark, d, "embeddings").where("vec_id % 100 = 0").select("vec_id", "embedding")
    near = joins.nearest_vectors(asked, rows, 3, ("vec_id", "embedding"), ("other_id", "other"), 6)
    return near.withColumnRenamed("score", "cosine")


@query("""WITH F AS (SELECT event_type, CASE event_type WHEN 'error' THEN 'BLOCK' WHEN 'purchase' THEN 'REVIEW' ELSE 'INFO' END AS severity, user_id FROM events)
SELECT event_type AS "check", severity, count(*) AS n, count(DISTINCT user_id) AS files FROM F GROUP BY GROUPING SETS ((event_type), (severity), ())""")  # fmt: skip
def q_findings_rollup(spark, d):
    severity = F.when(F.col("event_type") == "error", "BLOCK").when(F.col("event_type") == "purchase", "REVIEW").otherwise("INFO")
    return govern.roll_up(load(spark, d, "events").select(F.col("event_type").alias("check"), severity.alias("severity"), F.col("user_id").alias("file")))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'REJECTED' WHEN 'purchase' THEN 'PENDING_REVIEW' ELSE 'APPROVED' END AS decision FROM events""")
def q_approval(spark, d):
    severity = F.when(F.col("event_type") == "error", "BLOCK").when(F.col("event_type") == "purchase", "REVIEW").otherwise("INFO")
    return load(spark, d, "events").select("event_id", decisions.approval(severity).alias("decision"))


_TOK = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN (" + ", ".join(f"'{w}'" for w in words.STOP_WORDS) + "))"


@query(f"""WITH P AS (SELECT a.p_partkey, list_distinct({_TOK.format("a.p_name || ' ' || a.p_type")}) AS x, list_distinct({_TOK.format("b.p_name || ' ' || b.p_type")}) AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / greatest(len(x), len(y)) END AS overlap FROM P""")  # fmt: skip
def q_lexical(spark, d):
    p = load(spark, d, "part").select("p_partkey", text.word_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("x"))
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    return p.join(other, "p_partkey").select("p_partkey", text.overlap(F.col("x"), F.col("y")).alias("overlap"))


@query(f"""WITH T AS (SELECT DISTINCT p_brand, p_partkey, unnest({_TOK.format("p_name")}) AS t FROM part),
P AS (SELECT DISTINCT a.p_brand AS brand, a.p_partkey AS left_id, b.p_partkey AS right_id FROM T a JOIN T b ON a.p_brand = b.p_brand AND a.t = b.t AND a.p_partkey < b.p_partkey)
SELECT * FROM P""")  # fmt: skip
def q_token_pairs(spark, d):
    from loomstone.operators.duplicates import token_pairs

    parts = load(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), text.word_tokens(F.col("p_name")).alias("tokens"))
    return token_pairs(parts, "brand", "id", "tokens")


@query("SELECT p_partkey, array_to_string(list_filter(string_split(lower(regexp_replace(replace(p_type, ' ', '') || '_' || p_brand, '([a-z])([A-Z])', '\\1_\\2', 'g')), '_'), lambda t: t <> ''), ' ') AS tokens FROM part")
def q_name_tokens(spark, d):
    name = F.concat_ws("_", F.replace("p_type", F.lit(" "), F.lit("")), "p_brand")
    return load(spark, d, "part").select("p_partkey", F.concat_ws(" ", text.name_tokens(name)).alias("tokens"))


PATH_HEADS = ("docs/", "src/Docs/conf", "pkg/", "tests/", "src/testing/", "a/examples/b/", "scripts/", "pkg\\\\cli\\\\", "", "Sphinx/", "lib/contest/", "doc/")
PATH_TAILS = ("a.py", "conf.py", "setup.py", "my_shim.py", "conftest.py", "__main__.py", "build.py/x", "test_a.py", "rebuild.py")
_PATHS = f"""P AS (SELECT p_partkey, replace({list(PATH_HEADS)}[p_partkey % {len(PATH_HEADS)} + 1] || {list(PATH_TAILS)}[p_partkey % {len(PATH_TAILS)} + 1], '\\', '/') AS path FROM part)"""


@query(f"""WITH {_PATHS} SELECT p_partkey, CASE WHEN regexp_matches(path, '(?i)(^|/)(conf[.]py$|docs?/conf|sphinx|mkdocs)') THEN 'doc_tooling'
  WHEN regexp_matches(path, '(?i)(^|/)(benchmarks?|prerelease|release|setup|build|[a-z0-9_]*_shim|[a-z0-9_]*_check|[a-z0-9_]*_standalone[a-z0-9_]*|conftest)[.]py$') THEN 'tooling'
  WHEN regexp_matches(path, '(?i)(^|/)(tests?|testing|conftest[.]py$)(/|$)') THEN 'test' WHEN regexp_matches(path, '(?i)(^|/)(examples?|tutorials?|samples?|demos?|docs?|doc)/') THEN 'example'
  WHEN regexp_matches(path, '(?i)(^|/)(cli|__main__[.]py$|scripts?)(/|$)') THEN 'cli' ELSE 'production' END AS category FROM P""")  # fmt: skip
def q_path_category(spark, d):
    pick = lambda names: F.element_at(F.array(*(F.lit(x.replace("\\\\", "\\")) for x in names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", paths.path_class(F.concat(pick(PATH_HEADS), pick(PATH_TAILS))).alias("category"))


@query("""WITH P AS (SELECT c_custkey, string_split('mod.' || lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.Seg' END || '.run' || c_nationkey, '.') AS p FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN array_to_string(p[1:len(p) - 1], '.') ELSE array_to_string(p[1:len(p) - 2], '.') END AS module, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Seg' END AS class, p[-1] AS name FROM P""")  # fmt: skip
def q_split_id(spark, d):
    from loomstone.operators.graph import split_id

    c = load(spark, d, "customer")
    name = F.concat(F.lit("mod."), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(".Seg"), F.lit(".run"), F.col("c_nationkey"))
    return c.select("c_custkey", name.alias("node")).withColumn("at", split_id()).select("c_custkey", "at.module", "at.class", "at.name")


@query("""SELECT page_id, CASE WHEN NOT (contains(u, '/tests/') OR contains(u, 'run_uat') OR contains(u, 'uat_test') OR contains(u, '_rev') OR contains(u, '/test_') OR contains(u, '_test.py') OR contains(u, 'mock')
  OR contains(u, 'sandbox') OR contains(u, 'temp') OR contains(u, '__pycache__') OR contains(u, '.venv') OR contains(u, '.git')) THEN true ELSE false END AS production FROM (SELECT page_id, lower(url) AS u FROM pages)""")  # fmt: skip
def q_production(spark, d):
    return load(spark, d, "pages").select("page_id", paths.is_production(F.col("url")).alias("production"))


_CODE = "'x = f' || p_size % 7 || '(g' || p_partkey % 5 || '.run(1)) + (h) ' || lower(p_type) || ' (z) _k' || p_size || '()'"


@query(f"""WITH W AS (SELECT p_partkey, unnest(regexp_extract_all({_CODE}, '\\b(\\w+)\\(', 1)) AS name FROM part) SELECT name, count(*) AS uses, count(DISTINCT p_partkey) AS owners FROM W GROUP BY 1""")
def q_call_count(spark, d):
    code = F.concat(F.lit("x = f"), F.col("p_size") % 7, F.lit("(g"), F.col("p_partkey") % 5, F.lit(".run(1)) + (h) "), F.lower("p_type"), F.lit(" (z) _k"), "p_size", F.lit("()"))
    names = load(spark, d, "part").select("p_partkey", F.explode(text.call_counts(code)).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("uses"), F.countDistinct("p_partkey").alias("owners"))


_MINED = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", "licence": "(MIT|BSD|Apache|CC BY)", "digits": "[0-9]{8,}", "token": "token = "}


@query("WITH M AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS pattern, len(regexp_extract_all(text, '{p}')) AS hits FROM documents" for k, p in _MINED.items()) + ") SELECT doc_id, pattern, hits FROM M WHERE hits > 0")
def q_pattern_mine(spark, d):
    hits = F.array(*(F.struct(F.lit(k).alias("pattern"), F.regexp_count("text", F.lit(p)).cast("long").alias("hits")) for k, p in _MINED.items()))
    return load(spark, d, "documents").select("doc_id", F.inline(hits)).where("hits > 0")


_EFFECTS = "T AS (SELECT doc_id, lower(coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN ' db.restore(1) ' WHEN 1 THEN ' save and verify ' WHEN 2 THEN ' write rollback ' ELSE '' END) AS t FROM documents)"


@query(f"""WITH {_EFFECTS} SELECT doc_id, contains(t, '.restore(') OR contains(t, '.rollback(') OR contains(t, 'backup') OR (regexp_matches(t, 'write|save') AND regexp_matches(t, 'rollback|restore|recover')) AS recovers,
  contains(t, 'commit') AS commits, contains(t, 'send') OR contains(t, 'email') AS notifies, regexp_matches(t, 'write|save') AS stores, regexp_matches(t, 'write|save') AND regexp_matches(t, 'authenticate|authorize|verify') AS secures FROM T""")  # fmt: skip
def q_side_effects(spark, d):
    third = F.col("doc_id") % 6
    more = F.when(third == 0, " db.restore(1) ").when(third == 1, " save and verify ").when(third == 2, " write rollback ").otherwise("")
    docs = load(spark, d, "documents").select("doc_id", text.side_effects(F.concat(F.coalesce("text", F.lit("")), more)).alias("effects"))
    has = lambda e: F.array_contains("effects", e)
    return docs.select("doc_id", has("system_recovery").alias("recovers"), has("database_commit").alias("commits"), has("notification_dispatch").alias("notifies"), has("persistent_storage").alias("stores"), has("security_validation").alias("secures"))
