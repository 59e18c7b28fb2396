"""Joins, logs, profile and lineage on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.operators import cognition, decisions, govern, graph, joins, lineage, logs, profile, resolution
from loomstone.plans.edges import part_count
from loomstone.plans.registry import query
from loomstone.tables import load


@query("""WITH L AS (SELECT l_suppkey AS via, p_brand AS src, o_orderpriority || l_returnflag AS dst FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
F AS (SELECT DISTINCT a.via, a.src, b.dst FROM (SELECT DISTINCT via, src FROM L) a JOIN (SELECT DISTINCT via, dst FROM L) b USING (via)) SELECT src, dst, count(*) AS ways FROM F GROUP BY 1, 2""")  # fmt: skip
def q_flow(spark, d):
    li = load(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_returnflag")
    reads = li.join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("object"), F.col("p_brand").alias("name")).distinct()
    writes = li.join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("object"), F.concat("o_orderpriority", "l_returnflag").alias("name")).distinct()
    return lineage.data_flows(reads, writes).groupBy("src", "dst").agg(F.count("*").alias("ways"))


_UP = """WITH RECURSIVE N AS (SELECT count(*) AS n FROM part), K AS (SELECT DISTINCT p_partkey % n AS src, n FROM part, N), E AS (SELECT src, (src * 3 + 1) % n AS dst FROM K WHERE src <> (src * 3 + 1) % n), R(node, depth) AS (SELECT 25::BIGINT, 0 UNION SELECT E.{a}, depth + 1 FROM E JOIN R ON E.{b} = R.node WHERE depth < 10)
SELECT DISTINCT node FROM R WHERE node <> 25"""


def _chain(spark, d):
    n = part_count(spark, d)
    k = load(spark, d, "part").select((F.col("p_partkey") % n).alias("src")).distinct()
    return k.select("src", ((F.col("src") * 3 + 1) % n).alias("dst")).where("src <> dst")


@query(_UP.format(a="src", b="dst"))
def q_upstream(spark, d):
    return lineage.upstream_of(_chain(spark, d), 25)


@query(_UP.format(a="dst", b="src"))
def q_impact_of_table(spark, d):
    return lineage.impact_of_table(_chain(spark, d), 25)


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_dup_exact(spark, d):
    docs = logs.snapshot(load(spark, d, "documents"), "doc_id", "text")
    return docs.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("path").alias("first_id")).where("copies > 1")


@query("""WITH D AS (SELECT doc_id, lang, source, length(text) AS n, floor(ln(greatest(length(text), 1)) / ln(1 / 0.6))::INT AS b FROM documents)
SELECT a.lang, count(*) AS pairs FROM D a JOIN D b ON a.lang = b.lang AND a.source = b.source AND abs(a.b - b.b) <= 1 AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) - 1e-9 GROUP BY 1""")  # fmt: skip
def q_dup_block(spark, d):
    from loomstone.operators.duplicates import candidate_pairs

    f = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("f").alias("file"), F.col("doc_id").cast("string").alias("name"), F.col("doc_id").alias("start_line"), F.col("text").alias("normalised"), F.array("lang", "source").alias("operators"), "lang")
    return candidate_pairs(f).groupBy(F.col("a_lang").alias("lang")).agg(F.count("*").alias("pairs"))


@query("""WITH D AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents), N AS (SELECT doc_id, count(*) AS n FROM D GROUP BY 1),
P AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, count(*) AS n FROM D a JOIN D b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT left_id, right_id, P.n / greatest(x.n, y.n) AS overlap FROM P JOIN N x ON x.doc_id = left_id JOIN N y ON y.doc_id = right_id WHERE P.n >= 0.8 * greatest(x.n, y.n)""")  # fmt: skip
def q_near_dup(spark, d):
    from loomstone.operators.duplicates import overlapping_sets

    docs = load(spark, d, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ", -1)).alias("w"))
    return overlapping_sets(docs, "doc_id", "w", 0.8)


@query("""WITH S AS (SELECT item_id, list_slice(string_split(text, ' '), i, i + 5) AS g FROM (SELECT item_id, text, unnest(range(1, len(string_split(text, ' ')) - 4)) AS i FROM benchmark)),
T AS (SELECT doc_id, list_slice(w, i, i + 5) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))
SELECT DISTINCT T.doc_id, S.item_id FROM T JOIN S USING (g)""")  # fmt: skip
def q_contamination(spark, d):
    def grams(df, key):
        w = df.select(key, F.split("text", " ", -1).alias("w")).where(F.size("w") >= 6)
        return w.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 5), lambda i: F.array_join(F.slice("w", i, 6), " "))).alias("g"))

    return joins.shared_items(grams(load(spark, d, "documents"), "doc_id"), grams(load(spark, d, "benchmark"), "item_id"), "g").select("doc_id", "item_id")


@query("""WITH L AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
R AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, no) AS rn FROM L WHERE length(line) >= 30) SELECT doc_id, count(*) AS first_lines FROM R WHERE rn = 1 GROUP BY 1""")  # fmt: skip
def q_line_dedupe(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where(F.length("line") >= 30)
    return joins.first_match(lines, ["line"], ["doc_id", "no"]).groupBy("doc_id").agg(F.count("*").alias("first_lines"))


_HOST = "string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')"


@query(f"""WITH P AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/'), lambda x: x <> '') AS p, ends_with(url, '/') AS slash FROM pages),
K AS (SELECT ['en'] AS k UNION ALL SELECT ['fr'] UNION ALL SELECT DISTINCT p[1:2] FROM P WHERE slash)
SELECT page_id, array_to_string(max_by(k, len(k)), '/') AS prefix FROM P JOIN K ON p[1:len(k)] = k GROUP BY 1""")  # fmt: skip
def q_prefix_match(spark, d):
    parts = F.filter(F.split(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1), "/"), lambda x: x != "")
    p = load(spark, d, "pages").select("page_id", parts.alias("p"), F.col("url").endswith("/").alias("slash"))
    known = p.where("slash").select(F.slice("p", 1, 2).alias("k")).union(spark.sql("SELECT array('en') UNION ALL SELECT array('fr')"))
    return joins.longest_prefix(p.drop("slash"), "p", known, "k").select("page_id", F.concat_ws("/", "prefix").alias("prefix"))


@query(f"""WITH P AS (SELECT page_id, list_reverse({_HOST}) AS p, ends_with(url, '/') AS slash FROM pages), K AS (SELECT ['com'] AS k UNION ALL SELECT ['com', 'example'] UNION ALL SELECT ['net', 'example'] UNION ALL SELECT DISTINCT p[1:3] FROM P WHERE slash)
SELECT page_id, array_to_string(list_reverse(max_by(k, len(k))), '.') AS suffix FROM P JOIN K ON p[1:len(k)] = k GROUP BY 1""")  # fmt: skip
def q_suffix_match(spark, d):
    p = load(spark, d, "pages").select("page_id", F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\.").alias("p"), F.col("url").endswith("/").alias("slash"))
    known = p.where("slash").select(F.reverse(F.slice(F.reverse("p"), 1, 3)).alias("k")).union(spark.sql("SELECT array('com') UNION ALL SELECT array('example', 'com') UNION ALL SELECT array('example', 'net')"))
    return joins.longest_suffix(p.drop("slash"), "p", known, "k").select("page_id", F.concat_ws(".", "suffix").alias("suffix"))


@query("""WITH E AS (SELECT * FROM events WHERE event_type = 'error'), P AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT E.event_id, P.value AS last_purchase FROM E ASOF LEFT JOIN P ON E.user_id = P.user_id AND E.ts >= P.ts""")  # fmt: skip
def q_asof_type(spark, d):
    ev = load(spark, d, "events")
    bought = ev.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(ev.where("event_type = 'error'"), bought, ["user_id"], ["ts"], "value", "last_purchase").select("event_id", "last_purchase")


@query("SELECT user_id * 100 + day(ts) AS grp, min(event_type) AS event_type FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 1")
def q_agree(spark, d):
    ev = load(spark, d, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("grp"), "event_type")
    return joins.agreeing(ev, ["grp"], "event_type")


@query("""WITH V AS (SELECT source, lang, count(*) AS votes FROM documents GROUP BY 1, 2), R AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY votes DESC) AS r, sum(votes) OVER (PARTITION BY source) AS total FROM V)
SELECT source, min(lang) AS lang, min(votes) AS votes, (min(votes) / min(total))::DOUBLE AS share FROM R WHERE r = 1 GROUP BY 1 HAVING count(*) = 1 AND min(votes) / min(total) >= 0.5""")  # fmt: skip
def q_dominant(spark, d):
    return profile.dominant(load(spark, d, "documents"), ["source"], "lang", 0.5)


@query("""WITH S AS (SELECT CASE source WHEN 'src0' THEN 'NLP_TOOL' WHEN 'src1' THEN 'ML_PIPELINE' WHEN 'src2' THEN 'CLI_TOOL' ELSE 'WEB_APPLICATION' END AS type, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS weight FROM documents),
G AS (SELECT type, sum(weight)::BIGINT AS weight FROM S GROUP BY 1 HAVING sum(weight) >= 2) SELECT type, weight, rank() OVER (ORDER BY weight DESC, type) AS place FROM G""")  # fmt: skip
def q_signals(spark, d):
    kinds = F.when(F.col("source") == "src0", "NLP_TOOL").when(F.col("source") == "src1", "ML_PIPELINE").when(F.col("source") == "src2", "CLI_TOOL").otherwise("WEB_APPLICATION")
    docs = load(spark, d, "documents")
    g = docs.groupBy(kinds.alias("type")).agg(F.sum(F.when(F.col("lang") == "en", 2).otherwise(1)).alias("weight")).where("weight >= 2")
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("weight"), "type")).cast("long"))  # a row per type


@query("""WITH A AS (SELECT user_id, sha256(string_agg(event_type, ',' ORDER BY event_id)) AS h FROM events WHERE day(ts) <= 15 GROUP BY 1), B AS (SELECT user_id, sha256(string_agg(event_type, ',' ORDER BY event_id)) AS h FROM events WHERE day(ts) > 15 GROUP BY 1)
SELECT coalesce(A.user_id, B.user_id) AS path, CASE WHEN B.h IS NULL THEN 'deleted' WHEN A.h IS NULL OR A.h <> B.h THEN 'changed' ELSE 'unchanged' END AS change FROM A FULL JOIN B ON A.user_id = B.user_id""")  # fmt: skip
def q_snapshot_diff(spark, d):
    ev = load(spark, d, "events").withColumn("late", F.dayofmonth("ts") > 15)
    text = ev.groupBy("user_id", "late").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])).alias("text"))
    snap = lambda late: logs.snapshot(text.where(F.col("late") == late), "user_id", "text")
    return logs.snapshot_diff(snap(False), snap(True))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def q_retention(spark, d):
    return logs.retain_last(load(spark, d, "events"), ["ts", "event_id"], 5, ["user_id"]).select("event_id", "user_id")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def q_retention_tail(spark, d):
    return logs.retain_last(load(spark, d, "events"), ["ts", "event_id"], 100).select("event_id", "event_type")


@query("SELECT user_id, count(*) AS times FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 2")
def q_repeat_offenders(spark, d):
    return logs.repeat_offenders(load(spark, d, "events"), ["user_id"], F.col("event_type") == "error")


@query("""WITH L AS (SELECT 'u' || user_id AS a, 'u' || (user_id * 7 + 3) % 40 AS b, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'approved' ELSE 'noted' END AS decision, event_id FROM events)
SELECT least(a, b) AS first, greatest(a, b) AS second, arg_max(decision, struct_pack(r := CASE decision WHEN 'rejected' THEN 2 WHEN 'approved' THEN 1 ELSE 0 END, e := event_id)) AS decision FROM L GROUP BY 1, 2""")  # fmt: skip
def q_decision_priority(spark, d):
    u = F.col("user_id")
    log = load(spark, d, "events").select(F.concat(F.lit("u"), u).alias("a"), F.concat(F.lit("u"), (u * 7 + 3) % 40).alias("b"), F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "approved").otherwise("noted").alias("decision"), "event_id")
    return logs.decision_of_pair(log, "a", "b", "decision", ["event_id"])


@query("""SELECT conv_id AS file, role AS name, turn AS start_line, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, -1) AS end_line FROM conversations""")
def q_spans(spark, d):
    spans = govern.function_spans(load(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("role").alias("name"), F.col("turn").alias("start_line")))
    return spans.withColumn("end_line", F.coalesce("end_line", F.lit(-1)))


@query("SELECT source, count(*) AS total, count(l.doc_id) AS covered, (count(l.doc_id) / count(*))::DOUBLE AS share FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def q_coverage(spark, d):
    marks = load(spark, d, "labels").select("doc_id", F.lit(True).alias("marked"))
    return profile.coverage(load(spark, d, "documents").join(marks, "doc_id", "left"), ["source"], F.col("marked").isNotNull())


@query("SELECT count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr, count(*) AS total, true AS reconciled FROM documents")
def q_reconcile(spark, d):
    return profile.reconcile(load(spark, d, "documents"), "lang", ["de", "en", "es", "fr"])


@query("SELECT r_name, n_name, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def q_tree(spark, d):
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = n.join(load(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("customers"))
    tree = c.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_name", "customers"))).alias("nations"))
    return tree.select("r_name", F.inline("nations"))


@query("""WITH P AS (SELECT n_chars > 500 AS p, quality = 1 AS q FROM documents JOIN labels USING (doc_id)), C AS (SELECT count(*) FILTER (p AND q) AS tp, count(*) FILTER (p AND NOT q) AS fp, count(*) FILTER (NOT p AND q) AS fn FROM P)
SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tp * 2 / (tp * 2 + fp + fn) AS f1 FROM C""")  # fmt: skip
def q_prf(spark, d):
    both = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id")
    return profile.precision_recall(both, F.col("n_chars") > 500, F.col("quality") == 1)


@query("SELECT n_regionkey, count(DISTINCT n_name) AS projects, count(DISTINCT n_name) >= 3 AS is_monorepo FROM nation GROUP BY 1")
def q_monorepo(spark, d):
    return profile.monorepo(load(spark, d, "nation"), "n_regionkey", "n_name")


@query("""WITH U AS (SELECT o_custkey AS src, o_orderkey % 50 AS dst, 'order' AS origin, 0 AS r FROM orders UNION ALL SELECT c_custkey, c_nationkey, 'home', 1 FROM customer)
SELECT src, dst, arg_min(origin, r) AS origin FROM U GROUP BY 1, 2""")  # fmt: skip
def q_union_dedupe(spark, d):
    a = load(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 50).alias("dst"), F.lit("order").alias("origin"))
    b = load(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"), F.lit("home").alias("origin"))
    return joins.union_first([a, b], ["src", "dst"])


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 5")
def q_first_five(spark, d):
    return profile.examples(load(spark, d, "events"), "event_type", ["ts", "event_id"]).select("event_type", "event_id")


@query("""WITH A AS (SELECT source || lang AS k, count(*) AS n FROM documents WHERE n_chars > 2000 GROUP BY 1), B AS (SELECT source || lang AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1)
SELECT coalesce(A.k, B.k) AS k, coalesce(A.n, -1) AS left_value, coalesce(B.n, -1) AS right_value, CASE WHEN B.n IS NULL THEN 'only_left' WHEN A.n IS NULL THEN 'only_right' WHEN A.n = B.n THEN 'match' ELSE 'mismatch' END AS status FROM A FULL JOIN B ON A.k = B.k""")  # fmt: skip
def q_compare_counts(spark, d):
    docs = load(spark, d, "documents").withColumn("k", F.concat("source", "lang"))
    count = lambda x: x.groupBy("k").agg(F.count("*").alias("n"))
    out = joins.compare_counts(count(docs.where("n_chars > 2000")), count(docs.join(load(spark, d, "labels").where("quality = 1"), "doc_id")), "k", "n")
    return out.fillna(-1, ["left_value", "right_value"])


@query("""WITH RECURSIVE L AS (SELECT p_partkey AS name, p_partkey // 2 AS target FROM part WHERE p_size <> 7), R(name, target, n) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT R.name, L.target, n + 1 FROM R JOIN L ON L.name = R.target WHERE n < 5 AND L.target <> R.target)
SELECT name, arg_max(target, n) AS target FROM R GROUP BY 1""")  # fmt: skip
def q_alias_chase(spark, d):
    parts = load(spark, d, "part")
    links = parts.where("p_size <> 7").selectExpr("p_partkey AS name", "p_partkey DIV 2 AS target")
    return joins.chase(links, parts.select(F.col("p_partkey").alias("name")))


@query("""WITH C AS (SELECT c_custkey, count(o_orderkey) AS imports FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT 'c' || c_custkey AS path, (CASE WHEN imports >= 10 THEN 3 WHEN imports >= 5 THEN 2 ELSE 0 END + CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN c_custkey % 20 >= 15 THEN 2 WHEN c_custkey % 20 >= 8 THEN 1 ELSE 0 END
  + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 END) AS points FROM C ORDER BY points DESC, path LIMIT 5""")  # fmt: skip
def q_component_risk(spark, d):
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey")
    return profile.top_risk(c.select(F.concat(F.lit("c"), k).alias("path"), F.coalesce("n", F.lit(0)).alias("imports"), (k % 4 == 0).alias("critical_name"), (k % 20).alias("functions"), (k % 3 == 0).alias("has_test")))


@query("""WITH E AS (SELECT o_custkey AS dst, o_orderkey AS src FROM orders), C AS (SELECT dst, count(DISTINCT src) AS n FROM E GROUP BY 1)
SELECT c_custkey AS node, coalesce(n, 0) AS callers, CASE WHEN n IS NULL THEN 'KNOWN_UNKNOWN' ELSE 'OBSERVED' END AS verdict FROM customer LEFT JOIN C ON dst = c_custkey""")  # fmt: skip
def q_verdicts(spark, d):
    edges = load(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.caller_verdicts(edges, load(spark, d, "customer").select(F.col("c_custkey").alias("node")))


@query("""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, array_to_string(list_sort(list(DISTINCT regexp_extract(url, '://[^/]*/([a-z]+)', 1))), ',') AS users, count(*) AS imports FROM pages GROUP BY 1""")
def q_dependencies_roll_up(spark, d):
    p = load(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/]*/([a-z]+)", 1).alias("lang"))
    return profile.dependency_roll_up(p, "host", "lang").select("host", F.concat_ws(",", "users").alias("users"), "imports")


@query("""WITH A AS (SELECT DISTINCT lower(p_brand) AS package FROM part WHERE p_size > 25), B AS (SELECT DISTINCT lower(p_brand) AS package FROM part WHERE p_retailprice > 1500)
SELECT coalesce(A.package, B.package) AS package, A.package IS NOT NULL AS declared, B.package IS NOT NULL AS imported FROM A FULL JOIN B ON A.package = B.package WHERE coalesce(A.package, B.package) <> 'brand#11'""")  # fmt: skip
def q_dependencies(spark, d):
    parts = load(spark, d, "part").withColumnRenamed("p_brand", "package")
    own = spark.createDataFrame([("Brand#11",)], "package string")
    return cognition.dependencies(parts.where("p_size > 25"), parts.where("p_retailprice > 1500"), own, ["none"])


@query("""SELECT u.event_id, u.event_type AS call FROM events u WHERE u.event_type NOT IN (SELECT DISTINCT role FROM conversations) AND u.event_type NOT IN ('view')""")
def q_unknown_calls(spark, d):
    calls = load(spark, d, "events").select("event_id", F.col("event_type").alias("call"))
    known = load(spark, d, "conversations").select(F.col("role").alias("name"))
    return resolution.unknown_calls(calls, known, ["view"])


@query("""WITH U AS (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1), L AS (SELECT *, CASE WHEN uses <= 0 THEN 'Low' WHEN uses <= 3 THEN 'Medium' WHEN uses <= 7 THEN 'High' ELSE 'Critical' END AS level FROM U)
SELECT l_partkey, uses, level FROM L WHERE level IN ('High', 'Critical')""")  # fmt: skip
def q_high_usage(spark, d):
    uses = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("uses")).withColumn("level", decisions.usage_level(F.col("uses")))
    return decisions.high_usage(uses)


@query("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 2)::DOUBLE AS percent FROM events GROUP BY 1")
def q_label_roll_up(spark, d):
    ev = load(spark, d, "events")
    return profile.label_roll_up(ev, "event_type", ev.count())


@query("""SELECT role, count(*) FILTER (tier <> 'UNKNOWN') AS populated, count(*) AS fields FROM (SELECT role, CASE WHEN length(text) > 40 THEN 'OBSERVED' ELSE 'UNKNOWN' END AS tier FROM conversations) GROUP BY 1""")
def q_evidence_coverage(spark, d):
    cells = load(spark, d, "conversations").select("role", profile.evidence_cell(F.when(F.length("text") > 40, F.col("text")), "OBSERVED").alias("cell"))
    return profile.evidence_coverage(cells.select("role", "cell.tier"), "role", "tier")


@query("""SELECT count(*) FILTER (d = 'APPROVED') AS approved, count(*) FILTER (d = 'REJECTED') AS rejected, count(*) FILTER (d = 'PENDING_REVIEW') AS review, 0::BIGINT AS block, count(*) AS total
FROM (SELECT CASE event_type WHEN 'error' THEN 'REJECTED' WHEN 'purchase' THEN 'PENDING_REVIEW' ELSE 'APPROVED' END AS d FROM events)""")  # fmt: skip
def q_memory_summary(spark, d):
    severity = F.when(F.col("event_type") == "error", "BLOCK").when(F.col("event_type") == "purchase", "REVIEW").otherwise("INFO")
    return logs.summary(load(spark, d, "events").select(decisions.approval(severity).alias("decision")), "decision")
