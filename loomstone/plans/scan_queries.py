"""Scan rules, manifests and reports on rows made from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import paths
from loomstone.operators import decisions, profile
from loomstone.plans.registry import query
from loomstone.plans.rule_queries import listed, pick, picked
from loomstone.sources import inventory
from loomstone.tables import load

FOLDERS = ("src", ".hidden/x", "core", "a/venv", "pkg/.git", "./core", "vendor/lib", "C:\\\\Work\\\\core", "logs", "a/b/archive", "external", ".")
FILES = ("main.py", "a.py", "run_uat.py", "a_old.py", "x - Copy.py", "test_a.py", "a.pyc", "domain.py", "b.bak", "reports")


@query(f"""WITH P AS (SELECT p_partkey, replace({picked(FOLDERS, "p_partkey")}, '\\\\', '\\') || '/' || {picked(FILES, "p_partkey", 12)} AS path, {picked(FILES, "p_partkey", 12)} AS name FROM part),
S AS (SELECT *, string_split(path, '/') AS parts FROM P)
SELECT p_partkey, ends_with(path, '.py') AND name NOT IN {listed(paths.PROJECT_FILES)} AND len(list_filter(parts[:-2], lambda x: x IN {listed(paths.PROJECT_DIRS)} OR (starts_with(x, '.') AND x NOT IN ('.', '..')))) = 0 AS in_project,
  ends_with(path, '.py') AND len(list_filter(parts, lambda x: x IN {listed(paths.GRAPH_IGNORED)})) = 0 AS in_graph,
  starts_with(replace(path, '\\', '/'), 'core/') OR starts_with(replace(path, '\\', '/'), './core/') OR ends_with(path, 'main.py') AS internal, starts_with(lower(replace(path, '\\', '/')), 'c:/work') AS under,
  {" OR ".join(f"contains(path, '{m}')" for m in paths.BACKUP_MARKS)} AS backup, starts_with(name, 'test_') OR starts_with(name, '_test_') AS test_name FROM S""")  # fmt: skip
def q_scan_rules(spark, d):
    folder = pick([f.replace("\\\\", "\\") for f in FOLDERS], "p_partkey")
    rows = load(spark, d, "part").select("p_partkey", F.concat(folder, F.lit("/"), pick(FILES, "p_partkey", 12)).alias("path"), pick(FILES, "p_partkey", 12).alias("name"))
    p = F.col("path")
    return rows.select(
        "p_partkey", paths.in_project_scan(p).alias("in_project"), paths.in_graph_scan(p).alias("in_graph"), paths.is_internal(p).alias("internal"),
        paths.is_under(p, "C:\\Work").alias("under"), paths.is_backup(p).alias("backup"), paths.is_test_name(F.col("name")).alias("test_name"),
    )


#: Manifests with the packages that they name, and the signals that these give.
SIGNATURES = (("django", "WEB_APPLICATION", 3), ("scikit_learn", "ML_PIPELINE", 2), ("zope.interface", "LIBRARY_FRAMEWORK", 1), ("torch", "ML_PIPELINE", 3))
MANIFESTS = (
    ("requirements.txt", "# django\nDjango>=4 ; x\nscikit-learn[all]==1\n-r other\ngit+https://torch\ntorch\n\n"),
    ("setup.cfg", "torch\nnothing here"),
    ("pyproject.toml", "[x]\ntorch = \"2\"\ndeps = [\"django>=4\", \"scikit-learn\", 'torch']\n"),
    ("pom.xml", "<a>org.springframework.boot</a> hibernate"),
    ("package.json", '{"dependencies": {"react": "1", "next": "2"}}'),
    ("readme.md", "django"),
)
GIVEN = (
    ("requirements.txt", "WEB_APPLICATION", 3), ("requirements.txt", "ML_PIPELINE", 2), ("requirements.txt", "ML_PIPELINE", 3), ("setup.cfg", "ML_PIPELINE", 3), ("pyproject.toml", "ML_PIPELINE", 3),
    ("pyproject.toml", "WEB_APPLICATION", 3), ("pyproject.toml", "ML_PIPELINE", 2), ("pom.xml", "WEB_APPLICATION", 2), ("pom.xml", "WEB_APPLICATION", 2), ("pom.xml", "WEB_APPLICATION", 1),
    ("package.json", "FRONTEND_APPLICATION", 2), ("package.json", "FRONTEND_APPLICATION", 2),
)


@query(f"""WITH G(name, type, weight) AS (VALUES {", ".join(f"('{n}', '{t}', {w})" for n, t, w in GIVEN)})
SELECT 'r' || s_suppkey || '/' || name AS path, type, weight::BIGINT AS weight FROM supplier JOIN G ON name = {picked([n for n, _ in MANIFESTS], "s_suppkey")}""")
def q_manifest_signals(spark, d):
    rows = load(spark, d, "supplier").select(F.concat(F.lit("r"), "s_suppkey", F.lit("/"), pick([n for n, _ in MANIFESTS], "s_suppkey")).alias("path"), pick([c for _, c in MANIFESTS], "s_suppkey").alias("content"))
    return inventory.manifest_signals(rows, spark.createDataFrame(SIGNATURES, "package string, type string, weight int"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 4 = 1 OR c_nationkey % 7 = 0 THEN 'HIGH' WHEN c_custkey % 401 > 200 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM customer""")
def q_health_risk(spark, d):
    guesses = F.when(F.col("c_custkey") % 4 == 3, None).when(F.col("c_custkey") % 4 == 1, 1).otherwise(0)
    return load(spark, d, "customer").select("c_custkey", decisions.health_risk(guesses, F.when(F.col("c_nationkey") % 7 == 0, 2).otherwise(0), F.col("c_custkey") % 401).alias("risk"))


@query("""WITH A AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_quantity > 10), B AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_discount > 0.02)
SELECT src, dst, 'tp' AS found FROM (SELECT * FROM A INTERSECT SELECT * FROM B) UNION ALL SELECT src, dst, 'fp' FROM (SELECT * FROM A EXCEPT SELECT * FROM B) UNION ALL SELECT src, dst, 'fn' FROM (SELECT * FROM B EXCEPT SELECT * FROM A)""")  # fmt: skip
def q_edge_differences(spark, d):
    edges = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_quantity", "l_discount")
    return profile.edge_differences(edges.where("l_quantity > 10"), edges.where("l_discount > 0.02"))


TELLING = ("a clean and Robust design", "about 1,200 files", "about 12 files", "cleaner", "~ 40 calls, order of ten", "exactly 7", "legacy code, roughly 3")
SAID = ("robust,clean", "\\babout\\s+[\\d,]{3,}", "", "", "~\\s*[\\d,]{2,},\\border of\\b", "", "legacy,\\broughly\\s+[\\d,]+")


@query(f"SELECT s_suppkey, {picked(SAID, 's_suppkey')} AS words FROM supplier")
def q_judging_words(spark, d):
    return load(spark, d, "supplier").select("s_suppkey", F.concat_ws(",", profile.judging_words(pick(TELLING, "s_suppkey"))).alias("words"))


@query("""WITH F AS (SELECT repeat('d' || p_size % 3 || '/', (p_size % 4)::INT) || 'pkg' AS folder FROM part WHERE p_partkey % 5 = 2) SELECT folder, (len(string_split(folder, '/')))::INT AS depth FROM F ORDER BY depth, folder LIMIT 1""")
def q_package_folder(spark, d):
    part = load(spark, d, "part")
    folder = F.concat(F.expr("repeat(concat('d', p_size % 3, '/'), CAST(p_size % 4 AS INT))"), F.lit("pkg"))
    file = F.when(F.col("p_partkey") % 5 == 2, "/__init__.py").otherwise("/other.py")
    return inventory.package_folder(part.select(F.concat(folder, file).alias("path")), "pkg")
