"""Facts, call resolution, duplicates, lineage, other languages, documentation, governance."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.operators import calls, cognition, docs, duplicates, govern, graph, lineage, resolution
from loomstone.plans import source_queries
from loomstone.sources import inventory, languages
from loomstone.sources.python_facts import HELD, fact_batches, function_bodies, python_facts, typed_constant

FILES = {
    "pkg/__init__.py": "",
    "pkg/base.py": "class Root:\n    def ping(self): return 1\nclass Base(Root):\n    def __init__(self): self.x = []\n    def run(self): return self.ping()\n",
    "pkg/util.py": (
        "import os\nfrom collections import OrderedDict\nfrom .base import Base\nfrom . import base\ndef helper(): return Base()\nclass Child(Base):\n    def __init__(self):\n        super().__init__()\n"
        "        self.b = Base()\n    def go(self):\n        self.run(); self.missing()\n        helper()\n        b = Base()\n        b.run()\n        b = other()\n        b.run()\n"
        "        def inner(): return inner()\n        inner()\n        l = []\n        l.append(1)\n        base.Base()\n        OrderedDict()\n        print(3)\n        nowhere()\n        self.b.run()\n"
    ),
    "bad.py": "def (",
}


@pytest.fixture(scope="module")
def facts(spark):
    return python_facts(spark.createDataFrame(list(FILES.items()), "path string, source string"), bodies=True).cache()


def test_calls_resolve_in_order(facts):
    edges, open_ = calls.resolve_calls(facts)
    got = {(r["caller"].removeprefix("pkg."), r["callee"].removeprefix("pkg."), r["resolution"]) for r in edges.collect()}
    assert got == {
        ("base.Base.run", "base.Root.ping", "inherited_method_call"), ("util.helper", "base.Base.__init__", "imported_call"), ("util.Child.__init__", "base.Base.__init__", "imported_call"),
        ("util.Child.go", "base.Base.run", "inherited_method_call"), ("util.Child.go", "util.helper", "direct_name_call"), ("util.Child.go", "base.Base.__init__", "imported_call"),
        ("util.Child.go", "base.Base.run", "local_typed_method_call"), ("util.Child.go.inner", "util.Child.go.inner", "nested_function_call"), ("util.Child.go", "util.Child.go.inner", "nested_function_call"),
        ("util.Child.go", "<builtin>.list.append", "local_builtin_method_call"), ("util.Child.go", "base.Base.__init__", "qualified_module_call"), ("util.Child.go", "<external>.collections.OrderedDict", "external_constructor_call"),
    }
    left = sorted((r["pattern"], r["name"]) for r in open_.collect())
    # the second b.run() has lost its type, self.b.run() and super() are later resolvers' work
    assert left == [("attribute_call", "__init__"), ("attribute_call", "run"), ("attribute_call", "run"), ("name_call_unresolved", "nowhere"), ("name_call_unresolved", "other"), ("parse_error", "SyntaxError"), ("self_method_not_found", "missing")]


def test_later_resolvers(spark, facts):
    table, bases = calls.symbols(facts), calls.resolved_bases(facts)
    classes = facts.where("kind = 'class'").selectExpr("name", "id AS path")
    types = resolution.attribute_types(facts, resolution.unique_names(classes))
    assert [tuple(r) for r in types.collect()] == [("pkg.util.Child", "b", "pkg.base.Base")]
    assert [(r["callee"], r["resolution"]) for r in resolution.attribute_calls(facts, types, table, bases).collect()] == [("pkg.base.Base.run", "local_typed_method_call")]
    orders = calls.linearise(bases.selectExpr("'r' AS repo", "path", "ord", "base"), "repo")
    assert [r["callee"] for r in resolution.super_calls(facts, orders, table).collect()] == ["pkg.base.Base.__init__"]
    origins = resolution.last_origins(facts, table)
    methods = facts.where("kind = 'function' AND target = 'class'").selectExpr("concat_ws('.', module, class) AS class", "name")
    asked = spark.createDataFrame([("pkg.base", "append", "z"), ("pkg.util", "getattr", "q"), ("pkg.util", "run", "none")], "module string, name string, variable string")
    got = {r["name"]: r["resolver"] for r in resolution.deep_cascade(asked, origins, methods, bases).collect()}
    assert got == {"append": "builtin", "getattr": "reflection", "run": None}


def test_c3_and_depth_first_differ_on_a_diamond(spark):
    bases = spark.createDataFrame([("r", "D", 0, "B"), ("r", "D", 1, "C"), ("r", "B", 0, "A"), ("r", "C", 0, "A"), ("r", "X", 0, "A"), ("r", "X", 1, "B")], "repo string, path string, ord int, base string")
    orders = {r["path"]: r["mro"] for r in calls.linearise(bases, "repo").collect()}
    assert orders["D"] == ["D", "B", "C", "A"] and orders["X"] is None
    dfs = calls.ancestors(bases.drop("repo")).where("path = 'D'").orderBy("place")
    assert [r["ancestor"] for r in dfs.collect()] == ["B", "A", "C"]


def test_return_types_reach_the_fixed_point(spark):
    chain = [(f"f{i}", "call", f"f{i - 1}") for i in range(1, 9)] + [("f0", "type", "int"), ("m", "type", "str"), ("m", "call", "f8"), ("u", "call", "none"), ("p", "unknown", None), ("p", "type", "int"), ("loop", "call", "loop")]
    got = {r["fid"]: (r["types"], r["label"]) for r in calls.return_types(spark.createDataFrame(chain, "fid string, kind string, value string")).collect()}
    assert got["f0"] == (["int"], "RESOLVED") and got["f8"] == (["int"], "INFERRED") and got["m"] == (["int", "str"], "AMBIGUOUS")
    assert not {"u", "p", "loop"} & set(got)


def test_typed_constants_equal_as_python_values():
    assert typed_constant(True) == typed_constant(1) == typed_constant(1.0) and typed_constant(False) == typed_constant(0)
    assert typed_constant("1") != typed_constant(1) and typed_constant(0.1) != typed_constant(0.2) and typed_constant(float("inf")) and typed_constant(None)


BODIES = {
    "a.py": "def add_values(a, b):\n    return a + b\n",
    "b.py": "def sum_values(x, y):\n    return x + y\n",
    "c.py": "def times(a, b):\n    return a * b\n",
    "d.py": "def rate_one(v):\n    t = v * 0.10\n    return t + v\n",
    "e.py": "def rate_two(v):\n    t = v * 0.20\n    return t + v\n",
    "f.py": "def check_email(v):\n    return v + v - v\n",
    "g.py": "def check_username(v):\n    return v + v - v\n",
    "h.py": "def down(n):\n    return down(n - 1) % 2\n",
    "i.py": "def fall(n):\n    return fall(n - 1) % 2\n",
    "j.py": "def nothing():\n    pass\n",
    "k.py": "def empty():\n    pass\n",
}


def test_duplicate_functions(spark):
    f = function_bodies(python_facts(spark.createDataFrame(list(BODIES.items()), "path string, source string"), bodies=True))
    got = {(r["function_1"], r["function_2"]): r["duplicate_type"] for r in duplicates.find_duplicates(f).collect()}
    assert got == {
        ("add_values", "sum_values"): "SAFE_LOGICAL_DUPLICATE", ("rate_one", "rate_two"): "BUSINESS_LOGIC_CONFLICT",
        ("check_email", "check_username"): "SEMANTIC_REVIEW_REQUIRED", ("down", "fall"): "SEMANTIC_REVIEW_REQUIRED",
    }
    pairs = spark.createDataFrame([("f", "g", "x = 1", "for i in x:\n  y += 1", "SAFE_LOGICAL_DUPLICATE"), ("f", "g", "same", "same", "BUSINESS_LOGIC_CONFLICT")], "function_1 string, function_2 string, code_1 string, code_2 string, duplicate_type string")
    merged = [(r["best"], r["keep"], r["remove"], r["merge_allowed"]) for r in duplicates.suggest_merge(pairs).collect()]
    assert merged == [("function_1", "f", "g", True), ("equal", "g", "f", False)]


SQL = """CREATE TABLE raw (a int); CREATE TABLE staging(a int); -- SELECT FROM nothing
CREATE TABLE report(a int);
CREATE PROCEDURE load_staging AS BEGIN INSERT INTO staging SELECT * FROM raw; END;
CREATE OR REPLACE PROCEDURE dbo.build_report AS BEGIN EXEC load_staging; INSERT INTO report SELECT * FROM staging s JOIN raw r ON 1=1; END;
CREATE TRIGGER t1 AFTER INSERT ON raw BEGIN UPDATE report SET a=1; END;"""


def test_sql_lineage(spark):
    got = lineage.lineage(spark.createDataFrame([("e.sql", SQL), ("loose.sql", "DELETE FROM dbo.raw"), ("none.sql", None)], "path string, source string"))
    rows = lambda k: sorted(tuple(r) for r in got[k].collect())
    assert rows("tables") == [("raw",), ("report",), ("staging",)]
    assert rows("writes") == [("__file__", "raw"), ("build_report", "report"), ("load_staging", "staging"), ("t1", "report")]
    assert rows("fires_on") == [("t1", "raw")] and rows("calls") == [("build_report", "load_staging")]
    assert rows("flows") == [("raw", "build_report", "report"), ("raw", "load_staging", "staging"), ("staging", "build_report", "report")]
    assert sorted(r[0] for r in lineage.upstream_of(got["flows"], "report").collect()) == ["raw", "staging"]
    assert sorted(r[0] for r in lineage.impact_of_table(got["flows"], "raw").collect()) == ["report", "staging"]
    assert [r[0] for r in lineage.writers_of(got["writes"], "staging").collect()] == ["load_staging"]
    status = {r["name"]: r["status"] for r in lineage.reference_status(spark.createDataFrame([("o", "raw"), ("o", "dbms_output"), ("o", "gone")], "object string, name string"), got["tables"]).collect()}
    assert status == {"raw": "RESOLVED", "dbms_output": "ORACLE_SYSTEM_PACKAGE", "gone": "NOT_DEFINED_IN_REPO"}


def test_other_languages(spark):
    go = "package main\n\ntype S struct{}\nfunc helper() int {\n return 1\n}\nfunc (s *S) Run() {\n s.Stop() // helper()\n helper()\n}\nfunc (s *S) Stop() {\n}\n"
    got = {(r["caller"], r["callee"], r["resolution"]) for r in languages.go_calls(spark.createDataFrame([("a.go", go)], "path string, source string")).collect()}
    assert got == {("main.S.Run", "main.S.Stop", "go_method_on_receiver"), ("main.S.Run", "main.helper", "go_same_package_func")}
    cs = [("A.cs", "public class Repo {\n  public void Save() {\n  }\n}"), ("B.cs", "public class Svc {\n  private readonly Repo _repo;\n  public void Go() {\n    Check();\n    _repo.Save();\n  }\n  private bool Check() {\n    return true;\n  }\n}")]
    got = {(r["caller"], r["callee"]) for r in languages.csharp_calls(spark.createDataFrame(cs, "path string, source string")).collect()}
    assert got == {("Svc.Go", "Svc.Check"), ("Svc.Go", "Repo.Save")}
    c = spark.createDataFrame([("x.c", '#include <stdio.h>\nint add(int a, int b) {\n return a+b;\n}\nint main(void)\n{\n printf("x");\n return add(1,2);\n}\n')], "path string, source string")
    edges, open_ = languages.c_calls(c)
    assert [(r["path"], r["caller"], r["callee"], r["lineno"]) for r in edges.collect()] == [("x.c", "main", "add", 8)]
    assert [(r["path"], r["name"]) for r in open_.collect()] == [("x.c", "printf")] and languages.c_includes(c).first()["include"] == "stdio.h"
    kinds = {(r["kind"], r["name"]) for r in languages.definitions(spark.createDataFrame([("a.go", go)], "path string, source string"), languages.GO).collect()}
    assert ("struct", "S") in kinds and ("package", "main") in kinds


def test_java_and_javascript(spark):
    java = "package p.q;\nimport a.B;\npublic class Svc {\n  public void go(int x) {\n    check(x);\n    other.check(1);\n  }\n  private boolean check(int y) {\n    return y > 0;\n  }\n}\n"
    df = spark.createDataFrame([("S.java", java)], "path string, source string")
    assert [(r["caller"], r["callee"], r["lineno"]) for r in languages.java_calls(df).collect()] == [("Svc.go", "Svc.check", 5)]
    assert {("package", "p.q"), ("import", "a.B"), ("class", "Svc")} <= {(r["kind"], r["name"]) for r in languages.definitions(df, languages.JAVA).collect()}
    js = "import x from './lib';\nfunction one(a) {\n  return two(a);\n}\nconst two = (b) => {\n  return b;\n}\n"
    df = spark.createDataFrame([("a.js", js)], "path string, source string")
    assert [(r["caller"], r["callee"]) for r in languages.script_calls(df).collect()] == [("one", "two")]
    assert {("import", "./lib"), ("function", "one"), ("arrow", "two")} <= {(r["kind"], r["name"]) for r in languages.definitions(df, languages.SCRIPT).collect()}


def test_annotations_type_receivers(spark):
    source = "from m import K\nclass L:\n    def put(self): pass\ndef f(a: K, b: L, c):\n    a.run(); b.put(); c.run()\n    d: K = c\n    d.run()\n"
    facts = python_facts(spark.createDataFrame([("n.py", source), ("m.py", "class K:\n    def run(self): pass\n")], "path string, source string"))
    got = resolution.annotated_calls(facts, calls.aliases(facts), calls.symbols(facts))
    assert sorted((r["lineno"], r["callee"]) for r in got.collect()) == [(5, "m.K.run"), (5, "n.L.put"), (7, "m.K.run")]
    asked = spark.createDataFrame([("f", "a.helper"), ("f", "print"), ("f", "x.gone")], "file string, call string")
    assert [r["call"] for r in resolution.unknown_calls(asked, spark.createDataFrame([("helper",)], "name string"), ["print"]).collect()] == ["x.gone"]


def test_imports_of_files(spark):
    files = spark.createDataFrame([("src/app/util.py",), ("src/app/__init__.py",), ("web/a.js",), ("web/lib/index.ts",)], "path string")
    asked = spark.createDataFrame([("x.py", "app.util.helper"), ("x.py", "app"), ("x.py", "missing.mod")], "file string, target string")
    got = {r["target"]: r["path"] for r in resolution.import_targets(asked, files).collect()}
    assert got == {"app.util.helper": "src/app/util.py", "app": "src/app/__init__.py"}
    js = spark.createDataFrame([("web/b/c.js", "../a"), ("web/a.js", "./lib"), ("web/a.js", "react")], "file string, target string")
    assert {r["target"]: r["path"] for r in resolution.script_imports(js, files).collect()} == {"../a": "web/a.js", "./lib": "web/lib/index.ts"}
    packages = spark.createDataFrame([("src.flask",), ("src.flask.json",)], "package string")
    assert [tuple(r) for r in resolution.namespace_bridge(packages).collect()] == [("flask", "src.flask")]
    tests = spark.createDataFrame([("a/util.py",), ("tests/test_util.py",), ("b/other.py",)], "path string")
    assert [tuple(r) for r in resolution.tests_of(tests).collect()] == [("a/util.py", "tests/test_util.py")]
    assert resolution.traceability(tests).first()["percent"] == 50.0


def test_simple_types_and_interfaces(spark):
    classes = spark.createDataFrame([("p", "A", "p.A"), ("q", "A", "q.A"), ("q", "B", "q.B")], "package string, name string, path string")
    refs = spark.createDataFrame([("f", "p", "A"), ("g", "r", "A"), ("g", "r", "B"), ("h", "r", "A"), ("h", "r", "Z")], "file string, package string, name string")
    imports = spark.createDataFrame([("h", "A", "q.A")], "file string, name string, path string")
    got = {(r["file"], r["name"]): (r["path"], r["label"]) for r in resolution.simple_type(refs, classes, imports).collect()}
    assert got == {("f", "A"): ("p.A", "RESOLVED"), ("g", "A"): (None, "AMBIGUOUS"), ("g", "B"): ("q.B", "RESOLVED"), ("h", "A"): ("q.A", "RESOLVED"), ("h", "Z"): (None, "EXTERNAL")}
    bound = resolution.interface_calls(spark.createDataFrame([("c", "IRepo", "Save")], "caller string, receiver_type string, name string"), spark.createDataFrame([("Sql", "IRepo"), ("Mem", "IRepo")], "class string, interface string"), spark.createDataFrame([("Sql", "Save"), ("Mem", "Load")], "class string, name string"))
    assert [r["callee"] for r in bound.collect()] == ["Sql.Save"]


def test_docs(spark, facts):
    claims = docs.doc_claims(spark.createDataFrame([("README.md", "Use `run()` and :func:`pkg.gone`.\n`os` and `Baz` and `nope()` and `run()`")], "path string, source string"))
    assert claims.count() == 6
    symbols = spark.createDataFrame([("pkg.Base.run",), ("Baz",), ("hidden",), ("_p",)], "name string")
    drifted = docs.drift(claims, symbols, spark.createDataFrame([("Baz", "CHANGES.md", 3)], "symbol string, file string, line int"))
    got = sorted((r["symbol"], r["status"]) for r in drifted.collect())
    assert got == [("Baz", "DEPRECATED_PRESENT"), ("Baz", "MATCH"), ("hidden", "UNDOCUMENTED_PUBLIC"), ("nope", "DOCUMENTED_MISSING"), ("os", "EXCLUDED:stdlib"), ("pkg.gone", "DOCUMENTED_MISSING"), ("run", "MATCH"), ("run", "MATCH")]
    assert docs.reconciled(docs.drift(claims, symbols)).first()["reconciled"]
    cover = {r["module"]: (r["symbols"], r["documented"]) for r in docs.docstring_coverage(facts).collect()}
    assert cover["pkg.base"] == (5, 0)
    mined = docs.mine(spark.createDataFrame([("a", "we assume x\nmust not fail\nplain\nTODO")], "path string, source string"))
    assert sorted((r["line"], r["kind"]) for r in mined.collect()) == [(1, "assumption"), (2, "constraint"), (4, "todo")]
    assert docs.inventory(spark.createDataFrame([("README.md",), ("docs/adr/1.md",)], "path string")).first()["readmes"] == 1


def test_governance(spark):
    source = spark.createDataFrame([("a.py", 'def f():\n CACHE["x"] = 1\n\ndef g():\n _STATE.update(3)\n')], "path string, source string")
    functions = spark.createDataFrame([("a.py", "f", 1), ("a.py", "g", 4)], "file string, name string, start_line int")
    found = govern.global_state(source, functions)
    assert sorted((r["function"], r["line"], r["name"]) for r in found.collect()) == [("f", 2, "CACHE"), ("g", 5, "_STATE")]
    made = spark.createDataFrame([("a.py", "f", 2, "x.os.remove"), ("a.py", "f", 3, "subprocess.Popen"), ("a.py", "g", 1, "fine")], "file string, function string, line int, call string")
    rolled = {(r["check"], r["severity"]): r["n"] for r in govern.roll_up(govern.findings(made, found)).collect()}
    assert rolled == {("dangerous_api", None): 2, ("global_state", None): 2, (None, "REVIEW"): 4, (None, None): 4}


def test_inventory(spark, tmp_path):
    for name, text in {"a/app.py": "if __name__ == '__main__': x()", "a/node_modules/x.js": "", "requirements.txt": "Flask>=1 # c\n-r x\nnumpy", "package.json": '{"dependencies": {"react": "1"}, "devDependencies": {"jest": "2"}}', "m.onnx": "", "q.weird": "", "lib.h": ""}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = inventory.classify(inventory.scan(spark, str(tmp_path))).cache()
    tier = {r["path"]: r["tier"] for r in files.collect()}
    assert tier == {"a/app.py": "language", "requirements.txt": "document", "package.json": "unknown", "m.onnx": "model", "q.weird": "unknown", "lib.h": "language"}
    assert sorted(r["package"] for r in inventory.requirements(files).collect()) == ["flask", "numpy"]
    assert {(r["package"], r["dev"]) for r in inventory.package_json(files).collect()} == {("react", False), ("jest", True)}
    assert inventory.dominant_language(files).first()["language"] == "python"
    assert [r["path"] for r in inventory.entry_points(files).collect()] == ["a/app.py"]
    assert inventory.unmatched_extensions(files).where("ext = '.weird'").first()["files"] == 1
    inventory.write_report(files.drop("content"), str(tmp_path / "out"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 6


def test_cognition(spark):
    hints = spark.createDataFrame([("mvc", "models", 2, 1), ("mvc", "views", 2, 1), ("layers", "service", 1, 2)], "pattern string, hint string, least int, rank int")
    names = spark.createDataFrame([("Models",), ("views",), ("service",)], "name string")
    assert tuple(cognition.architecture(names, hints).first()) == ("mvc", 2)
    hits = spark.createDataFrame([("Data",), ("Finance_System",)], "domain string")
    assert cognition.domain(hits).first()["domain"] == "Finance_System"
    files = spark.createDataFrame([("a/Dockerfile", "FROM x"), ("b.py", "plain")], "path string, content string")
    rules = spark.createDataFrame([("docker", "Dockerfile$", "FROM", "CONTAINER", 3), ("none", "b.py", "absent", "X", 1)], "pattern string, file_regex string, keyword string, type string, weight int")
    assert [tuple(r) for r in cognition.pattern_signals(files, rules).collect()] == [("docker", "CONTAINER", 3)]
    model = python_facts(spark.createDataFrame([("m.py", "class N:\n def __init__(self):\n  self.a = nn.Linear(1)\n  self.b = nn.ReLU()\n def forward(self, x):\n  y = self.a(x)\n  return self.b(y)\n")], "path string, source string"))
    assert [(r["step"], r["layer"]) for r in cognition.layer_graph(model).orderBy("step").collect()] == [(1, "Linear"), (2, "ReLU")]
    rows = [("a", "REVIEW_REQUIRED", 60, 0), ("b", "BLOCKED", 50, 3), ("c", "APPROVED", None, None)]
    told = cognition.recommendations(spark.createDataFrame(rows, "repo string, gate string, in_repo_misses int, unresolved int")).collect()
    assert [(r["repo"], r["severity"]) for r in told] == [("a", "HIGH"), ("a", "MEDIUM"), ("b", "LOW"), ("c", "LOW")]


def test_deep_chains_and_paths(spark):
    """Bases and relative imports of any depth."""
    deep = spark.createDataFrame([(f"m.C{i}", 0, f"m.C{i + 1}") for i in range(40)] + [("m.C40", 0, "m.C0")], "path string, ord int, base string")
    got = calls.ancestors(deep).where("path = 'm.C0'").select("ancestor").distinct().count()
    assert got == 40
    files = spark.createDataFrame([("lib/util.js",), ("a/b/c/d/e/f/x.ts",)], "path string")
    imports = spark.createDataFrame([("a/b/c/d/e/f/main.js", "../../../../../../lib/util"), ("a/b/c/d/e/f/main.js", "./../f/./x"), ("a/main.js", "../../outside")], "file string, target string")
    got = {(r["target"], r["path"]) for r in resolution.script_imports(imports, files).collect()}
    assert got == {("../../../../../../lib/util", "lib/util.js"), ("./../f/./x", "a/b/c/d/e/f/x.ts")}


def test_adjacency_of_modules(spark):
    rows = [("pkg", "os"), ("pkg.util", "pkg.util.helper"), ("pkg.main", "pkg.util.helper"), ("pkg.main", "pkg.main.x"), ("pkg.main", "pkg.util")]
    got = graph.module_adjacency(spark.createDataFrame(rows, "module string, target string"))
    assert sorted(map(tuple, got.collect())) == [("pkg.main", "pkg"), ("pkg.main", "pkg.util"), ("pkg.util", "pkg")]


def test_sampling_and_dependencies(spark):
    imports = spark.createDataFrame([("z/main.py", "a"), ("a.py", "b"), ("b.py", "c"), ("c.py", "d")], "path string, root string")
    taken = lambda n: sorted(r["path"] for r in cognition.sampled_imports(imports, ["main.py"], n).collect())
    assert taken(2) == ["a.py", "z/main.py"] and taken(1) == ["z/main.py"] and len(taken(0)) == 4
    declared, own = spark.createDataFrame([("Flask",), ("unused",)], "package string"), spark.createDataFrame([("app",)], "package string")
    found = spark.createDataFrame([("flask",), ("app",), ("os",), ("numpy",)], "package string")
    got = {r["package"]: (r["declared"], r["imported"]) for r in cognition.dependencies(declared, found, own, ["os"]).collect()}
    assert got == {"flask": (True, True), "unused": (True, False), "numpy": (False, True)}


def test_hops_carry_known_types(spark):
    from loomstone.operators import graph

    chains = spark.createDataFrame([(["b", "c"], "leaf")], "hops array<string>, ending string")
    types = spark.createDataFrame([("c", "int")], "fid string, type string")
    assert [(r["at"], r["callee_type"]) for r in graph.annotate_hops(chains, types).orderBy("at").collect()] == [(0, None), (1, "int")]


def test_registry_dispatch_is_a_bounded_set(spark):
    source = "def a(): pass\nHANDLERS = {'a': a, 'n': 1}\nHANDLERS['b'] = mod.b\nHANDLERS.register('c', c)\ndef run(k):\n    HANDLERS.get(k)()\n    HANDLERS[k](1)\n    OTHER[k]()\n"
    got = resolution.registry_dispatch(python_facts(spark.createDataFrame([("m.py", source)], "path string, source string"))).collect()
    assert [(r["caller"], r["callees"], r["label"]) for r in got] == [("m.run", ["a", "c", "mod.b"], "UNCERTAIN")] * 2


def test_sources_of_one_part_are_dealt_to_all_tasks(spark):
    files = spark.range(64).selectExpr("concat('m', id, '.py') AS path", "concat('def f', id, '(): pass') AS source").coalesce(1)
    found = python_facts(files).select("id", F.spark_partition_id().alias("task")).collect()
    assert len(found) == 64 and len({r["task"] for r in found}) == 4


@pytest.mark.parametrize("name", ["q_ancestors", "q_attribute_types", "q_imported_receivers", "q_return_types", "q_module_tree", "q_dangerous_calls"])
def test_each_source_is_parsed_once(spark, sf, monkeypatch, name):
    parsed, sources = spark.sparkContext.accumulator(0), source_queries.sources
    see = F.udf(lambda text: (parsed.add(1), text)[1], "string").asNondeterministic()
    monkeypatch.setattr(source_queries, "sources", lambda s, d: sources(s, d).withColumn("source", see("source")))
    getattr(source_queries, name)(spark, sf).collect()
    assert parsed.value == sources(spark, sf).count()


def test_a_task_holds_few_facts_however_many_files_come_at_once():
    n = HELD + 10
    files = pa.RecordBatch.from_arrays([pa.array([f"m{i}" for i in range(n)]), pa.array(["f()\ng()"] * n)], names=["module", "source"])
    sizes = [b.num_rows for b in fact_batches(iter([files]), False)]
    assert sum(sizes) == 2 * n and max(sizes) == HELD
