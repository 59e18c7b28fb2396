"""Code facts and call resolution on sources written from the driver tables: a module for each supplier.

Every module imports from the next one, so what its calls resolve to is known from the keys alone; the SQL states it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators import calls, duplicates, govern, profile, resolution
from loomstone.plans.registry import query
from loomstone.sources.python_facts import function_bodies, python_facts
from loomstone.tables import load, settle

#: The text of a module; @S is its supplier, @T the next one's, @N its nation.
MODULE = '''import os
from pkg.m@T import helper as far
from pkg.m@T import Child as Far
from pkg import m@T
from collections import OrderedDict
LIMIT = @N
class Root:
    def ping(self):
        return 1
class Child(Root):
    def __init__(self):
        super().__init__()
        self.made = Root()
    def run(self):
        self.ping()
        self.own()
        self.gone()
        self.made.ping()
    def own(self):
        far()
        run()
def helper():
    b = Child()
    b.run()
    b.ping()
    def inner():
        return inner()
    inner()
    c = []
    c.append(1)
    m@T.helper()
    OrderedDict()
    print(b)
    nowhere()
    d.go()
def second():
    os.remove("x@S")
    eval("1")
    return helper()
def make():
    return Child()
def made_twice():
    return make()
def maker():
    m = made_twice()
    m.own()
    Far.run()
    Far.ping()
'''
#: Which definition calls which, and by which rule; M. is the module itself, T. the next one.
CALLS = (
    ("M.Child.run", "M.Root.ping", "inherited_method_call"),
    ("M.Child.run", "M.Child.own", "self_method_call"),
    ("M.Child.__init__", "M.Root.<class>", "same_module_class_call"),
    ("M.Child.own", "T.helper", "imported_call"),
    ("M.Child.own", "M.Child.run", "same_class_name_call"),
    ("M.helper", "M.Child.__init__", "same_module_class_call"),
    ("M.helper", "M.Child.run", "local_typed_method_call"),
    ("M.helper", "M.Root.ping", "local_typed_method_call"),
    ("M.helper.inner", "M.helper.inner", "nested_function_call"),
    ("M.helper", "M.helper.inner", "nested_function_call"),
    ("M.helper", "<builtin>.list.append", "local_builtin_method_call"),
    ("M.helper", "T.helper", "qualified_module_call"),
    ("M.helper", "<external>.collections.OrderedDict", "external_constructor_call"),
    ("M.second", "M.helper", "direct_name_call"),
    ("M.make", "M.Child.__init__", "same_module_class_call"),
    ("M.made_twice", "M.make", "direct_name_call"),
    ("M.maker", "M.made_twice", "direct_name_call"),
    ("M.maker", "T.Child.run", "qualified_module_call"),
)
#: What the type that a function returns adds.
BY_RETURNS = (("M.maker", "M.Child.own", "local_typed_method_call"),)
IMPORTED = (("M.maker", "T.Child.run", "imported_class_method_call"), ("M.maker", "T.Root.ping", "imported_inherited_method_call"))
OPEN = (("self_method_not_found", "gone"), ("attribute_call", "ping"), ("attribute_call", "__init__"), ("name_call_unresolved", "nowhere"), ("attribute_call", "go"), ("attribute_call", "remove"), ("attribute_call", "own"), ("attribute_call", "ping"))
DEFINITIONS = (
    ("class", "M.Root"), ("class", "M.Child"), ("function", "M.Root.ping"), ("function", "M.Child.__init__"), ("function", "M.Child.run"), ("function", "M.Child.own"),
    ("function", "M.helper"), ("function", "M.helper.inner"), ("function", "M.second"), ("function", "M.make"), ("function", "M.made_twice"), ("function", "M.maker"), ("import", "os=os"), ("import", "far=T.helper"), ("import", "Far=T.Child"), ("import", "m@T=T"), ("import", "OrderedDict=collections.OrderedDict"),
)
_KEYS = "K AS (SELECT s_suppkey AS s, (s_suppkey + 1) % (SELECT count(*) FROM supplier) AS t FROM supplier)"


def sources(spark, d) -> DataFrame:
    """(path, source) of a module for each supplier."""
    suppliers = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    following = ((F.col("s_suppkey") + 1) % suppliers.count()).cast("string")
    text = F.lit(MODULE)
    for mark, value in (("@T", following), ("@S", F.col("s_suppkey").cast("string")), ("@N", F.col("s_nationkey").cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    return suppliers.select(F.concat(F.lit("pkg/m"), "s_suppkey", F.lit(".py")).alias("path"), text.alias("source"))


def _facts(spark, d) -> DataFrame:
    """The facts of all modules, parsed once and read as often as a query needs them."""
    return settle(python_facts(sources(spark, d)), "facts")


def _named(column: str) -> str:
    """SQL for a name of the lists above, with the module's own names in it."""
    return f"replace(regexp_replace(regexp_replace({column}, '(^|=)M([.]|$)', '\\1pkg.m' || s || '\\2'), '(^|=)T([.]|$)', '\\1pkg.m' || t || '\\2'), '@T', t::VARCHAR)"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


@query(f"WITH {_KEYS}, V(kind, name) AS (VALUES {_values(DEFINITIONS)}) SELECT 'pkg.m' || s AS module, kind, {_named('name')} AS name FROM K, V")
def q_python_facts(spark, d):
    facts = python_facts(sources(spark, d)).where("kind IN ('function', 'class', 'import')")
    name = F.when(F.col("kind") == "import", F.concat_ws("=", "name", "target")).otherwise(F.col("id"))
    return facts.select("module", "kind", name.alias("name"))


@query(f"WITH {_KEYS}, V(caller, callee, resolution) AS (VALUES {_values(CALLS)}) SELECT {_named('caller')} AS caller, {_named('callee')} AS callee, resolution FROM K, V")
def q_resolved_calls(spark, d):
    edges, _ = calls.resolve_calls(python_facts(sources(spark, d)))
    return edges.select("caller", "callee", "resolution")


@query(f"WITH {_KEYS}, V(pattern, name) AS (VALUES {_values(OPEN)}) SELECT 'pkg.m' || s AS module, pattern, name FROM K, V")
def q_unresolved_calls(spark, d):
    _, open_ = calls.resolve_calls(python_facts(sources(spark, d)))
    return open_.select("module", "pattern", "name")


@query(f"WITH {_KEYS}, V(caller, callee, resolution) AS (VALUES {_values((*CALLS, *BY_RETURNS))}) SELECT {_named('caller')} AS caller, {_named('callee')} AS callee, resolution FROM K, V")
def q_typed_calls(spark, d):
    edges, _ = calls.resolve_calls(python_facts(sources(spark, d)), by_returns=True)
    return edges.select("caller", "callee", "resolution")


@query(f"WITH {_KEYS}, V(caller, callee, resolution) AS (VALUES {_values(IMPORTED)}) SELECT {_named('caller')} AS caller, {_named('callee')} AS callee, resolution FROM K, V")
def q_imported_receivers(spark, d):
    facts = _facts(spark, d)
    return resolution.imported_receivers(facts, calls.aliases(facts), calls.symbols(facts), calls.resolved_bases(facts)).select("caller", "callee", "resolution")


@query(f"WITH {_KEYS}, V(fid, type) AS (VALUES ('M.make', 'M.Child'), ('M.made_twice', 'M.Child')) SELECT {_named('fid')} AS fid, 'class:' || {_named('type')} AS type FROM K, V")
def q_return_types(spark, d):
    facts = _facts(spark, d)
    return calls.known_returns(facts, calls.symbols(facts), calls.aliases(facts)).select(F.col("path").alias("fid"), "type")


@query(f"WITH {_KEYS}, V(class, method) AS (VALUES ('Root', 'ping'), ('Child', '__init__'), ('Child', 'run'), ('Child', 'own')) SELECT 'pkg.m' || s AS module, class, count(*) AS methods, string_agg(method, ',' ORDER BY method) AS names FROM K, V GROUP BY 1, 2")
def q_module_tree(spark, d):
    return profile.module_tree(_facts(spark, d)).select("module", F.inline("classes")).where("class IS NOT NULL").select("module", "class", F.size("methods").cast("long").alias("methods"), F.concat_ws(",", "methods").alias("names"))


@query("""WITH P AS (SELECT DISTINCT s_suppkey // 2 AS p FROM supplier WHERE s_suppkey % 2 = 1)
SELECT 'add_' || 2 * p AS function_1, 'add_' || 2 * p + 1 AS function_2, 'SAFE_LOGICAL_DUPLICATE' AS duplicate_type, true AS auto_merge_safe FROM P""")
def q_duplicate_functions(spark, d):
    """Two suppliers share a body, whose operators spell the number of the pair, so that no other body is as similar."""
    s = load(spark, d, "supplier").select("s_suppkey")
    steps = F.array_join(F.transform(F.split(F.bin(F.expr("s_suppkey DIV 2")), ""), lambda b: F.when(b == "1", "+ b").otherwise("- b")), " ")
    text = F.concat(F.lit("def add_"), "s_suppkey", F.lit("(a, b):\n    t = a "), steps, F.lit("\n    return t\n"))
    files = s.select(F.concat(F.lit("pkg/d"), "s_suppkey", F.lit(".py")).alias("path"), text.alias("source"))
    found = duplicates.find_duplicates(function_bodies(python_facts(files, bodies=True)))
    return found.select("function_1", "function_2", "duplicate_type", "auto_merge_safe")


@query(f"WITH {_KEYS} SELECT 'pkg.m' || s || '.Child.run' AS caller, 'pkg.m' || s || '.Root.ping' AS callee, 'local_typed_method_call' AS resolution FROM K")
def q_attribute_types(spark, d):
    facts = _facts(spark, d)
    # names that one class alone has are unique; here each module has its own, so types are found by module
    classes = facts.where("kind = 'class'").select(F.concat_ws(".", "module", "name").alias("name"), F.col("id").alias("path"))
    made = facts.where("kind = 'assign' AND name LIKE 'self.%'").select(F.concat_ws(".", "module", "class").alias("class_path"), F.substr("name", F.lit(6)).alias("attr"), F.concat_ws(".", "module", "target").alias("name"))
    types = made.join(classes, "name").select("class_path", "attr", F.col("path").alias("type"))
    return resolution.attribute_calls(facts, types, calls.symbols(facts), calls.resolved_bases(facts)).select("caller", "callee", "resolution")


@query(f"WITH {_KEYS} SELECT 'pkg.m' || s || '.Child' AS path, 'pkg.m' || s || '.Root' AS ancestor FROM K")
def q_ancestors(spark, d):
    return calls.ancestors(calls.resolved_bases(_facts(spark, d))).select("path", "ancestor")


@query(f"""WITH {_KEYS} SELECT 'pkg.m' || s AS file, 'pkg.m' || s || '.second' AS function, call, severity FROM K, (VALUES ('os.remove', 'REVIEW'), ('eval', 'BLOCK')) V(call, severity)""")
def q_dangerous_calls(spark, d):
    facts = settle(python_facts(sources(spark, d)).where("kind = 'call' AND target IS NOT NULL"), "called")
    made = facts.select(F.col("module").alias("file"), F.col("id").alias("function"), F.col("lineno").alias("line"), F.col("target").alias("call"))
    none = spark.createDataFrame([], "file string, function string, line int, name string")
    found = govern.findings(made, none)
    return found.join(made, ["file", "function", "line"]).select("file", "function", "call", "severity")
