"""Call resolution over facts, as joins.

Every definition has one dotted path, so all ordered rules become candidate rows (call, rank, path, label) that meet the
symbol table in a single equi-join; the smallest rank wins. What no rule resolves is external, builtin (dropped) or an
unresolved row with its pattern, and each call is in exactly one of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import words
from loomstone.operators.joins import first_match
from loomstone.tables import settle, union_all

#: Names that call nothing of the repository.
BUILTINS = (
    "print len range open str int float list dict set tuple bool isinstance super enumerate zip map filter sorted sum min max abs getattr setattr "
    "hasattr type repr format round any all next iter id hash vars callable issubclass frozenset bytes bytearray object property staticmethod "
    "classmethod slice reversed divmod pow chr ord hex oct bin globals locals input exec eval compile __import__ delattr memoryview complex "
    "Exception ValueError TypeError KeyError IndexError AttributeError RuntimeError StopIteration FileNotFoundError NotImplementedError OSError "
    "IOError ZeroDivisionError ImportError NameError AssertionError Warning DeprecationWarning PermissionError TimeoutError"
).split()
#: Methods that come with common base classes of the standard library.
INHERITED = (
    "generic_visit visit visit_Module __post_init__ __repr__ __str__ __eq__ __hash__ __len__ __iter__ __next__ __enter__ __exit__ assertEqual "
    "assertNotEqual assertTrue assertFalse assertIs assertIsNot assertIsNone assertIsNotNone assertIn assertNotIn assertIsInstance "
    "assertNotIsInstance assertRaises assertRaisesRegex assertWarns assertLogs assertAlmostEqual assertNotAlmostEqual assertGreater "
    "assertGreaterEqual assertLess assertLessEqual assertRegex assertNotRegex assertCountEqual assertListEqual assertDictEqual assertSetEqual "
    "assertTupleEqual assertMultiLineEqual assertSequenceEqual setUp tearDown setUpClass tearDownClass fail skipTest"
).split()


def symbols(facts: DataFrame) -> DataFrame:
    """(path, callee, kind): what a dotted path stands for; a class stands for its __init__ or <class>."""
    functions = facts.where("kind = 'function'").select(F.col("id").alias("path"), F.col("id").alias("callee"), F.when(F.col("target") == "class", "method").when(F.col("target") == "function", "nested").otherwise("function").alias("kind"))
    inits = facts.where("kind = 'function' AND name = '__init__' AND target = 'class'").select(F.concat_ws(".", "module", F.concat_ws(".", "scope")).alias("path"), F.col("id").alias("init"))
    classes = facts.where("kind = 'class'").select(F.col("id").alias("path")).distinct().join(inits.distinct(), "path", "left")
    classes = classes.select("path", F.coalesce("init", F.concat("path", F.lit(".<class>"))).alias("callee"), F.lit("class").alias("kind"))
    return functions.union(classes).distinct()


def aliases(facts: DataFrame) -> DataFrame:
    """(module, name, target): absolute dotted target of each local import name; the last import of a name wins."""
    imports = facts.where("kind = 'import'")
    packages = facts.select("module").distinct()
    inner = packages.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("module", r"\."))), lambda n: F.array_join(F.slice(F.split("module", r"\."), 1, n), "."))).alias("p"), "module").where("p <> module").select(F.col("p").alias("module")).distinct().withColumn("is_package", F.lit(True))
    level = F.get("items", 0).cast("int")
    parts = F.split("module", r"\.")
    up = F.when(F.coalesce("is_package", F.lit(False)), level - 1).otherwise(level)
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0)))
    target = F.when(level == 0, F.col("target")).otherwise(F.concat_ws(".", base, F.when(F.col("target") != "", F.col("target"))))
    return imports.join(inner, "module", "left").select("module", "name", target.alias("target"), "seq").groupBy("module", "name").agg(F.max_by("target", "seq").alias("target"))


def resolved_bases(facts: DataFrame) -> DataFrame:
    """(path, ord, base): bases of each class, in order, by same module first, then by import; unknown ones are raw."""
    classes = facts.where("kind = 'class'")
    raw = classes.select("module", F.col("id").alias("path"), F.posexplode("items").alias("ord", "raw"))
    head, rest = F.split("raw", r"\.", 2)[0], F.get(F.split("raw", r"\.", 2), 1)
    known = classes.select(F.col("id").alias("known")).distinct()
    named = aliases(facts).select(F.col("module").alias("a_module"), F.col("name").alias("a_name"), F.col("target").alias("a_target"))
    out = raw.withColumns({"head": head, "rest": rest, "here": F.concat_ws(".", "module", "raw")})
    out = out.join(known, F.col("here") == F.col("known"), "left").join(named, (F.col("module") == F.col("a_module")) & (F.col("head") == F.col("a_name")), "left")
    return out.select("path", "ord", F.when(F.col("known").isNotNull(), F.col("known")).when(F.col("a_target").isNotNull(), F.concat_ws(".", "a_target", "rest")).otherwise(F.col("raw")).alias("base"), "raw")


def ancestors(bases: DataFrame) -> DataFrame:
    """(path, ancestor, place): ancestors by depth-first order; place sorts them, cycles end."""
    bases = settle(bases.select("path", "ord", "base"), "ancestor-bases")  # once, not once a round
    step = bases.select(F.col("path").alias("from"), "ord", "base")
    live = bases.select("path", F.col("base").alias("ancestor"), F.array("ord").alias("place"), F.array("path", "base").alias("seen"))
    found = []
    while True:  # a chain ends where it has no new base, at whatever depth
        live = settle(live, "ancestors")
        if live.isEmpty():
            break
        found.append(live.select("path", "ancestor", "place"))
        nxt = live.join(step, F.col("ancestor") == F.col("from")).where(~F.array_contains("seen", F.col("base")))
        live = nxt.select("path", F.col("base").alias("ancestor"), F.concat("place", F.array("ord")).alias("place"), F.concat("seen", F.array("base")).alias("seen"))
    out = union_all(found) if found else live.select("path", "ancestor", "place")
    return out.groupBy("path", "ancestor").agg(F.min("place").alias("place"))


def call_paths(rows: DataFrame, table: DataFrame, named: DataFrame) -> DataFrame:
    """rows (module, target) with path and path_kind: what the target names in the module itself, else by an import."""
    known = table.select("path", F.col("kind").alias("path_kind"))
    local, far = known.toDF("l_path", "l_kind"), known.toDF("f_path", "f_kind")
    alias = named.select(F.col("module").alias("n_module"), F.col("name").alias("n_name"), F.col("target").alias("n_target"))
    head = F.split("target", r"\.", 2)
    out = rows.withColumns({"here": F.concat_ws(".", "module", "target"), "head": head[0], "rest": F.get(head, 1)})
    out = out.join(local, F.col("here") == F.col("l_path"), "left").join(alias, (F.col("module") == F.col("n_module")) & (F.col("head") == F.col("n_name")), "left")
    out = out.withColumn("there", F.concat_ws(".", "n_target", "rest")).join(far, F.col("there") == F.col("f_path"), "left")
    return out.select(*rows.columns, F.coalesce("l_path", "f_path").alias("path"), F.coalesce("l_kind", "f_kind").alias("path_kind"))


_BUILTIN_TYPES = ("list", "dict", "set", "str")


def known_returns(facts: DataFrame, table: DataFrame, named: DataFrame) -> DataFrame:
    """(path, type): functions all of whose returns have one type, through the calls that they return."""
    rows = facts.where("kind = 'return' AND NOT endswith(id, '.<module>')").select("module", F.col("id").alias("fid"), F.get("items", 0).alias("shape"), "target")
    rows = call_paths(rows, table, named)
    built = (F.col("shape") == "builtin") & F.col("target").isin(*_BUILTIN_TYPES)
    made = (F.col("shape") == "call") & (F.col("path_kind") == "class")
    called = (F.col("shape") == "call") & F.col("path_kind").isin("function", "nested", "method")
    kind = F.when(built | made, "type").when(called, "call").otherwise("unknown")
    value = F.when(built, F.concat(F.lit("builtin:"), "target")).when(made, F.concat(F.lit("class:"), "path")).otherwise(F.col("path"))
    typed = return_types(settle(rows.select("fid", kind.alias("kind"), value.alias("value")), "returns"))
    return typed.where("label <> 'AMBIGUOUS'").select(F.col("fid").alias("path"), F.element_at("types", 1).alias("type"))


def variable_types(facts: DataFrame, table: DataFrame, named: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    """(module, scope, var, seq, type): each plain assignment's type, null where it isn't known.

    type is builtin:<name> or class:<path>; with `returns` (path, type) a called function gives its type.
    """
    assigned = facts.where("kind = 'assign' AND NOT contains(name, '.')").select("module", F.concat_ws(".", "scope").alias("scope"), F.col("name").alias("var"), "seq", F.get("items", 0).alias("shape"), "target")
    out = call_paths(assigned, table, named)
    kind = F.when((F.col("shape") == "builtin") & F.col("target").isin(*_BUILTIN_TYPES), F.concat(F.lit("builtin:"), "target")).when((F.col("shape") == "call") & (F.col("path_kind") == "class"), F.concat(F.lit("class:"), "path"))
    out = out.withColumn("type", kind)
    if returns is not None:
        out = out.join(returns.toDF("path", "returned"), "path", "left").withColumn("type", F.coalesce("type", F.when(F.col("shape") == "call", F.col("returned"))))
    return out.select("module", "scope", "var", "seq", "type")


def typed_receivers(calls: DataFrame, types: DataFrame) -> DataFrame:
    """(call, type): the type of a one-name receiver at the call: innermost scope first, the last assignment before it."""
    from loomstone.operators.joins import as_of

    one = calls.where(F.size("items") == 2).select("call", "module", F.get("items", 0).alias("var"), "seq", "scope")
    levels = F.transform(F.sequence(F.lit(0), F.size("scope")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("scope", 1, n), ".").alias("scope")))
    at = one.select("call", "module", "var", "seq", F.inline(levels))
    seen = as_of(at, types, ["module", "scope", "var"], ["seq"], "type", "type").where("type IS NOT NULL")
    return seen.groupBy("call").agg(F.max_by("type", "depth").alias("type"))


def resolve_calls(facts: DataFrame, by_returns: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges: module, caller, callee, lineno, resolution; unresolved: module, lineno, pattern, name).

    With `by_returns` a variable that a function's result is assigned to has the type which the function returns.
    """
    facts = settle(facts, "facts")
    table, named, bases = settle(symbols(facts), "symbols"), settle(aliases(facts), "aliases"), settle(resolved_bases(facts), "bases")
    roots = facts.select(F.split("module", r"\.")[0].alias("root")).distinct()
    calls = facts.where("kind = 'call'").select(F.concat_ws("#", "module", "seq").alias("call"), "module", F.col("id").alias("caller"), "name", "items", "scope", "class", "lineno", "seq")
    calls = calls.withColumn("head", F.get("items", 0))
    alias = named.select(F.col("module").alias("n_module"), F.col("name").alias("n_name"), F.col("target").alias("alias"))
    calls = settle(calls.join(alias, (F.col("module") == F.col("n_module")) & (F.col("head") == F.col("n_name")), "left").drop("n_module", "n_name"), "calls")
    returns = known_returns(facts, table, named) if by_returns else None
    types = typed_receivers(calls, variable_types(facts, table, named, returns))
    calls = settle(calls.join(types, "call", "left"), "calls")
    plain, own = F.size("items") == 1, (F.size("items") == 2) & (F.col("head") == "self") & F.col("class").isNotNull()
    rest = F.array_join(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), ".")
    at = lambda *p: F.concat_ws(".", *p)
    nested = F.transform(F.sequence(F.size("scope"), F.lit(1), F.lit(-1)), lambda n: F.struct((F.lit(100) - n).alias("rank"), at("module", F.array_join(F.slice("scope", 1, n), "."), "name").alias("path"), F.lit("nested_function_call").alias("label"), F.lit("nested").alias("want")))
    cand = lambda rank, path, label, want: F.struct(F.lit(rank).alias("rank"), path.alias("path"), F.lit(label).alias("label"), F.lit(want).alias("want"))
    by_name = F.concat(
        F.array(cand(1, at("module", "name"), "direct_name_call", "function"), cand(2, at("module", "class", "name"), "same_class_name_call", "method"), cand(3, at("module", "name"), "same_module_class_call", "class")),
        F.when(F.size("scope") > 0, nested).otherwise(F.array().cast("array<struct<rank:int,path:string,label:string,want:string>>")),
        F.array(cand(200, F.col("alias"), "imported_call", "any")),
    )
    by_path = F.array(
        cand(1, F.array_join("items", "."), "qualified_module_call", "any"), cand(2, at("alias", rest), "qualified_module_call", "any"),
        cand(3, F.concat_ws(".", F.regexp_extract("type", "^class:(.*)$", 1), "name"), "local_typed_method_call", "method"),
    )
    none = F.array().cast("array<struct<rank:int,path:string,label:string,want:string>>")
    options = F.when(plain, by_name).when(own, F.array(cand(1, at("module", "class", "name"), "self_method_call", "method"))).when(F.size("items") > 1, by_path).otherwise(none)
    tried = calls.select("call", F.inline(options)).where("path IS NOT NULL AND NOT (rank = 2 AND label = 'qualified_module_call' AND NOT contains(path, '.'))")
    # methods of ancestors: of the own class, or of the receiver's type
    family = ancestors(bases)
    start = calls.select("call", "name", F.when(own, at("module", "class")).when(F.col("type").startswith("class:"), F.substr("type", F.lit(7))).alias("start"), F.when(own, "inherited_method_call").otherwise("local_typed_method_call").alias("label")).where("start IS NOT NULL")
    up = start.join(family, F.col("start") == F.col("path")).select("call", (F.lit(1000)).alias("rank"), at("ancestor", "name").alias("path"), "label", F.lit("method").alias("want"), "place")
    tried = tried.withColumn("place", F.array().cast("array<int>")).unionByName(up)
    hit = tried.join(table, "path").where("want = 'any' OR want = kind")
    best = first_match(hit.select("call", "rank", "place", "path", "callee", "label"), ["call"], ["rank", "place", "path"])
    out = calls.join(best.select("call", "callee", "label"), "call", "left")
    out = out.withColumn("alias_root", F.split("alias", r"\.")[0]).join(roots.select(F.col("root").alias("known_root")), F.col("alias_root") == F.col("known_root"), "left")
    raw = bases.groupBy(F.col("path").alias("r_path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "raw"))), lambda x: x["raw"]), "/").alias("raw"))
    out = out.withColumn("own_class", at("module", "class")).join(raw, F.col("own_class") == F.col("r_path"), "left")
    external = plain & F.col("alias").isNotNull() & F.col("known_root").isNull()
    builtin_method = (F.size("items") == 2) & F.col("type").startswith("builtin:")
    inherited = own & F.col("name").isin(*INHERITED) & F.col("raw").isNotNull()
    callee = F.coalesce("callee", F.when(external, F.concat(F.lit("<external>."), "alias")).when(builtin_method, F.concat(F.lit("<builtin>."), F.substr("type", F.lit(9)), F.lit("."), "name")).when(inherited, F.concat(F.lit("<external>."), "raw", F.lit("."), "name")))
    label = F.coalesce("label", F.when(external, "external_constructor_call").when(builtin_method, "local_builtin_method_call").when(inherited, "external_inherited_call"))
    out = settle(out.select("module", "caller", callee.alias("callee"), "lineno", label.alias("resolution"), F.when(plain, "name_call_unresolved").when(own, "self_method_not_found").otherwise("attribute_call").alias("pattern"), (plain & F.col("name").isin(*BUILTINS)).alias("dropped"), "name"), "resolved")
    edges = out.where("callee IS NOT NULL").select("module", "caller", "callee", "lineno", "resolution")
    errors = facts.where("kind = 'parse_error'").select("module", F.lit(None).cast("int").alias("lineno"), F.lit("parse_error").alias("pattern"), F.col("target").alias("name"))
    return edges, out.where("callee IS NULL AND NOT dropped").select("module", "lineno", "pattern", "name").unionByName(errors)


def return_types(atoms: DataFrame) -> DataFrame:
    """(fid, types, label): the fixed point of return types over atoms (fid, kind: type, call or unknown; value).

    A function is typed once all its atoms are; one unknown atom, or a call of something never typed, leaves it untyped.
    One type is RESOLVED, several are AMBIGUOUS, and types that came through calls are INFERRED.
    """
    known = atoms.where("kind = 'type'").select("fid", F.col("value").alias("type"), F.lit(False).alias("through"))
    bad = atoms.where("kind = 'unknown'").select("fid").distinct()
    open_ = atoms.where("kind = 'call'").select("fid", F.col("value").alias("target")).join(bad, "fid", "left_anti")
    plain = known.join(bad, "fid", "left_anti").join(open_.select("fid").distinct(), "fid", "left_anti")
    done = settle(plain.distinct(), "types")
    count = done.count()
    while True:
        have = done.select(F.col("fid").alias("target"), F.col("type").alias("t_type"))
        missing = open_.join(have.select("target").distinct(), "target", "left_anti").select("fid").distinct()
        ready = open_.join(missing, "fid", "left_anti")
        more = ready.join(have, "target").select("fid", F.col("t_type").alias("type"), F.lit(True).alias("through"))
        own = known.join(ready.select("fid").distinct(), "fid", "left_semi")
        done = settle(done.unionByName(more).unionByName(own).distinct(), "types")
        now = done.count()
        if now == count:
            break
        count = now
    label = F.when(F.size("types") > 1, "AMBIGUOUS").when(F.col("through"), "INFERRED").otherwise("RESOLVED")
    return done.groupBy("fid").agg(F.array_sort(F.collect_set("type")).alias("types"), F.max("through").alias("through")).select("fid", "types", label.alias("label"))


def linearise(bases: DataFrame, group: str) -> DataFrame:
    """(group, path, mro): C3 order of each class; null where no order exists. One group is one repository's classes."""
    import pandas as pd

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        parents = {p: list(b.sort_values("ord")["base"]) for p, b in frame.groupby("path")}
        done: dict[str, list[str] | None] = {}

        def order(name: str, active: tuple[str, ...] = ()) -> list[str] | None:
            if name in active:
                return None
            if name not in done:
                lists = [order(p, (*active, name)) for p in parents.get(name, [])]
                done[name] = None if None in lists else merge(name, [*lists, parents.get(name, [])])
            return done[name]

        def merge(name: str, lists: list[list[str]]) -> list[str] | None:
            out, lists = [name], [list(x) for x in lists if x]
            while lists:
                head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
                if head is None:
                    return None
                out.append(head)
                lists = [y for x in lists if (y := [v for v in x if v != head])]
            return out

        key = frame[group].iloc[0]
        rows = [(key, p, order(p)) for p in parents]
        return pd.DataFrame(rows, columns=[group, "path", "mro"])

    return bases.select(group, "path", "ord", "base").groupBy(group).applyInPandas(each, f"{group} string, path string, mro array<string>")


def package_root(imports: DataFrame, share: float = 0.5) -> DataFrame:
    """(root, n, share): the root of most absolute imports, if it has the share."""
    votes = imports.groupBy("root").agg(F.count("*").alias("n"))
    total = votes.agg(F.sum("n").alias("total"))
    return votes.crossJoin(total).where(F.col("n") / F.col("total") >= share).orderBy(F.desc("n"), "root").limit(1).select("root", "n", (F.col("n") / F.col("total")).alias("share"))


def unresolved_by_pattern(unresolved: DataFrame, most: int = 5) -> DataFrame:
    """(pattern, n, examples)."""
    return unresolved.groupBy("pattern").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(F.concat_ws(":", "module", "lineno"))), 1, most).alias("examples"))


def unresolved_cause(name, pattern) -> F.Column:
    """Why a call stays unresolved, by the name that is called; the last two are guesses from the way names are written."""
    first = F.substring(name, 1, 1)
    return (
        F.when(pattern == "parse_error", "parse_error")
        .when(F.coalesce(name, F.lit("")) == "", "attribute_type_unknown")
        .when(name.isin(*words.FRAMEWORK_HELPERS), "framework_helper")
        .when(name.isin(*words.CLASS_ALIASES), "class_alias")
        .when(name.isin(*words.BUILTIN_METHODS), "builtin_like")
        .when(first.rlike(r"^\p{Ll}"), "name_suggests_object_method_unconfirmed")
        .when(first.rlike(r"^\p{Lu}"), "name_suggests_external_class_unconfirmed")
        .otherwise("attribute_type_unknown")
    )
