"""Further resolution joins: types of receivers, interfaces, packages, tests, dispatch tables, and the deep cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators.calls import ancestors
from loomstone.operators.joins import agreeing, first_match
from loomstone.tables import settle


def attribute_types(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_path, attr, type): attributes of self that every assignment in the class gives the same class.

    classes: (name, path) with one path per name in the module's sight; an untypeable assignment leaves the attribute out.
    """
    own = facts.where("kind = 'assign' AND name LIKE 'self.%' AND class IS NOT NULL")
    own = own.select(F.concat_ws(".", "module", "class").alias("class_path"), F.substr("name", F.lit(6)).alias("attr"), F.when(F.get("items", 0) == "call", F.col("target")).alias("made"))
    typed = own.join(classes.select(F.col("name").alias("made"), F.col("path").alias("type")), "made", "left")
    return agreeing(typed, ["class_path", "attr"], "type")


def attribute_calls(facts: DataFrame, types: DataFrame, symbols: DataFrame, bases: DataFrame) -> DataFrame:
    """Edges of self.attr.method() by the attribute's type: its own method first, then the nearest ancestor's."""
    calls = facts.where("kind = 'call' AND size(items) = 3 AND items[0] = 'self' AND class IS NOT NULL")
    at = calls.select("module", F.col("id").alias("caller"), "lineno", F.concat_ws(".", "module", "class").alias("class_path"), F.get("items", 1).alias("attr"), "name", "seq").join(types, ["class_path", "attr"])
    family = ancestors(bases).select(F.col("path").alias("type"), "ancestor", "place")
    own = at.select("*", F.col("type").alias("holder"), F.array().cast("array<int>").alias("place"))
    up = at.join(family, "type").select(*at.columns, F.col("ancestor").alias("holder"), "place")
    hit = own.unionByName(up).withColumn("path", F.concat_ws(".", "holder", "name")).join(symbols.where("kind = 'method'").select("path", "callee"), "path")
    best = first_match(hit.select("module", "seq", "caller", "lineno", "callee", "place"), ["module", "seq"], ["place", "callee"])
    label = F.when(F.size("place") == 0, "local_typed_method_call").otherwise("local_inherited_method_call")
    return best.select("module", "caller", "callee", "lineno", label.alias("resolution"))


def imported_receivers(facts: DataFrame, named: DataFrame, symbols: DataFrame, bases: DataFrame) -> DataFrame:
    """Edges of Name.method() where Name is an imported class: its own method first, then the nearest ancestor's."""
    classes = symbols.where("kind = 'class'").select(F.col("path").alias("holder"))
    alias = named.select("module", F.col("name").alias("var"), F.col("target").alias("holder")).join(classes, "holder")
    calls = facts.where("kind = 'call' AND size(items) = 2").select("module", F.col("id").alias("caller"), "lineno", F.get("items", 0).alias("var"), "name", "seq")
    at = settle(calls.join(alias, ["module", "var"]), "imported-receivers")
    family = ancestors(bases).select(F.col("path").alias("holder"), "ancestor", "place")
    own = at.withColumn("place", F.array().cast("array<int>"))
    up = at.join(family, "holder").select(*(F.col("ancestor").alias("holder") if c == "holder" else c for c in at.columns), "place")
    hit = own.unionByName(up).withColumn("path", F.concat_ws(".", "holder", "name")).join(symbols.where("kind = 'method'").select("path", "callee"), "path")
    best = first_match(hit.select("module", "seq", "caller", "lineno", "callee", "place"), ["module", "seq"], ["place", "callee"])
    label = F.when(F.size("place") == 0, "imported_class_method_call").otherwise("imported_inherited_method_call")
    return best.select("module", "caller", "callee", "lineno", label.alias("resolution"))


def annotated_calls(facts: DataFrame, named: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of var.method() where an annotation in the same function gives var's class: of the module, or imported.

    named: (module, name, target) of imports.
    """
    marks = facts.where("kind = 'annotation'").select("module", F.col("id").alias("caller"), F.col("name").alias("var"), "target")
    head = F.split("target", r"\.", 2)
    marks = marks.withColumns({"head": head[0], "rest": F.get(head, 1)})
    alias = named.select(F.col("module").alias("n_module"), F.col("name").alias("n_name"), F.col("target").alias("alias"))
    marks = marks.join(alias, (F.col("module") == F.col("n_module")) & (F.col("head") == F.col("n_name")), "left")
    holders = F.array(F.concat_ws(".", "module", "target"), F.when(F.col("alias").isNotNull(), F.concat_ws(".", "alias", "rest")))
    marks = marks.select("module", "caller", "var", F.posexplode(holders).alias("place", "holder")).where("holder IS NOT NULL")
    calls = facts.where("kind = 'call' AND size(items) = 2").select("module", F.col("id").alias("caller"), F.get("items", 0).alias("var"), "name", "lineno", "seq")
    hit = calls.join(marks, ["module", "caller", "var"]).withColumn("path", F.concat_ws(".", "holder", "name")).join(symbols.where("kind = 'method'").select("path", "callee"), "path")
    best = first_match(hit.select("module", "seq", "caller", "lineno", "callee", "place"), ["module", "seq"], ["place", "callee"])
    return best.select("module", "caller", "callee", "lineno", F.lit("annotated_method_call").alias("resolution"))


def unknown_calls(calls: DataFrame, functions: DataFrame, ignored: list[str]) -> DataFrame:
    """calls (file, call) that are no function of the index, neither whole nor by the last segment, and not ignored."""
    short = F.element_at(F.split("call", r"\."), -1)
    known = functions.select(F.col("name").alias("known")).distinct()
    left = calls.where(~F.col("call").isin(*ignored) & ~short.isin(*ignored))
    return left.join(known, F.col("call") == F.col("known"), "left_anti").join(known, short == F.col("known"), "left_anti")


def super_calls(facts: DataFrame, orders: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of super().method(): the first class after the own one in its C3 order that has the method.

    orders: (path, mro); a class without an order gives no edge.
    """
    calls = facts.where("kind = 'call' AND items[0] = 'super()' AND class IS NOT NULL").select("module", F.col("id").alias("caller"), "lineno", "name", "seq", F.concat_ws(".", "module", "class").alias("path"))
    after = calls.join(orders.where("mro IS NOT NULL"), "path").select("module", "caller", "lineno", "name", "seq", F.posexplode(F.slice("mro", F.lit(2), F.greatest(F.size("mro") - 1, F.lit(0)))).alias("place", "holder"))
    hit = after.withColumn("path", F.concat_ws(".", "holder", "name")).join(symbols.where("kind = 'method'").select("path", "callee"), "path")
    best = first_match(hit.select("module", "seq", "caller", "lineno", "callee", "place"), ["module", "seq"], ["place"])
    return best.select("module", "caller", "callee", "lineno", F.lit("super_call").alias("resolution"))


def unique_names(classes: DataFrame) -> DataFrame:
    """(name, path): bare class names that one class in the repository has."""
    return classes.groupBy("name").agg(F.countDistinct("path").alias("_n"), F.min("path").alias("path")).where("_n = 1").drop("_n")


def simple_type(refs: DataFrame, classes: DataFrame, imports: DataFrame) -> DataFrame:
    """refs (file, package, name) with path and label: explicit import, same package, unique in the repository, else why not.

    classes: (package, name, path); imports: (file, name, path).
    """
    imported = imports.select("file", "name", F.col("path").alias("by_import"))
    same = classes.select("package", "name", F.col("path").alias("by_package"))
    alone = classes.groupBy("name").agg(F.countDistinct("path").alias("n"), F.min("path").alias("by_name"))
    out = refs.join(imported, ["file", "name"], "left").join(same, ["package", "name"], "left").join(alone, "name", "left")
    path = F.coalesce("by_import", "by_package", F.when(F.col("n") == 1, F.col("by_name")))
    label = F.when(path.isNotNull(), "RESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("EXTERNAL")
    return out.select("file", "package", "name", path.alias("path"), label.alias("label"))


def interface_calls(calls: DataFrame, implements: DataFrame, methods: DataFrame) -> DataFrame:
    """calls (caller, receiver_type, name) through an interface, bound to the first class that implements it.

    implements: (class, interface); methods: (class, name). Only methods that the class has are bound.
    """
    at = calls.join(implements, F.col("receiver_type") == F.col("interface")).join(methods.select("class", "name").distinct(), ["class", "name"])
    best = first_match(at.select("caller", "receiver_type", "name", "class"), ["caller", "receiver_type", "name"], ["class"])
    return best.select("caller", F.concat_ws(".", "class", "name").alias("callee"), F.lit("interface_call").alias("resolution"))


def tests_of(files: DataFrame, path: str = "path") -> DataFrame:
    """(source, test): sources and the tests that their names point to."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    base = F.regexp_replace(F.regexp_replace(stem, r"^test_", ""), r"(_test|Test|Tests|\.test|\.spec)$", "")
    named = files.select(F.col(path).alias("path"), stem.alias("stem"), base.alias("base"))
    tests = named.where("stem <> base").select(F.col("path").alias("test"), "base")
    return named.where("stem = base").select(F.col("path").alias("source"), F.col("stem").alias("base")).join(tests, "base").select("source", "test")


def traceability(files: DataFrame, path: str = "path") -> DataFrame:
    """One row: sources, tested ones, percent, and whether a test harness is needed (under 30 %)."""
    from loomstone.functions.paths import path_class

    source = files.where(path_class(F.col(path)) != "test").select(F.col(path).alias("source")).distinct()
    tested = source.join(tests_of(files, path).select("source").distinct().withColumn("t", F.lit(True)), "source", "left")
    out = tested.agg(F.count("*").alias("sources"), F.count_if(F.col("t")).alias("tested"))
    percent = F.when(F.col("sources") > 0, F.round(F.col("tested") * 100 / F.col("sources"), 2))
    return out.withColumn("percent", percent).withColumn("needs_harness", F.col("percent") < 30)


def namespace_bridge(packages: DataFrame) -> DataFrame:
    """(short, full): packages whose parent folder is no package, so that src.flask is known as flask."""
    parts = F.split("package", r"\.")
    named = packages.select("package", F.element_at(parts, -1).alias("short"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".").alias("parent"))
    top = named.join(packages.select(F.col("package").alias("parent")), "parent", "left_anti").where("package <> short")
    return top.select("short", F.col("package").alias("full"))


def without_source_root(rows: DataFrame, columns: list[str], root: str = "src.") -> DataFrame:
    """The rows with the root's prefix taken off the ids in the columns."""
    return rows.withColumns({c: F.when(F.col(c).startswith(root), F.substr(c, F.lit(len(root) + 1))).otherwise(F.col(c)) for c in columns})


def registry_dispatch(facts: DataFrame) -> DataFrame:
    """(module, caller, callees, label): calls REG[k]() and REG.get(k)() with all that the module puts into the registry.

    The set is bounded but which member is called stays open, so its label is UNCERTAIN and it gives no edges.
    """
    calls = facts.where("kind = 'dispatch'").select("module", F.col("id").alias("caller"), F.col("name").alias("registry"))
    held = facts.where("kind = 'entry'").groupBy("module", F.col("name").alias("registry")).agg(F.array_sort(F.collect_set("target")).alias("callees"))
    return calls.join(held, ["module", "registry"]).select("module", "caller", "callees", F.lit("UNCERTAIN").alias("label"))


#: In order, what each resolver of the cascade takes.
BUILTIN_METHODS = "append extend insert remove pop clear index count sort reverse keys values items get update setdefault add discard union join split strip lstrip rstrip replace format startswith endswith lower upper encode decode".split()
REFLECTION = "getattr setattr hasattr __import__ import_module eval exec".split()


def deep_cascade(unresolved: DataFrame, origins: DataFrame, methods: DataFrame, bases: DataFrame) -> DataFrame:
    """unresolved (module, name, variable) with resolver: the first of builtin, constructor, factory, property,
    inheritance, reflection that explains the call, else null.

    origins: (module, variable, origin: class:<path>, call:<id> or property:<path>), the last one per variable;
    methods: (class, name). One pass of boolean columns; a builtin is told by its method name alone, so counts are no edges.
    """
    at = unresolved.join(origins, ["module", "variable"], "left").withColumn("made", F.regexp_extract("origin", "^class:(.*)$", 1))
    own = methods.select(F.col("class").alias("made"), "name", F.lit(True).alias("own")).distinct()
    up = ancestors(bases).select(F.col("path").alias("made"), F.col("ancestor").alias("class")).join(methods, "class").select("made", "name", F.lit(True).alias("above")).distinct()
    at = at.join(own, ["made", "name"], "left").join(up, ["made", "name"], "left")
    resolver = (
        F.when(F.col("name").isin(*BUILTIN_METHODS), "builtin").when(F.col("own"), "constructor").when(F.col("origin").startswith("call:"), "factory")
        .when(F.col("origin").startswith("property:"), "property").when(F.col("above"), "inheritance").when(F.col("name").isin(*REFLECTION), "reflection")
    )
    return at.select("module", "name", "variable", resolver.alias("resolver"))


def last_origins(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(module, variable, origin): the last assignment of each variable in the module, whatever its scope."""
    made = facts.where("kind = 'assign'").select("module", F.col("name").alias("variable"), "seq", F.concat_ws(".", "module", "target").alias("path"), F.get("items", 0).alias("shape"))
    known = symbols.where("kind = 'class'").select("path", F.lit(True).alias("is_class"))
    out = made.join(known, "path", "left").withColumn("origin", F.when(F.col("is_class"), F.concat(F.lit("class:"), "path")).when(F.col("shape") == "call", F.concat(F.lit("call:"), "path")))
    return out.groupBy("module", "variable").agg(F.max_by("origin", "seq").alias("origin"))


def script_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file, target) of JavaScript with path: relative targets as they are, with an extension, or an index file."""
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    parts = F.split(F.concat_ws("/", F.when(folder != "", folder), "target"), "/")

    def enter(path, part):
        """One step of a path: `.` stays, `..` goes up where there is something above, all else goes down."""
        up = (part == "..") & (F.size(path) > 0) & (F.coalesce(F.element_at(F.concat(F.array(F.lit("")), path), -1), F.lit("")) != "..")
        return F.when(part.isin(".", ""), path).when(up, F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(F.concat(path, F.array(part)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), enter), "/")
    tails = ["", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.jsx", "/index.ts", "/index.tsx"]
    tried = imports.where(F.col("target").startswith(".")).select("file", "target", F.posexplode(F.array(*(F.concat(joined, F.lit(t)) for t in tails))).alias("rank", "path"))
    hit = tried.join(files.select("path").distinct(), "path")
    return first_match(hit, ["file", "target"], ["rank"]).select("file", "target", "path")


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file, target: dotted) with path: the file with the longest dotted prefix as the end of its path.

    Candidates are the target's prefixes, longest first, and its last name; the smallest path of equals.
    """
    parts = F.split("target", r"\.")
    tried = imports.select("file", "target", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("rank", "tail"))
    stem = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"/__init__$", "")
    segs = F.split(stem, "/")
    ends = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.array_join(F.slice(segs, n, F.size(segs)), "/"))).alias("tail"))
    hit = tried.join(ends, "tail")
    return first_match(hit, ["file", "target"], ["rank", "path"]).select("file", "target", "path")
