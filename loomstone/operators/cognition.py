"""What kind of repository it is: signals from manifests, names and contents, gates and scores.

Signature tables are inputs (package, type, weight and so on); they are dimension tables and joined as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import words

def signals(found: DataFrame, signatures: DataFrame, key: str) -> DataFrame:
    """(key, type, weight) of what was found; signatures: (key, type, weight)."""
    return found.select(key).distinct().join(signatures, key)


def sampled_imports(imports: DataFrame, entry_names: list[str], most: int = 50) -> DataFrame:
    """imports (path, root) of the named entry files, and of the first others by path up to `most` files in all.

    Entry files are never cut, as defined; 0 reads all files.
    """
    if not most:
        return imports
    files = imports.select("path").distinct().withColumn("entry", F.element_at(F.split("path", "/"), -1).isin(*entry_names))
    named = files.where("entry").select("path")
    rest = files.where("NOT entry").orderBy("path").limit(max(0, most))
    taken = named.union(rest.select("path").orderBy("path").limit(max(0, most - named.count())))
    return imports.join(taken, "path", "left_semi")


def pattern_signals(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, type, weight): patterns (pattern, file_regex, keyword, type, weight) that a file meets; once each.

    patterns is a bounded table of rules, so each file meets each rule: the one join of this kind.
    """
    rules = F.broadcast(patterns)
    text = F.coalesce(F.col("content").cast("string"), F.lit(""))
    hit = files.join(rules, F.expr("path RLIKE file_regex")).where(F.col("keyword").isNull() | F.contains(text, F.col("keyword")))
    return hit.select("pattern", "type", "weight").distinct()


def without_competitors(import_signals: DataFrame, from_patterns: DataFrame, competes: DataFrame) -> DataFrame:
    """Import signals but for types that a found pattern type blocks; competes: (type, blocked)."""
    blocked = from_patterns.select("type").distinct().join(competes, "type").select(F.col("blocked").alias("type"))
    return import_signals.join(blocked, "type", "left_anti")


def first_framework(packages: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row (framework): of the named packages the one with the smallest rank; ranked: (package, framework, rank)."""
    return packages.join(ranked, "package").agg(F.min_by("framework", F.struct("rank", "framework")).alias("framework"))


def technologies(files: DataFrame, markers: DataFrame) -> DataFrame:
    """(technology): markers (name, technology) whose file name occurs."""
    names = files.select(F.lower(F.element_at(F.split("path", "/"), -1)).alias("name")).distinct()
    return names.join(markers, "name").select("technology").distinct()


def architecture(names: DataFrame, hints: DataFrame) -> DataFrame:
    """One row (pattern, hits): the pattern with most hits of at least its minimum, the smaller rank of equals.

    names: (name) of folders and files; hints: (pattern, hint, least, rank).
    """
    hits = names.select(F.lower("name").alias("hint")).distinct().join(hints, "hint").groupBy("pattern", "least", "rank").agg(F.countDistinct("hint").alias("hits"))
    return hits.where("hits >= least").orderBy(F.desc("hits"), "rank").limit(1).select("pattern", "hits")


def domain(hits: DataFrame) -> DataFrame:
    """One row (domain, hits): most hits, a core domain before a serving one of equals."""
    core = F.upper("domain").isin(*words.CORE_DOMAINS)
    return hits.groupBy("domain").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), core.desc(), "domain").limit(1)


def subsumption(first, second) -> F.Column:
    """What two domains are to each other: NONE if the same or the second is empty, RESOLVED_BY_SUBSUMPTION if one is a
    core domain and the other serves any, else DOMAIN_CONFLICT_DETECTED, the only one to warn of."""
    a, b = F.upper(first), F.upper(F.coalesce(second, F.lit("")))
    core, serving = lambda x: x.isin(*words.CORE_DOMAINS), lambda x: x.isin(*words.SERVING_DOMAINS)
    return F.when((a == b) | (b == ""), "NONE").when((core(a) & serving(b)) | (core(b) & serving(a)), "RESOLVED_BY_SUBSUMPTION").otherwise("DOMAIN_CONFLICT_DETECTED")


def discovery_score(total_files, languages, config_files, dependency_files, doc_files, python_files) -> F.Column:
    """How much a scan found, of four checks: files, a language, structure, contents. All arguments are counts."""
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    checks = (some(total_files), some(languages), some(config_files) | some(dependency_files) | some(languages) | some(doc_files), some(python_files) | some(languages) | some(total_files))
    return sum((c.cast("int") for c in checks), F.lit(0)) / 4


def classification_score(signals: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(repo, score) of the repositories of frameworks (repo, framework: null if none) by signals (repo, type, weight).

    Of four checks: signals, a framework, dominance (half of the weight, or a framework), a type of weight 2. Without
    signals only the first two are asked.
    """
    sums = signals.groupBy("repo", "type").agg(F.sum("weight").alias("weight")).groupBy("repo").agg(F.max("weight").alias("top"), F.sum("weight").alias("total"))
    named = F.col("framework").isNotNull()
    some = F.col("total").isNotNull()
    dominant = F.coalesce((F.col("total") > 0) & ((F.col("top") / F.when(F.col("total") > 0, F.col("total")) >= 0.5) | named), F.lit(False))
    strong = F.coalesce((F.col("total") > 0) & (F.col("top") >= 2), F.lit(False))
    points = some.cast("int") + named.cast("int") + dominant.cast("int") + strong.cast("int")
    return frameworks.join(sums, "repo", "left").select("repo", (points / F.when(some, 4).otherwise(2)).alias("score"))


def warnings(profile: DataFrame) -> DataFrame:
    """profile with `warnings`: named gaps of a repository's row, in order.

    profile: dependency_files, config_files, signals, python_files, unknown_extensions, languages (counts), type, score.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    unknown = F.col("type") == "UNKNOWN"
    gaps = [
        ("no_dependency_or_config_files", (n("dependency_files") == 0) & (n("config_files") == 0)),
        ("no_framework_signals", (n("signals") == 0) & (n("python_files") > 0)),
        ("several_types", F.col("type") == "MONOREPO"),
        ("unknown_extensions", n("unknown_extensions") > 0),
        ("languages_without_classification", (n("python_files") == 0) & unknown & (n("languages") > 0)),
        ("low_classification_score", (F.col("score") < 0.4) & unknown),
    ]
    return profile.withColumn("warnings", F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in gaps)), lambda x: x.isNotNull()))


def unknown_extensions(counts: DataFrame, registry: DataFrame) -> DataFrame:
    """(ext, files, covered): extensions without an adapter, split by whether a wider registry knows them."""
    return counts.join(registry.select("ext").distinct().withColumn("covered", F.lit(True)), "ext", "left").select("ext", "files", F.coalesce("covered", F.lit(False)).alias("covered"))


def extra_domain(hits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row (domain, score): packages weigh 3, extensions 2, keywords 1; the first by rank that meets its threshold."""
    weight = F.when(F.col("source") == "package", 3).when(F.col("source") == "extension", 2).otherwise(1)
    sums = hits.groupBy("domain").agg(F.sum(weight).alias("score")).join(thresholds, "domain").where("score >= threshold")
    return sums.orderBy("rank", "domain").limit(1).select("domain", "score")


def identity(profile: DataFrame, overrides: DataFrame) -> DataFrame:
    """profile (repo, type, framework) with a person's override where there is one, and whose word it is."""
    o = overrides.select("repo", F.col("type").alias("o_type"))
    return profile.join(o, "repo", "left").select("repo", F.coalesce("o_type", "type").alias("type"), "framework", F.when(F.col("o_type").isNotNull(), "HUMAN").otherwise("DERIVED").alias("origin"))


def dependencies(declared: DataFrame, imports: DataFrame, own: DataFrame, ignored: list[str]) -> DataFrame:
    """(package, declared, imported): packages of manifests and of imports but for the repository's own roots."""
    a = declared.select(F.lower("package").alias("package"), F.lit(True).alias("declared")).distinct()
    b = imports.select(F.lower("package").alias("package"), F.lit(True).alias("imported")).distinct()
    both = a.join(b, "package", "full_outer").where(~F.col("package").isin(*ignored)).join(own.select(F.lower("package").alias("package")), "package", "left_anti")
    return both.select("package", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("imported", F.lit(False)).alias("imported"))


def recommendations(reports: DataFrame) -> DataFrame:
    """(repo, severity, advice) by the gate, misses in the repository and unresolved calls; one row at least for each."""
    told = (
        ("HIGH", "resolve the review that the gate asks for before any automatic change", F.col("gate") == "REVIEW_REQUIRED"),
        ("MEDIUM", "resolve inherited calls by qualified names", F.col("in_repo_misses") > 50),
        ("LOW", "expect unresolved calls of dynamic or external receivers", F.col("unresolved") > 0),
    )
    rules = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(a).alias("advice"))) for s, a, c in told)), lambda x: x.isNotNull())
    none = F.array(F.struct(F.lit("LOW").alias("severity"), F.lit("nothing to act on").alias("advice")))
    return reports.select("repo", F.inline(F.when(F.size(rules) > 0, rules).otherwise(none)))


def layer_graph(facts: DataFrame) -> DataFrame:
    """(class_path, step, layer, attr): layers that a model's constructor makes, in the order its forward pass calls them."""
    made = facts.where("kind = 'assign' AND name LIKE 'self.%' AND class IS NOT NULL AND endswith(id, '.__init__')").select(F.concat_ws(".", "module", "class").alias("class_path"), F.substr("name", F.lit(6)).alias("attr"), F.element_at(F.split("target", r"\."), -1).alias("layer"))
    used = facts.where("kind = 'call' AND size(items) = 2 AND items[0] = 'self' AND class IS NOT NULL").where(F.element_at(F.split("id", r"\."), -1).isin("forward", "call", "__call__")).select(F.concat_ws(".", "module", "class").alias("class_path"), F.col("name").alias("attr"), "seq")
    w = Window.partitionBy("class_path").orderBy("seq")
    return used.join(made, ["class_path", "attr"]).select("class_path", F.row_number().over(w).alias("step"), "layer", "attr")
