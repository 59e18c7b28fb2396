"""Repository profile: votes, shares, coverage, reconciliation, risk, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dominant(rows: DataFrame, by: list[str], value: str, share: float = 0.0) -> DataFrame:
    """(by, value, votes, share): the most frequent value, none on a tie or below the share."""
    votes = rows.groupBy(*by, value).agg(F.count("*").alias("votes"))
    all_votes = votes.groupBy(*by).agg(F.sum("votes").alias("total"), F.max("votes").alias("top")) if by else votes.agg(F.sum("votes").alias("total"), F.max("votes").alias("top"))
    top = (votes.join(all_votes, by) if by else votes.crossJoin(all_votes)).where("votes = top")  # without groups one row
    ties = top.groupBy(*by).agg(F.count("*").alias("ties"), F.min(value).alias(value), F.first("votes").alias("votes"), F.first("total").alias("total"))
    return ties.where((F.col("ties") == 1) & (F.col("votes") / F.col("total") >= share)).select(*by, value, "votes", (F.col("votes") / F.col("total")).alias("share"))


def examples(rows: DataFrame, by: str, order: list[str], most: int = 5) -> DataFrame:
    """At most `most` rows of each group, the first by the order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def coverage(rows: DataFrame, by: list[str], condition: Column) -> DataFrame:
    """(by, total, covered, share)."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(condition).alias("covered")).withColumn("share", F.col("covered") / F.col("total"))


def reconcile(rows: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """One row: a count per label, the total, and whether the labels make it up."""
    counts = [F.count_if(F.col(label) == v).alias(v) for v in labels]
    return rows.agg(*counts, F.count("*").alias("total")).withColumn("reconciled", sum((F.col(v) for v in labels), F.lit(0)) == F.col("total"))


def precision_recall(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row of micro-averaged counts and measures; a measure without cases is null."""
    c = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(tp * 2, tp * 2 + fp + fn)})


def monorepo(markers: DataFrame, root: str, project: str, least: int = 3) -> DataFrame:
    """(root, projects, is_monorepo)."""
    return markers.groupBy(root).agg(F.countDistinct(project).alias("projects")).withColumn("is_monorepo", F.col("projects") >= least)


def component_risk(files: DataFrame) -> DataFrame:
    """(path, points) of files(path, imports, critical_name, functions, has_test): 0 to 10 additive points."""
    points = (
        F.when(F.col("imports") >= 10, 3).when(F.col("imports") >= 5, 2).otherwise(0)
        + F.when(F.col("critical_name"), 2).otherwise(0)
        + F.when(F.col("functions") >= 15, 2).when(F.col("functions") >= 8, 1).otherwise(0)
        + F.when(~F.col("has_test"), 2).otherwise(0)
    )
    return files.select("path", points.alias("points"))


def top_risk(files: DataFrame, most: int = 5) -> DataFrame:
    return component_risk(files).orderBy(F.desc("points"), "path").limit(most)


def knowledge_loss(files: DataFrame) -> DataFrame:
    """(path, finding) of files(path, imports, has_test, functions, docstrings)."""
    spof = (F.col("imports") >= 5) & ~F.col("has_test")
    silent = (F.col("functions") >= 3) & (F.col("docstrings") == 0)
    found = F.filter(F.array(F.when(spof, "single_point_of_failure"), F.when(silent, "undocumented")), lambda x: x.isNotNull())
    return files.select("path", F.explode(found).alias("finding"))


def dependency_roll_up(imports: DataFrame, root: str, user: str) -> DataFrame:
    """(root, users, imports): distinct users, sorted, and the number of imports."""
    return imports.groupBy(root).agg(F.array_sort(F.collect_set(user)).alias("users"), F.count("*").alias("imports"))


def label_roll_up(rows: DataFrame, label: str, baseline: int) -> DataFrame:
    """(label, n, percent of the baseline)."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).withColumn("percent", F.round(F.col("n") * 100 / F.lit(baseline), 2))


def evidence_cell(value: Column, tier: str) -> Column:
    """struct(tier, value): UNKNOWN where there is no value; an unknown is never a zero."""
    return F.struct(F.when(value.isNull(), "UNKNOWN").otherwise(tier).alias("tier"), value.cast("string").alias("value"))


def evidence_coverage(cells: DataFrame, section: str, tier: str) -> DataFrame:
    return cells.groupBy(section).agg(F.count_if(F.col(tier) != "UNKNOWN").alias("populated"), F.count("*").alias("fields"))


def unsupported_numbers(rendered: DataFrame, text: str, evidence: DataFrame, value: str) -> DataFrame:
    """(number): numbers of a rendered text that no evidence has."""
    shown = rendered.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)).alias("number")).distinct()
    return shown.join(evidence.select(F.col(value).cast("string").alias("number")), "number", "left_anti")


def module_tree(facts: DataFrame) -> DataFrame:
    """(module, classes: array of class, methods): the browsable tree; free functions are under a null class."""
    made = facts.where("kind = 'function' AND (target IS NULL OR target = 'class')").select("module", F.when(F.col("target") == "class", F.col("class")).alias("class"), "name")
    by_class = made.groupBy("module", "class").agg(F.array_sort(F.collect_set("name")).alias("methods"))
    empty = facts.where("kind = 'class'").select("module", F.col("name").alias("class")).join(by_class, ["module", "class"], "left_anti").withColumn("methods", F.array().cast("array<string>"))
    return by_class.unionByName(empty).groupBy("module").agg(F.array_sort(F.collect_list(F.struct("class", "methods"))).alias("classes"))


def edge_differences(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(src, dst, found): edges of both sets as tp, fp (only predicted) or fn (only true)."""
    a = predicted.select("src", "dst").distinct().withColumn("p", F.lit(True))
    b = truth.select("src", "dst").distinct().withColumn("t", F.lit(True))
    return a.join(b, ["src", "dst"], "full_outer").select("src", "dst", F.when(F.col("p") & F.col("t"), "tp").when(F.col("p"), "fp").otherwise("fn").alias("found"))


#: Words that judge where a report should measure, and forms that blur a number.
JUDGEMENTS = (
    "medium-sized", "small-sized", "large-sized", "medium sized", "well-structured", "well structured", "poorly-structured", "mature", "immature",
    "robust", "fragile", "clean", "messy", "high-quality", "low-quality", "well-organized", "well organized", "modern", "legacy", "elegant", "solid",
    "healthy", "sound-architecture", "production-ready", "enterprise-grade", "battle-tested", "reusable package",
)
HEDGES = (r"\bapproximately\s+[\d,]+", r"\broughly\s+[\d,]+", r"~\s*[\d,]{2,}", r"\babout\s+[\d,]{3,}", r"\border of\b")


def judging_words(text) -> Column:
    """The judging words and blurring forms that a text has, in the order of the lists; words count as whole ones."""
    low = F.lower(text)
    words_ = [F.when(low.rlike(rf"\b{w}\b"), w) for w in JUDGEMENTS]
    return F.filter(F.array(*words_, *(F.when(low.rlike(h), h) for h in HEDGES)), lambda x: x.isNotNull())
