"""Governance findings over facts of functions and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import words
from loomstone.operators.decisions import dangerous_calls

MUTATION = r"^\s*(?:global\s+.*\b)?(" + "|".join(words.GLOBAL_STATE) + r")(?:\s*\[[^\]]*\]\s*=[^=]|\s*=[^=]|\.(?:append|update|pop|clear|add|remove|setdefault|extend)\()"


def function_spans(functions: DataFrame) -> DataFrame:
    """functions (file, name, start_line) with end_line: the line before the next definition of the file, null for the last."""
    w = Window.partitionBy("file").orderBy("start_line")
    return functions.withColumn("end_line", F.lead("start_line").over(w) - 1)


def global_state(files: DataFrame, functions: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """(file, function, line, name): lines within a function's span that change a global state name."""
    lines = files.select(F.col(path).alias("file"), F.posexplode(F.split(source, "\n")).alias("no", "text")).where(F.col("text").rlike(MUTATION))
    spans = function_spans(functions.select("file", "name", "start_line"))
    hit = lines.withColumn("line", F.col("no") + 1).join(spans, "file").where("line >= start_line AND (end_line IS NULL OR line <= end_line)")
    return hit.select("file", F.col("name").alias("function"), "line", F.regexp_extract("text", MUTATION, 1).alias("name"))


def findings(calls: DataFrame, mutations: DataFrame) -> DataFrame:
    """(file, function, line, check, category, severity) of calls (file, function, line, call) and mutations."""
    risky = dangerous_calls(calls, "call").select("file", "function", "line", F.lit("dangerous_api").alias("check"), "category", "severity")
    return risky.unionByName(mutations.select("file", "function", "line", F.lit("global_state").alias("check"), F.lit("GLOBAL_STATE").alias("category"), F.lit("REVIEW").alias("severity")))


def roll_up(found: DataFrame) -> DataFrame:
    """(check, severity, n, files): by check, by severity and in all, in one pass."""
    return found.groupingSets([[F.col("check")], [F.col("severity")], []], "check", "severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


#: The states that a run may report.
RUN_STATES = ("COMPLETE", "REVIEW_REQUIRED", "BLOCKED", "M2_PREFLIGHT_VENV", "M2_ERROR", "M3_ERROR", "ERROR")


def invariant_violations(reports: DataFrame) -> DataFrame:
    """Reports that break the contract, a row for each of their `failures`; an honest hold or block breaks none.

    reports: repo, error, status, gate, reason, guesses (null: not measured), base_edges, added_edges, total_edges (null:
    not reported), engine_status, capabilities (a count). An error of the run itself is its only failure.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    complete, status = F.col("status") == "COMPLETE", F.coalesce("status", F.lit(""))
    measured = complete & F.col("guesses").isNotNull()
    checks = (
        ("unknown status", ~status.isin(*RUN_STATES)),
        ("edges without completion", (status != "COMPLETE") & (zero("total_edges") > 0)),
        ("guesses", measured & (F.col("guesses") != 0)),
        ("edge provenance", measured & (F.col("total_edges") != zero("base_edges") + zero("added_edges"))),
        ("capabilities of a failed engine", complete & F.col("engine_status").isin("ENGINE_ERROR", "NOT_IMPLEMENTED") & (zero("capabilities") > 0)),
        ("review without its gate", (status == "REVIEW_REQUIRED") & ~F.coalesce(F.col("gate") == "REVIEW_REQUIRED", F.lit(False))),
        ("block without a reason", (status == "BLOCKED") & (F.coalesce("reason", F.lit("")) == "")),
    )
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks)), lambda x: x.isNotNull())
    failures = F.when(F.coalesce("error", F.lit("")) != "", F.array(F.lit("pipeline error"))).otherwise(found)
    return reports.select("repo", F.explode(failures).alias("failure"))
