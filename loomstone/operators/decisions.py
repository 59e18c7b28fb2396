"""Decision tables and scores, each one projection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import words
from loomstone.functions.text import python_round, rounded_cut, strings


def clamp(score) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def band(score, part: int = 1) -> Column:
    """Label (1) or action (2) of the band of a clamped score."""
    out = F.lit(words.BANDS[0][part])
    for low, *labels in words.BANDS[1:]:
        out = F.when(clamp(score) >= low, labels[part - 1]).otherwise(out)
    return out


def band_table(spark) -> DataFrame:
    """(low, high, label, action) for a range join; high is inclusive."""
    lows = [b[0] for b in words.BANDS]
    return spark.createDataFrame([(lo, (lows[i + 1] - 1 if i + 1 < len(lows) else 100), a, b) for i, (lo, a, b) in enumerate(words.BANDS)], "low int, high int, label string, action string")


def patch_score(kind) -> Column:
    table = F.create_map(*(F.lit(x) for kv in words.PATCH_SCORES.items() for x in kv))
    return F.coalesce(F.element_at(table, kind), F.lit(50))


def risk_points(risk) -> Column:
    return F.when(risk == "HIGH", 100).when(risk == "MEDIUM", 50).otherwise(0)


def tag_risk(tags) -> Column:
    return F.when(F.arrays_overlap(tags, strings(words.HIGH_IMPACT)), "HIGH").when(F.size(tags) > 0, "MEDIUM").otherwise("LOW")


def opposing(a, b) -> Column:
    out = F.lit(False)
    for x, y in words.OPPOSING:
        has = F.array_contains
        out = out | (has(a, x) & has(b, y)) | (has(a, y) & has(b, x))
    return out


def score_level(score) -> Column:
    return F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")


def semantic_decision(lexical, embedding, domain_match, side_effects) -> dict[str, Column]:
    """confidence (to two places), decision and level; side effects raise the confidence, as defined.

    The thresholds are those of the rounded confidence, as cuts of the unrounded one, so decisions stay in the JVM.
    """
    conf = lexical * 0.2 + embedding * 0.5 + F.when(domain_match, 0.2).otherwise(0.0) + F.when(side_effects, 0.1).otherwise(0.0)
    decision = F.when((conf >= rounded_cut(0.8)) & ~side_effects, "SAFE").when((embedding >= 0.8) | (conf >= rounded_cut(0.5)) | (domain_match & ~side_effects & (embedding >= 0.35)), "REVIEW").otherwise("BLOCK")
    return {"confidence": python_round(conf, F.lit(2)), "decision": decision, "risk_level": F.when(decision == "SAFE", "LOW").when(decision == "REVIEW", "MEDIUM").otherwise("HIGH")}


def pair_actions(pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """The pair pipeline: pairs (left_id, right_id, semantic_score, semantic_decision, kind) with their owners' tags
    (owner, tags, risk), the fused decision, the band of the kind's score, and the action that is left.

    An owner without a row of tags has none: its risk is LOW, and `missing` names it.
    """
    def of(side: str, column: str) -> DataFrame:
        return tags.select(F.col("owner").alias(column), F.col("tags").alias(f"tags_{side}"), F.col("risk").alias(f"risk_{side}"))

    joined = pairs.join(of("a", "left_id"), "left_id", "left").join(of("b", "right_id"), "right_id", "left")
    gone = F.filter(F.array(F.when(F.col("risk_a").isNull(), F.col("left_id")), F.when(F.col("risk_b").isNull(), F.col("right_id"))), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    joined = joined.withColumn("missing", gone).withColumns({f"{c}_{x}": F.coalesce(f"{c}_{x}", v) for x in "ab" for c, v in (("tags", none), ("risk", F.lit("LOW")))})
    points = patch_score(F.col("kind"))
    out = fuse(joined).withColumns({"score": clamp(points), "band": band(points, 1), "raw_action": band(points, 2)})
    return out.withColumn("action", reconcile_action(F.col("fusion_decision"), F.col("raw_action")))


def risk_summary(uses, dependents, core, business, merge_safe) -> dict[str, Column]:
    """points and risk of a change: uses, dependent files, a core file, a business name and an unsafe merge add up."""
    yes = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    points = F.when(uses <= 0, 0).when(uses <= 2, 1).otherwise(2) + yes(dependents >= 3, 2) + yes(core, 2) + yes(business, 1) + yes(~merge_safe, 2)
    return {"points": points, "risk": F.when(points == 0, "Low").when(points <= 2, "Medium").otherwise("High")}


def fuse(df: DataFrame, score="semantic_score", decision="semantic_decision", tags_a="tags_a", tags_b="tags_b", risk_a="risk_a", risk_b="risk_b") -> DataFrame:
    """Adds fusion_score, fusion_decision, fusion_level, opposing and shared_tags.

    Semantic risk weighs 40 %, behaviour risk 60 %. Opposing behaviours block; an unrelated pair without shared tags
    blocks; high-impact behaviours need a review at least; else the score decides.
    """
    a, b, all_tags = F.col(tags_a), F.col(tags_b), F.array_union(tags_a, tags_b)
    high = F.arrays_overlap(all_tags, strings(words.HIGH_IMPACT))
    base = F.greatest(risk_points(F.col(risk_a)), risk_points(F.col(risk_b)))
    base = F.when(high, F.greatest(base, F.lit(60))).otherwise(base)
    base = F.when(F.size(all_tags) == 0, F.least(base, F.lit(20))).otherwise(base)
    semantic = F.when(F.col(decision) == "BLOCK", 100).otherwise(((F.lit(1.0) - F.col(score)) * 100).cast("int"))
    # Both parts are whole numbers, so tenths decide: (4s + 6b) / 10, half to even.
    points = F.bround((semantic * 4 + base * 6) / F.lit(10.0)).cast("int")
    df = df.withColumns({"opposing": opposing(a, b), "shared_tags": F.array_sort(F.array_intersect(tags_a, tags_b)), "_points": points, "_high": high})
    points = F.when(F.col("opposing"), F.greatest("_points", F.lit(90))).otherwise(F.col("_points"))
    df = df.withColumn("fusion_score", points)
    unrelated = (F.col(decision) == "BLOCK") & (F.size("shared_tags") == 0)
    s = F.col("fusion_score")
    plain = F.when(s >= 80, "BLOCK").when(s >= 25, "REVIEW").otherwise("SAFE")
    verdict = F.when(F.col("opposing") | unrelated, "BLOCK").when(F.col("_high"), F.when(s >= 80, "BLOCK").otherwise("REVIEW")).otherwise(plain)
    named = F.when(s >= 80, "CRITICAL").when(s >= 50, "HIGH").when(s >= 25, "MEDIUM").otherwise("LOW")
    lvl = F.when(F.col("opposing"), "CRITICAL").when(unrelated | F.col("_high"), score_level(s)).otherwise(named)
    return df.withColumns({"fusion_decision": verdict, "fusion_level": lvl}).drop("_points", "_high")


def reconcile_action(decision, action) -> Column:
    """A reviewed or blocked pair is never applied by itself; every other action stays as it is."""
    automatic = action == "AUTO_APPLY"
    return F.when(automatic & (decision == "REVIEW"), "BATCH_APPROVAL").when(automatic & (decision == "BLOCK"), "INDIVIDUAL_APPROVAL").otherwise(action)


def approval(severity) -> Column:
    return F.when(severity == "BLOCK", "REJECTED").when(severity == "REVIEW", "PENDING_REVIEW").otherwise("APPROVED")


def patch_decision(syntax_ok, governance_ok, confidence) -> Column:
    return F.when(syntax_ok & governance_ok & (confidence >= 0.9), "APPROVE").when(syntax_ok & governance_ok & (confidence >= 0.6), "REVIEW").otherwise("REJECT")


def patch_decision_score(decision) -> Column:
    return F.when(decision == "APPROVE", 10).when(decision == "REVIEW", 45).otherwise(90)


def falls_back(confidence) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) < 0.6


def gate(blocking: list[Column], review: list[Column]) -> Column:
    """BLOCKED if a blocking check fails, REVIEW_REQUIRED if a review check fails; unknown counts as failed."""
    failed = lambda checks: F.lit(False) if not checks else ~F.forall(F.array(*(F.coalesce(c, F.lit(False)) for c in checks)), lambda x: x)
    return F.when(failed(blocking), "BLOCKED").when(failed(review), "REVIEW_REQUIRED").otherwise("APPROVED")


def health(guesses, uncategorised) -> Column:
    """A missing measurement isn't a measurement of 0."""
    return F.when(guesses.isNull(), "NOT_RATED").when((guesses > 0) | (F.coalesce(uncategorised, F.lit(0)) > 0), "UNVERIFIED").otherwise("SOUND")


def health_risk(guesses, uncategorised, in_repo_misses) -> Column:
    """The risk beside the rating: HIGH if unverified, MEDIUM with over 200 misses in the repository, null if not rated."""
    rating = health(guesses, uncategorised)
    return F.when(rating == "UNVERIFIED", "HIGH").when(rating == "SOUND", F.when(F.coalesce(in_repo_misses, F.lit(0)) > 200, "MEDIUM").otherwise("LOW"))


def complete(has_primary, has_index) -> Column:
    """A run is complete with primary artifacts or a reasoning index; unknown counts as neither."""
    return F.coalesce(has_primary, F.lit(False)) | F.coalesce(has_index, F.lit(False))


def language_review(declared, voted) -> Column:
    """Whether a person should look: no vote, or another language than declared."""
    return voted.isNull() | F.coalesce(F.lower(declared) != F.lower(voted), F.lit(False))


def high_usage(uses: DataFrame, level: str = "level", with_critical: bool = True) -> DataFrame:
    """The high usages; without `with_critical` only the band from four to seven uses, as the narrow rule has it."""
    return uses.where(F.col(level).isin("High", "Critical") if with_critical else F.col(level) == "High")


def usage_level(uses) -> Column:
    return F.when(uses <= 0, "Low").when(uses <= 3, "Medium").when(uses <= 7, "High").otherwise("Critical")


def behaviour_dictionary(spark) -> DataFrame:
    return spark.createDataFrame([(c, t) for t, calls in words.BEHAVIOUR_CALLS.items() for c in calls.split()], "call string, tag string")


def behaviour_tags(calls: DataFrame, owner: str = "owner", call: str = "call") -> DataFrame:
    """(owner, tags, risk): sorted distinct tags of the last segments of an owner's calls; owners without tags have none."""
    short = F.element_at(F.split(F.col(call), r"\."), -1)
    dictionary = behaviour_dictionary(calls.sparkSession).withColumnRenamed("call", "_call")  # a fixed table
    tagged = calls.withColumn("_short", short).join(F.broadcast(dictionary), F.col("_short") == F.col("_call"), "left")
    out = tagged.groupBy(owner).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return out.withColumn("risk", tag_risk(F.col("tags")))


def dangerous_calls(calls: DataFrame, call: str = "call") -> DataFrame:
    """Calls that the table of dangerous names holds, by the whole name or its longest dotted suffix."""
    table = calls.sparkSession.createDataFrame([(n, *v) for n, v in words.DANGEROUS_CALLS.items()], "api string, category string, severity string")
    parts = F.split(F.col(call), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hit = calls.withColumn("_row", F.monotonically_increasing_id()).withColumn("_suffix", F.explode(suffixes)).join(F.broadcast(table), F.col("_suffix") == F.col("api"))
    best = hit.groupBy("_row", *calls.columns).agg(F.max_by(F.struct("api", "category", "severity"), F.length("api")).alias("found"))
    return best.select(*calls.columns, "found.*")


def signal_type(signals: DataFrame, least: float = 2.0) -> str:
    """The type of a repository from weighted signals (type, weight): qualify, suppress by hierarchy, monorepo rule.

    The sums are a row per type; the sequential suppression runs over these few rows.
    """
    sums = {r["type"]: float(r["w"]) for r in signals.groupBy("type").agg(F.sum("weight").alias("w")).where(F.col("w") >= least).collect()}
    return choose_type(sums)


def application_types(signals: DataFrame, least: float = 2.0) -> DataFrame:
    """(repo, type) of signals (repo, type, weight); a repository's types are few, so each is decided as one row."""
    sums = signals.groupBy("repo", "type").agg(F.sum("weight").alias("weight"))
    kept = F.expr(f"filter(collect_list(struct(type, weight)), x -> x.weight >= {float(least)})")

    @F.pandas_udf("string")
    def choose(found: pd.Series) -> pd.Series:
        return found.map(lambda rows: choose_type({r["type"]: float(r["weight"]) for r in rows}))

    return sums.groupBy("repo").agg(kept.alias("found")).select("repo", choose("found").alias("type"))


def choose_type(sums: dict[str, float]) -> str:
    """Types in order of their weight, each that is still there removing those below it, stronger ones too; then the
    monorepo rule. Of equal weights the first name goes first."""
    left = dict(sums)
    for kind in sorted(sums, key=lambda k: (-sums[k], k)):
        if kind in left:
            for below in words.TYPE_HIERARCHY.get(kind, ()):
                left.pop(below, None)
    if not left:
        return "UNKNOWN"
    top = sorted(left.values(), reverse=True)
    if len(top) > 1 and top[1] / top[0] >= 0.5 and top[0] / top[1] < 1.8:
        return "MONOREPO"
    return min(left, key=lambda k: (-left[k], k))
