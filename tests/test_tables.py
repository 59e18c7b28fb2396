"""Decisions, text measures, joins, logs, streams, and the registered queries against their SQL."""

import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomstone.functions import paths, text
from loomstone.operators import decisions, duplicates, joins, logs, profile
from loomstone.streaming import events
from loomstone.tables import TABLES


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def lits(*xs):
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<string>")


@pytest.mark.parametrize(
    ("score", "decision", "a", "b", "risk_a", "risk_b", "want"),
    [
        (0.55, "REVIEW", ["BACKUP_OPERATION"], ["RECOVERY_OPERATION"], "MEDIUM", "HIGH", ("BLOCK", 90, "CRITICAL")),
        (0.85, "SAFE", [], [], "LOW", "LOW", ("SAFE", 6, "LOW")),
        (0.85, "REVIEW", ["DELETE_OPERATION"], ["DELETE_OPERATION"], "HIGH", "HIGH", ("REVIEW", 66, "HIGH")),
        (0.2, "BLOCK", ["FILE_READ"], ["FILE_WRITE"], "MEDIUM", "MEDIUM", ("BLOCK", 70, "HIGH")),
    ],
)
def test_fusion(spark, score, decision, a, b, risk_a, risk_b, want):
    row = spark.range(1).select(F.lit(score).alias("semantic_score"), F.lit(decision).alias("semantic_decision"), lits(*a).alias("tags_a"), lits(*b).alias("tags_b"), F.lit(risk_a).alias("risk_a"), F.lit(risk_b).alias("risk_b"))
    got = decisions.fuse(row).first()
    assert (got["fusion_decision"], got["fusion_score"], got["fusion_level"]) == want


def test_decision_tables(spark):
    got = one(spark, b=decisions.band(F.lit(140)), c=decisions.band(F.lit(-3), 2), p=decisions.patch_score(F.lit("file_deletion")), q=decisions.patch_score(F.lit("other")), g=decisions.gate([F.lit(True)], [F.lit(None).cast("boolean")]),
              h=decisions.health(F.lit(None).cast("int"), F.lit(0)), i=decisions.health(F.lit(0), F.lit(0)), r=decisions.reconcile_action(F.lit("REVIEW"), F.lit("AUTO_APPLY")), d=decisions.patch_decision(F.lit(True), F.lit(True), F.lit(0.7)))
    assert tuple(got) == ("CRITICAL", "AUTO_APPLY", 95, 50, "REVIEW_REQUIRED", "NOT_RATED", "SOUND", "BATCH_APPROVAL", "REVIEW")
    assert decisions.choose_type({"NLP_TOOL": 6, "ML_PIPELINE": 5, "CLI_TOOL": 1}) == "NLP_TOOL"
    assert decisions.choose_type({"GAME_ENGINE": 9, "MOBILE_APPLICATION": 3}) == "MOBILE_APPLICATION"  # a weaker type removes a stronger one below it
    for x in (0.794, 0.795, 0.7949999, 0.796, 0.4949, 0.495, 0.4951):
        assert (x >= text.rounded_cut(0.8)) == (round(x, 2) >= 0.8) and (x >= text.rounded_cut(0.5)) == (round(x, 2) >= 0.5)
    assert decisions.choose_type({"WEB_APPLICATION": 4, "ML_PIPELINE": 4}) == "MONOREPO" and decisions.choose_type({}) == "UNKNOWN"


def test_text_measures(spark):
    t = lambda s: text.name_tokens(F.lit(s))
    got = one(spark, a=text.semantic_conflict(t("checkEmail"), t("check_username")), b=text.semantic_conflict(t("add"), t("sum")), c=text.semantic_conflict(t("invoice"), t("add")), d=text.type_conflict(F.lit("print_it"), F.lit("show")))
    assert tuple(got) == (True, False, True, True)
    got = one(spark, a=text.primary_action(lits("x", "validate")), d=text.business_domain(lits("login", "token", "csv")), r=text.business_domain(lits("restore", "database")), n=text.business_domain(lits("z")), e=text.side_effects(F.lit("db.save(); verify(x)")))
    assert (got["a"], got["d"], got["r"], got["n"]) == ("validate", "authentication", "recovery_operations", "general")
    assert got["e"] == ["persistent_storage", "security_validation"]
    got = one(spark, r=text.sequence_ratio(F.lit("abcd"), F.lit("bcde")), a=text.python_round(F.lit(0.125), F.lit(2)), b=text.python_round(F.lit(2.675), F.lit(2)), x=text.expand_synonyms(lits("delete")), c=text.cosine(lits(1.0, 0.0), lits(0.0, 0.0)))
    assert (got["r"], got["a"], got["b"], got["c"]) == (0.75, 0.12, 2.67, 0.0) and got["x"] == ["delete", "erase", "remove"]
    got = one(spark, p=paths.is_production(F.lit("src/Template.py")), m=paths.module_name(F.lit("a/b/__init__.py")), t=paths.path_class(F.lit("tests/test_a.py")), d=paths.is_declaration(F.lit("x.d.ts")))
    assert tuple(got) == (False, "a.b", "test", True)


def test_joins(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 5, "c")], "k int, t int, tag string")
    right = spark.createDataFrame([(1, 2, "x"), (1, 5, None), (2, 9, "z")], "k int, t int, v string")
    got = {r["tag"]: r["v2"] for r in joins.as_of(left, right, ["k"], ["t"], "v", "v2").collect()}
    assert got == {"a": None, "b": None, "c": None}
    assert joins.as_of(left, right.where("v = 'x'"), ["k"], ["t"], "v", "v2").where("tag = 'a'").first()["v2"] == "x"
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "name string, target string")
    assert {r["name"]: r["target"] for r in joins.chase(links, links.select("name")).collect()} == {"a": "c", "b": "a", "c": "b", "d": "e"}
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, None), (3, "x"), (3, "y")], "k int, v string")
    assert [tuple(r) for r in joins.agreeing(rows, ["k"], "v").collect()] == [(1, "x")]
    assert profile.dominant(rows, ["k"], "v").where("k = 3").count() == 0


def test_sets_that_overlap(spark):
    import random

    rnd = random.Random(1)
    sets = {i: {rnd.randint(0, 40) for _ in range(rnd.randint(1, 12))} for i in range(60)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * max(len(sets[a]), len(sets[b]))}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, items array<string>")
    assert {(r["left_id"], r["right_id"]) for r in duplicates.overlapping_sets(df, "id", "items", 0.5).collect()} == want


def test_pairs_that_share_a_token(spark, monkeypatch):
    import random

    monkeypatch.setattr(duplicates, "ID_BLOCK", 3)
    rnd = random.Random(2)
    rows = [(rnd.choice(["x", "y", None]), rnd.choice([*range(60), None]), [rnd.choice(["a", "b", "c", "d", "e", None]) for _ in range(rnd.randint(0, 3))]) for _ in range(150)]
    held = {}
    for s, i, t in rows:
        held.setdefault((s, i), set()).update(x for x in t if x)
    want = sorted((s, i, j) for s, i in held for r, j in held if s and s == r and None not in (i, j) and i < j and held[s, i] & held[s, j])
    found = duplicates.token_pairs(spark.createDataFrame(rows, "s string, i long, t array<string>"), "s", "i", "t")
    assert sorted(tuple(r) for r in found.collect()) == want
    # pairs are many more than rows: none is shuffled once it is laid out
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and not any(w in plan[: plan.index("Generate")] for w in ("Aggregate", "Repartition", "Join"))


def test_nearest_vectors_equal_the_expression(spark, monkeypatch):
    import random

    monkeypatch.setattr(joins, "QUERY_BLOCK", 7)
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(3)]) for i in range(120)] + [(200, None), (201, [1.0]), (202, [1.0, None, 2.0]), (203, [0.0, 0.0, 0.0]), (204, [float("nan"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "b long, y array<float>")
    asked = df.where("b % 6 = 0 OR b > 199").toDF("a", "x")
    want = joins.nearest(asked, df, F.round(text.cosine(F.col("x"), F.col("y")), 6), 4, "a", "b")
    got = joins.nearest_vectors(asked, df, 4, ("a", "x"), ("b", "y"), 6)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 4 * asked.count()
    halves = [0.1234565, -0.1234565, 0.0000005, 0.5, 0.99999949999]
    assert list(joins._rounded(np.array(halves), 6)) == [r[0] for r in spark.createDataFrame([(x,) for x in halves], "x double").select(F.round("x", 6)).collect()]


def test_shared_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "ITEM_BLOCK", 2)
    rows = spark.createDataFrame([(i, f"w{i % 7}") for i in range(50)] + [(1, "w1"), (9, None)], "d long, g string")
    few = spark.createDataFrame([("x", "w1"), ("x", "w2"), ("y", "w2"), ("x", "w1"), ("z", "none"), ("z", None)], "b string, g string")
    found = joins.shared_items(rows, few, "g")
    assert sorted(tuple(r) for r in found.collect()) == sorted({(i, b) for i in range(50) for b, w in (("x", 1), ("x", 2), ("y", 2)) if i % 7 == w})
    # only rows that have met an item are shuffled
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_logs(spark):
    old = logs.snapshot(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "p string, t string"), "p", "t")
    new = logs.snapshot(spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "")], "p string, t string"), "p", "t")
    assert {r["path"]: r["change"] for r in logs.snapshot_diff(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "changed"}
    log = spark.createDataFrame([("f", "g", "approved", 1), ("g", "f", "rejected", 2), ("f", "g", "approved", 3), ("x", "y", "noted", 1)], "a string, b string, d string, n int")
    assert {(r["first"], r["decision"]) for r in logs.decision_of_pair(log, "a", "b", "d", ["n"]).collect()} == {("f", "rejected"), ("x", "noted")}


def test_streams_equal_batches(spark, tmp_path, sf):
    (tmp_path / "events.parquet").symlink_to(f"{sf}/events.parquet")
    batch = spark.read.parquet(f"{sf}/events.parquet")
    got = events.run_to_end(events.windowed_counts(events.read_events(spark, str(tmp_path)), "1 day"), "t_windows", "complete")
    assert got.agg(F.sum("n")).first()[0] == batch.count()
    assert got.count() == batch.select(F.to_date("ts"), "event_type").distinct().count()
    once = events.run_to_end(events.once(events.read_events(spark, str(tmp_path)), "60 days"), "t_once")
    assert once.count() == batch.select("event_id").distinct().count()


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("q_")])
def test_registered_queries_equal_their_sql(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda df: list(tuple(round(v, 9) if isinstance(v, float) else None if v is None or v != v else v for v in r) for r in df[cols].astype(object).values.tolist())
    assert sorted(map(str, plain(got))) == sorted(map(str, plain(want)))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_training_package():
    root = Path(entry.__file__).parent
    for p in (root / "loomstone").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(import|from)\s+loomstone\.llm", p.read_text()), p
