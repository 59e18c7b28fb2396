"""SQL lineage from scripts, without a grammar: which object reads, writes and calls what, and what flows where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import sql_name, strip_sql_comments
from loomstone.operators.graph import closure, one_node, reversed_edges

#: What opens a scope, and how a scope refers to tables and procedures.
OPENER = r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:FORCE\s+|MATERIALIZED\s+|GLOBAL\s+TEMPORARY\s+)?(PROCEDURE|FUNCTION|VIEW|TRIGGER|PACKAGE(?:\s+BODY)?)\s+([\w\.]+)"
TABLE = r"(?i)\bCREATE\s+(?:GLOBAL\s+TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w\.]+)"
READS = (r"(?i)\bFROM\s+([\w\.]+)", r"(?i)\bJOIN\s+([\w\.]+)")
WRITES = (r"(?i)\bINSERT\s+(?:OR\s+\w+\s+)?INTO\s+([\w\.]+)", r"(?i)\bUPDATE\s+([\w\.]+)\s+SET", r"(?i)\bDELETE\s+FROM\s+([\w\.]+)")
CALLS = (r"(?i)\b(?:EXEC(?:UTE)?|CALL)\s+([\w\.]+)",)
FIRES = r"(?i)\bON\s+([\w\.]+)"
NO_TABLES = ("dual", "table", "select", "where", "set", "values")


def scopes(scripts: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """(path, owner, kind, body): the text from each opener to the next; text before the first is owned by __file__."""
    marked = scripts.select(path, F.regexp_replace(strip_sql_comments(F.col(source)), OPENER, "\u0001$0").alias("_t"))
    parts = marked.select(path, F.posexplode(F.split("_t", "\u0001")).alias("_no", "body"))
    kind, owner = F.upper(F.regexp_extract("body", OPENER, 1)), F.regexp_extract("body", OPENER, 2)
    named = parts.where((F.col("_no") > 0) | (F.trim("body") != ""))
    return named.select(path, F.when(F.col("_no") == 0, "__file__").otherwise(sql_name(owner)).alias("owner"), F.when(F.col("_no") == 0, "FILE").otherwise(kind).alias("kind"), "body")


def references(scope: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """(object, name) distinct."""
    found = F.concat(*(F.regexp_extract_all("body", F.lit(p), 1) for p in patterns))
    out = scope.select(F.col("owner").alias("object"), F.explode(F.transform(found, sql_name)).alias("name")).distinct()
    return out.where(~F.col("name").isin(*NO_TABLES))


def lineage(scripts: DataFrame, path: str = "path", source: str = "source") -> dict[str, DataFrame]:
    """reads, writes, calls, fires_on (object, name), tables (name), objects (name, kind) and flows."""
    scope = scopes(scripts, path, source)
    reads, writes = references(scope, READS), references(scope, WRITES)
    fires = scope.where("kind = 'TRIGGER'").select(F.col("owner").alias("object"), sql_name(F.regexp_extract("body", FIRES, 1)).alias("name")).where("name <> ''").distinct()
    tables = scripts.select(F.explode(F.regexp_extract_all(strip_sql_comments(F.col(source)), F.lit(TABLE), 1)).alias("name")).select(sql_name(F.col("name")).alias("name")).distinct()
    objects = scope.where("kind <> 'FILE'").select(F.col("owner").alias("name"), "kind").distinct()
    return {"reads": reads, "writes": writes, "calls": references(scope, CALLS), "fires_on": fires, "tables": tables, "objects": objects, "flows": data_flows(reads, writes)}


def data_flows(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(src, via, dst): what an object reads flows into what it writes, but for itself."""
    a = reads.select(F.col("object").alias("via"), F.col("name").alias("src"))
    b = writes.select(F.col("object").alias("via"), F.col("name").alias("dst"))
    return a.join(b, "via").where("src <> dst").select("src", "via", "dst").distinct()


def writers_of(writes: DataFrame, table: str) -> DataFrame:
    return writes.where(F.col("name") == table).select("object").distinct()


readers_of = writers_of


def upstream_of(flows: DataFrame, table, hops: int = 10) -> DataFrame:
    edges = reversed_edges(flows.select("src", "dst").distinct())
    return closure(edges, one_node(edges, table), hops).where(F.col("node") != table).select("node")


def impact_of_table(flows: DataFrame, table, hops: int = 10) -> DataFrame:
    edges = flows.select("src", "dst").distinct()
    return closure(edges, one_node(edges, table), hops).where(F.col("node") != table).select("node")


def reference_status(refs: DataFrame, defined: DataFrame, procedures: bool = False) -> DataFrame:
    """refs (object, name) with status: RESOLVED, ORACLE_SYSTEM_PACKAGE, or why the name isn't in the repository."""
    known = defined.select("name").distinct().withColumn("_known", F.lit(True))
    missing = "PROCEDURE_NOT_IN_REPO" if procedures else "NOT_DEFINED_IN_REPO"
    status = F.when(F.col("_known"), "RESOLVED").when(F.col("name").rlike("(?i)^(dbms|utl|apex)_"), "ORACLE_SYSTEM_PACKAGE").otherwise(missing)
    return refs.join(known, "name", "left").select("object", "name", status.alias("status"))
