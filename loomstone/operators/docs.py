"""Documentation: claims about symbols, drift against the code, coverage, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.paths import doc_token_class
from loomstone.operators.joins import first_match

#: In order, how a line of documentation names a symbol.
CLAIMS = (
    ("role", r":(?:func|class|meth|attr|mod|obj|data|exc):`~?([\w.]+)`"),
    ("autodoc", r"\.\.\s+auto(?:function|class|method|module|attribute)::\s*([\w.]+)"),
    ("call", r"`([A-Za-z_][\w.]*)\(\)`"),
    ("code", r"`([A-Za-z_][\w.]*)`"),
)
EXCLUDED = ("keyword", "filename", "http", "config", "stdlib", "builtin", "example", "prose")


def doc_claims(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """(symbol, file, line, how): each symbol once per line, by the first pattern that finds it."""
    lines = files.select(F.col(path).alias("file"), F.posexplode(F.split(source, "\n")).alias("line", "text"))

    def claimed(rank: int, how: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda s: F.struct(F.lit(rank).alias("rank"), F.lit(how).alias("how"), s.alias("symbol")))

    found = F.concat(*(claimed(i, how, p) for i, (how, p) in enumerate(CLAIMS)))
    claims = lines.select("file", (F.col("line") + 1).alias("line"), F.inline(found))
    return first_match(claims, ["symbol", "file", "line"], ["rank"]).select("symbol", "file", "line", "how")


def drift(claims: DataFrame, symbols: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """claims with status: MATCH, EXCLUDED:<class>, DOCUMENTED_MISSING or NO_EVIDENCE; and public symbols without a claim.

    symbols: name (last segment or dotted). A role that names nothing is missing; a bare word is no evidence.
    """
    names = symbols.select(F.col("name").alias("known")).union(symbols.select(F.element_at(F.split("name", r"\."), -1))).distinct()
    short = F.element_at(F.split("symbol", r"\."), -1)
    at = claims.withColumn("short", short).join(names, F.col("short") == F.col("known"), "left").withColumn("class", doc_token_class(F.col("symbol")))
    status = (
        F.when(F.col("known").isNotNull(), "MATCH").when(F.col("how").isin("role", "autodoc"), "DOCUMENTED_MISSING")
        .when(F.col("class").isin(*EXCLUDED) & ((F.col("class") != "prose") | (F.col("how") == "code")), F.concat(F.lit("EXCLUDED:"), "class"))
        .when(F.col("how") == "call", "DOCUMENTED_MISSING").otherwise("NO_EVIDENCE")
    )
    found = at.select("symbol", "file", "line", status.alias("status"))
    public = symbols.select(F.element_at(F.split("name", r"\."), -1).alias("symbol")).where(~F.col("symbol").startswith("_")).distinct()
    silent = public.join(claims.select(short.alias("symbol")), "symbol", "left_anti")
    out = found.unionByName(silent.select("symbol", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit("UNDOCUMENTED_PUBLIC").alias("status")))
    if removed is not None:
        still = removed.join(public, "symbol", "left_semi")
        out = out.unionByName(still.select("symbol", "file", "line", F.lit("DEPRECATED_PRESENT").alias("status")))
    return out


def reconciled(drifted: DataFrame) -> DataFrame:
    """One row: claims checked, matched, missing, without evidence, excluded; checked is the sum of the first three."""
    s = F.col("status")
    c = drifted.where("file IS NOT NULL").agg(F.count_if(s == "MATCH").alias("match"), F.count_if(s == "DOCUMENTED_MISSING").alias("missing"), F.count_if(s == "NO_EVIDENCE").alias("no_evidence"), F.count_if(s.startswith("EXCLUDED")).alias("excluded"), F.count("*").alias("total"))
    return c.withColumn("checked", F.col("match") + F.col("missing") + F.col("no_evidence")).withColumn("reconciled", F.col("checked") + F.col("excluded") == F.col("total"))


def docstring_coverage(facts: DataFrame) -> DataFrame:
    """(module, symbols, documented, percent) of functions and classes, nested ones too."""
    functions = facts.where("kind = 'function'").select("module", "id").join(facts.where("kind = 'docstring'").select("id").distinct().withColumn("doc", F.lit(True)), "id", "left").select("module", F.coalesce("doc", F.lit(False)).alias("doc"))
    classes = facts.where("kind = 'class'").select("module", F.col("flag").alias("doc"))
    g = functions.union(classes).groupBy("module").agg(F.count("*").alias("symbols"), F.count_if("doc").alias("documented"))
    return g.withColumn("percent", F.round(F.col("documented") * 100 / F.col("symbols"), 1))


def inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """One row: readme, changelog, decision records, API documentation."""
    low = F.lower(path)
    return files.agg(
        F.count_if(low.rlike(r"(^|/)readme[^/]*$")).alias("readmes"), F.count_if(low.rlike(r"(^|/)(changelog|changes|history)[^/]*$")).alias("changelogs"),
        F.count_if(low.rlike(r"(^|/)(adr|decisions?)/[^/]+\.(md|rst)$")).alias("decision_records"), F.count_if(low.rlike(r"(^|/)docs?/.*(api|reference)")).alias("api_docs"),
    )


#: What lines say about constraints, assumptions and decisions.
MINERS = {
    "constraint": r"(?i)\b(must( not)?|required|shall|limit(ed)? to|at most|at least|never)\b", "assumption": r"(?i)\b(assum(e|es|ed|ing)|presum|expect(s|ed)? that)\b",
    "decision": r"(?i)\b(decided|we chose|instead of|trade-?off|rationale)\b", "todo": r"\b(TODO|FIXME|HACK|XXX)\b",
}


def mine(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """(file, line, kind, text): lines by what they say; a line can be of several kinds."""
    lines = files.select(F.col(path).alias("file"), F.posexplode(F.split(source, "\n")).alias("line", "text"))
    kinds = F.filter(F.array(*(F.when(F.col("text").rlike(p), k) for k, p in MINERS.items())), lambda x: x.isNotNull())
    return lines.select("file", (F.col("line") + 1).alias("line"), F.explode(kinds).alias("kind"), "text")
