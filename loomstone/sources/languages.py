"""Facts of other languages by patterns: Go, C#, C and C++, Java, JavaScript. Definitions and spans are columns, calls are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import strip_block_comments

#: Words before a bracket that call nothing.
NO_CALLS = "if for while switch return sizeof catch else do defined func defer select range using lock foreach nameof typeof new throw".split()
GO = {
    "package": r"(?m)^package\s+(\w+)", "struct": r"(?m)^type\s+(\w+)\s+struct\b", "interface": r"(?m)^type\s+(\w+)\s+interface\b",
    "function": r"(?m)^func\s+(\w+)\s*\(", "goroutine": r"\bgo\s+([\w.]+)\s*\(", "struct_init": r"&?\b([A-Z]\w*)\{",
}
GO_METHOD = r"(?m)^func\s+\(\s*(\w+)\s+\*?(\w+)\s*\)\s*(\w+)\s*\("
CSHARP = {
    "namespace": r"(?m)^\s*namespace\s+([\w.]+)", "class": r"\b(?:class|record|struct)\s+(\w+)", "interface": r"\binterface\s+(\w+)",
    "constructed": r"\bnew\s+([A-Z]\w*)\s*[({]",
}
CSHARP_FIELD = r"(?m)^\s*(?:private|protected|public|internal)\s+(?:readonly\s+|static\s+)*([A-Z]\w*)\s+(\w+)\s*[;=]"
CSHARP_METHOD = r"(?:public|private|protected|internal|static|async|override|virtual)\s+[\w<>\[\],\s?]*?\b(\w+)\s*\([^;{)]*\)\s*\{"
JAVA = {
    "package": r"(?m)^\s*package\s+([\w.]+)\s*;", "import": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;", "class": r"\b(?:class|record|enum)\s+(\w+)",
    "interface": r"\binterface\s+(\w+)", "constructed": r"\bnew\s+([A-Z]\w*)\s*[(<]",
}
JAVA_METHOD = r"^\s*(?:public|private|protected|static|final|synchronized|abstract|\s)+[\w<>\[\],?\s]+?\b(\w+)\s*\([^;]*\)\s*(?:throws\s+[\w.,\s]+)?\{?\s*$"
SCRIPT = {
    "class": r"\bclass\s+(\w+)", "function": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "arrow": r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>",
    "import": r"""(?m)^\s*import\b[^'"]*['"]([^'"]+)['"]""", "require": r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""",
}
SCRIPT_FUNCTION = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*|(?:const|let|var)\s+|static\s+)?(\w+)\s*(?:=\s*(?:async\s*)?)?\([^)]*\)\s*(?:=>\s*)?\{\s*$"
C_FUNCTION = r"^[A-Za-z_][\w\s\*]*?\b(\w+)\s*\([^;]*\)\s*\{?\s*$"
CALL = r"(?:\b(\w+)\.)?\b(\w+)\s*\("


def definitions(files: DataFrame, patterns: dict[str, str], path: str = "path", source: str = "source") -> DataFrame:
    """(path, kind, name)."""
    clean = files.select(path, strip_block_comments(F.col(source)).alias("s"))

    def named(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("s", F.lit(pattern), 1), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    found = F.concat(*(named(k, p) for k, p in patterns.items()))
    return clean.select(path, F.inline(found)).distinct()


def spans(files: DataFrame, opener: str, path: str = "path", source: str = "source") -> DataFrame:
    """(path, name, lineno, end_lineno, body): lines that open a definition, up to the line before the next one."""
    lines = files.select(path, F.posexplode(F.split(strip_block_comments(F.col(source)), "\n")).alias("no", "line")).withColumn("name", F.regexp_extract("line", opener, 1))
    lines = lines.withColumn("name", F.when((F.col("name") != "") & ~F.col("name").isin(*NO_CALLS), F.col("name")))
    upto = Window.partitionBy(path).orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = lines.withColumn("part", F.count("name").over(upto)).where("part > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
    return owned.groupBy(path, "part").agg(F.max("name").alias("name"), (F.min("no") + 1).alias("lineno"), (F.max("no") + 1).alias("end_lineno"), body.alias("body")).drop("part")


def calls_in(spans_: DataFrame, path: str = "path") -> DataFrame:
    """(path, caller, receiver, name, lineno): calls of each span, without its own opening line."""
    lines = spans_.select(path, F.col("name").alias("caller"), "lineno", F.posexplode(F.split("body", "\n")).alias("k", "line")).where("k > 0")
    found = F.arrays_zip(F.regexp_extract_all("line", F.lit(CALL), 1).alias("receiver"), F.regexp_extract_all("line", F.lit(CALL), 2).alias("name"))
    out = lines.select(path, "caller", (F.col("lineno") + F.col("k")).alias("lineno"), F.inline(found))
    return out.where(~F.col("name").isin(*NO_CALLS)).select(path, "caller", F.when(F.col("receiver") != "", F.col("receiver")).alias("receiver"), "name", "lineno")


def go_calls(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """(path, caller, callee, lineno, resolution) of calls to functions of the same package and methods of the receiver."""
    package = files.select(path, F.regexp_extract(source, GO["package"], 1).alias("package"))
    opener = r"^func\s+(?:\(\s*\w+\s+\*?\w+\s*\)\s*)?(\w+)\s*\("
    parts = spans(files, opener, path, source).withColumns({"var": F.regexp_extract("body", GO_METHOD, 1), "type": F.regexp_extract("body", GO_METHOD, 2)}).join(package, path)
    parts = parts.withColumn("own", F.concat_ws(".", "package", F.when(F.col("type") != "", F.col("type")), "name"))
    calls = calls_in(parts, path).join(parts.select(path, F.col("name").alias("caller"), "package", "var", "type", "own", F.col("lineno").alias("_from"), F.col("end_lineno").alias("_to")), [path, "caller"]).where("lineno BETWEEN _from AND _to")
    known = parts.select("package", F.col("type").alias("k_type"), F.col("name").alias("k_name"), F.col("own").alias("callee")).distinct()
    want = F.when(F.col("receiver").isNull(), "").when((F.col("var") != "") & (F.col("receiver") == F.col("var")), F.col("type"))
    hit = calls.withColumn("k_type", want).where("k_type IS NOT NULL").withColumn("k_name", F.col("name")).join(known, ["package", "k_type", "k_name"])
    return hit.select(path, F.col("own").alias("caller"), "callee", "lineno", F.when(F.col("k_type") == "", "go_same_package_func").otherwise("go_method_on_receiver").alias("resolution")).distinct()


def csharp_calls(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """(path, caller, callee, lineno, resolution) of calls to methods of the same type and of the types of fields."""
    types = definitions(files, {"class": CSHARP["class"]}, path, source).groupBy(path).agg(F.min("name").alias("type"))
    parts = spans(files, r"^\s*" + CSHARP_METHOD.removesuffix(r"\{") + r"\{?\s*$", path, source).join(types, path)
    methods = parts.select(F.col("type").alias("k_type"), F.col("name").alias("k_name")).distinct()
    clean = files.select(path, strip_block_comments(F.col(source)).alias("s"))
    fields = clean.select(path, F.inline(F.arrays_zip(F.regexp_extract_all("s", F.lit(CSHARP_FIELD), 1).alias("f_type"), F.regexp_extract_all("s", F.lit(CSHARP_FIELD), 2).alias("receiver"))))
    calls = calls_in(parts, path).join(types, path).join(fields, [path, "receiver"], "left")
    own = F.col("receiver").isNull() | (F.col("receiver") == "this")
    hit = calls.withColumn("k_type", F.when(own, F.col("type")).otherwise(F.col("f_type"))).withColumn("k_name", F.col("name")).join(methods, ["k_type", "k_name"])
    return hit.select(path, F.concat_ws(".", "type", "caller").alias("caller"), F.concat_ws(".", "k_type", "k_name").alias("callee"), "lineno", F.when(own, "csharp_same_type_method").otherwise("csharp_field_type_method").alias("resolution")).distinct()


def same_type_calls(files: DataFrame, opener: str, kind: dict[str, str], label: str, path: str = "path", source: str = "source") -> DataFrame:
    """(path, caller, callee, lineno, resolution): calls without a receiver, or on this, to functions of the same file.

    A file's first class, if it has one, qualifies the names.
    """
    types = definitions(files, {"class": kind["class"]}, path, source).groupBy(path).agg(F.min("name").alias("type"))
    parts = spans(files, opener, path, source).join(types, path, "left")
    own = F.concat_ws(".", "type", "name")
    known = parts.select(F.col(path).alias("k_path"), F.col("name").alias("known"), own.alias("callee")).distinct()
    calls = calls_in(parts, path).where("receiver IS NULL OR receiver = 'this'").join(types, path, "left")
    hit = calls.join(known, (F.col(path) == F.col("k_path")) & (F.col("name") == F.col("known")))
    return hit.select(path, F.concat_ws(".", "type", "caller").alias("caller"), "callee", "lineno", F.lit(label).alias("resolution")).distinct()


def java_calls(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    return same_type_calls(files, JAVA_METHOD, JAVA, "java_same_class_method", path, source)


def script_calls(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    return same_type_calls(files, SCRIPT_FUNCTION, SCRIPT, "direct_name_call", path, source)


def c_calls(files: DataFrame, path: str = "path", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(edges within a file, unresolved calls once per line and name)."""
    parts = spans(files, C_FUNCTION, path, source)
    calls = calls_in(parts, path)
    known = parts.select(F.col(path).alias("k_path"), F.col("name").alias("known")).distinct()
    at = calls.join(known, (F.col(path) == F.col("k_path")) & (F.col("name") == F.col("known")), "left")
    edges = at.where("known IS NOT NULL").select(path, "caller", F.col("name").alias("callee"), "lineno", F.lit("direct_name_call").alias("resolution"))
    return edges, at.where("known IS NULL").select(path, "lineno", "name", F.lit("cross_file_unresolved").alias("pattern")).distinct()


def c_includes(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    return files.select(path, F.explode(F.regexp_extract_all(source, F.lit(r'(?m)^\s*#include\s*[<"]([^>"]+)[>"]'), 1)).alias("include")).distinct()
