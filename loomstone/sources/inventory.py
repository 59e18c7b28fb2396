"""Files as rows: scans, classes by extension, manifests, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.paths import IGNORED_DIRS, extension, under_ignored

#: Extension -> language, in the order in which adapters are asked.
LANGUAGES = {
    ".py": "python", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".cs": "csharp", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".rs": "rust",
    ".sql": "sql", ".ddl": "sql", ".dml": "sql", ".proc": "sql", ".sp": "sql", ".fnc": "sql", ".prc": "sql", ".trg": "sql", ".pkg": "sql",
    ".pkb": "sql", ".pks": "sql", ".pgsql": "sql", ".plpgsql": "sql", ".tsql": "sql", ".vw": "sql", ".view": "sql", ".pls": "sql", ".plsql": "sql",
}
IMPLEMENTED = ("python", "java", "javascript", "typescript", "go", "csharp", "c", "cpp", "sql")
DOCUMENTS = (".md", ".rst", ".txt", ".adoc", ".pdf", ".docx", ".html")
MODELS = (".onnx", ".pt", ".pth", ".h5", ".pb", ".safetensors", ".gguf", ".joblib", ".pkl")
CONFIGS = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".env", ".xml")
DEPENDENCY_FILES = ("requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "pipfile", "package.json", "pom.xml", "build.gradle", "go.mod", "cargo.toml")
ENTRY_NAMES = ("main.py", "app.py", "manage.py", "wsgi.py", "asgi.py", "__main__.py", "index.js", "server.js", "main.go", "main.rs", "program.cs")
BUILD_FILES = {"makefile": "make", "cmakelists.txt": "cmake", "pom.xml": "maven", "build.gradle": "gradle", "package.json": "npm", "pyproject.toml": "pyproject", "setup.py": "setuptools", "cargo.toml": "cargo", "go.mod": "go", "dockerfile": "docker"}


def scan(spark: SparkSession, root: str, glob: str | None = None, ignored=IGNORED_DIRS) -> DataFrame:
    """(path, ext, depth, length, modified, content): files under the root but for ignored folders, paths relative.

    Spark's file sources pass over empty files, which matter here (an empty __init__.py makes a package), so these come
    from the file system's listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    files = reader.load(base).select("path", "length", "modificationTime", "content").unionByName(_empty_files(spark, base, glob))
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + "/" + base.removeprefix("file:").lstrip("/") + "/", "")
    files = files.withColumn("path", relative).where(~under_ignored(F.col("path"), ignored))
    return files.select("path", extension(F.col("path")).alias("ext"), F.size(F.split("path", "/")).alias("depth"), "length", F.col("modificationTime").alias("modified"), "content")


def _empty_files(spark: SparkSession, base: str, glob: str | None) -> DataFrame:
    from fnmatch import fnmatch

    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    listed, found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True), []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0 and fnmatch(f.getPath().getName(), glob or "*"):
            found.append((f.getPath().toString(), f.getModificationTime()))
    empty = spark.createDataFrame(found, "path string, ms long")
    return empty.select("path", F.lit(0).cast("long").alias("length"), F.timestamp_millis("ms").alias("modificationTime"), F.lit(b"").alias("content"))


def language(ext) -> F.Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), ext)


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    """files with ext, language, tier (model, language, document, unknown: the first that fits) and flags."""
    ext, low = extension(F.col(path)), F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    tier = F.when(ext.isin(*MODELS), "model").when(language(ext).isNotNull(), "language").when(ext.isin(*DOCUMENTS), "document").otherwise("unknown")
    return files.withColumns({
        "ext": ext, "language": language(ext), "tier": tier, "is_config": ext.isin(*CONFIGS), "is_dependency_file": name.isin(*DEPENDENCY_FILES),
        "is_entry_point": name.isin(*ENTRY_NAMES), "in_test_dir": low.rlike("(^|/)(tests?|testing|spec)/"), "build_system": F.element_at(F.create_map(*(F.lit(x) for kv in BUILD_FILES.items() for x in kv)), name),
    })


def language_counts(files: DataFrame) -> DataFrame:
    """(language, files, implemented): null counts files without an adapter."""
    return files.groupBy("language").agg(F.count("*").alias("files")).withColumn("implemented", F.col("language").isin(*IMPLEMENTED))


def unmatched_extensions(files: DataFrame) -> DataFrame:
    return files.where("language IS NULL").groupBy("ext").agg(F.count("*").alias("files"))


def dominant_language(files: DataFrame) -> DataFrame:
    """(language, votes, share): translation units vote; declaration files only where there are no units; none on a tie."""
    from loomstone.functions.paths import is_declaration
    from loomstone.operators.profile import dominant

    known = files.where("language IS NOT NULL").withColumn("unit", ~is_declaration(F.col("path")))
    units = known.agg(F.max("unit").alias("any_unit"))  # one row
    return dominant(known.crossJoin(units).where(F.col("unit") | ~F.col("any_unit")), [], "language")


def requirements(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, package): package names of requirements files, lower-cased, without comments, options and versions."""
    lines = files.where(F.lower(path).rlike(r"(^|/)requirements[^/]*\.txt$")).select(path, F.explode(F.split(F.col(content).cast("string"), "\n")).alias("line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    name = F.lower(F.regexp_extract(line, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    return lines.select(path, name.alias("package")).where("package <> ''").distinct()


def package_json(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, package, dev)."""
    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    read = files.where(F.lower(path).rlike(r"(^|/)package\.json$")).select(path, F.from_json(F.col(content).cast("string"), schema).alias("j"))
    part = lambda c, dev: read.where(F.col(c).isNotNull()).select(path, F.explode(F.map_keys(c)).alias("package"), F.lit(dev).alias("dev"))
    return part("j.dependencies", False).union(part("j.devDependencies", True))


#: Texts in build files of Java and in package.json, with the signal (type, weight) that each gives.
JAVA_MARKERS = {
    "spring-boot": ("WEB_APPLICATION", 2), "springframework": ("WEB_APPLICATION", 2), "spring.boot": ("WEB_APPLICATION", 2), "org.springframework": ("WEB_APPLICATION", 2),
    "hibernate": ("WEB_APPLICATION", 1), "jakarta.persistence": ("WEB_APPLICATION", 1), "javax.servlet": ("API_SERVICE", 1), "io.quarkus": ("API_SERVICE", 2),
    "io.micronaut": ("API_SERVICE", 2), "org.elasticsearch": ("DATA_ENGINEERING", 2), "co.elastic": ("DATA_ENGINEERING", 2),
}
FRONTEND_MARKERS = ('"react"', '"react-dom"', '"vue"', '"@angular/', '"svelte"', '"next"', '"nuxt"', '"gatsby"')
#: Secondary frameworks by a text that names them in a manifest.
SECONDARY = {
    "celery": "Celery", "sqlalchemy": "SQLAlchemy", "alembic": "Alembic", "redis": "Redis", "dramatiq": "Dramatiq", "rq": "RQ", "pytest": "Pytest",
    "pydantic": "Pydantic", "marshmallow": "Marshmallow", "httpx": "HTTPX", "requests": "Requests",
}


def manifest_signals(files: DataFrame, signatures: DataFrame) -> DataFrame:
    """(path, type, weight): what manifests (path, content) tell of a repository's kind.

    signatures: (package, type, weight), a dimension table. Requirements and setup files give a signal a line, a project
    file one for each package that it names, build files of Java and package.json one for each marker that they hold.
    """
    read = files.select("path", F.lower(F.col("content").cast("string")).alias("text"), F.element_at(F.split(F.lower("path"), "/"), -1).alias("name"))
    lines = read.where(F.col("name").startswith("requirements") | F.col("name").isin("pipfile", "setup.py", "setup.cfg")).select("path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("no", "line"))
    line = F.trim("line")
    lines = lines.where((line != "") & ~line.rlike(r"^(#|git\+|-r |--|-e |\./|\.\./)")).select("path", F.col("no").cast("string").alias("no"), F.trim(F.split(line, r"[>=<!;\[@]")[0]).alias("raw"))
    quoted = F.regexp_extract_all("text", F.lit("[\"']([a-z][a-z0-9\\-_.]+?)(?:[>=<!;\\[,\\s\"'])"), 1)
    keyed = F.regexp_extract_all("text", F.lit(r"(?m)^([a-z][a-z0-9\-_.]+)\s*="), 1)
    named = read.where("name = 'pyproject.toml'").select("path", F.explode(F.array_distinct(F.concat(quoted, keyed))).alias("raw"))
    # A name is looked up with underscores, then as it is; a project file also tries underscores for dots and dashes.
    forms = lambda dots: F.array(F.translate("raw", "-.", "__") if dots else F.translate("raw", "-", "_"), F.col("raw"), F.translate("raw", "_.", "--") if dots else F.col("raw"))
    tried = lines.select("path", "no", F.posexplode(forms(False)).alias("rank", "package")).unionByName(named.select("path", F.col("raw").alias("no"), F.posexplode(forms(True)).alias("rank", "package")))
    hit = tried.join(signatures, "package").groupBy("path", "no").agg(F.min_by(F.struct("package", "type", "weight"), "rank").alias("found"))
    hit = hit.join(read.select("path", F.col("name") == "pyproject.toml"), "path").toDF("path", "no", "found", "once")
    by_line = hit.where("NOT once").select("path", "found.type", "found.weight")
    by_package = hit.where("once").select("path", "found").distinct().select("path", "found.type", "found.weight")
    java = F.filter(F.array(*(F.when(F.contains("text", F.lit(m)), F.struct(F.lit(t).alias("type"), F.lit(w).alias("weight"))) for m, (t, w) in JAVA_MARKERS.items())), lambda x: x.isNotNull())
    front = F.filter(F.array(*(F.when(F.contains("text", F.lit(m)), F.struct(F.lit("FRONTEND_APPLICATION").alias("type"), F.lit(2).alias("weight"))) for m in FRONTEND_MARKERS)), lambda x: x.isNotNull())
    builds = read.where(F.col("name").isin("pom.xml", "build.gradle", "build.gradle.kts")).select("path", F.inline(java))
    scripts = read.where("name = 'package.json'").select("path", F.inline(front))
    return by_line.union(by_package).union(builds).union(scripts).select("path", "type", F.col("weight").cast("long").alias("weight"))


def secondary_frameworks(files: DataFrame) -> DataFrame:
    """(framework): those that a manifest (content) names anywhere, also inside a word, each once."""
    text = F.lower(F.col("content").cast("string"))
    found = F.filter(F.array(*(F.when(F.contains(text, F.lit(k)), v) for k, v in SECONDARY.items())), lambda x: x.isNotNull())
    return files.select(F.explode(found).alias("framework")).distinct()


def package_folder(files: DataFrame, package: str) -> DataFrame:
    """One row (folder, depth): the shallowest folder of the package's name with an __init__.py, the smaller of equals."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    own = files.where(F.col("path").endswith("/__init__.py")).select(folder.alias("folder")).where(F.element_at(F.split("folder", "/"), -1) == package)
    return own.select("folder", F.size(F.split("folder", "/")).alias("depth")).orderBy("depth", "folder").limit(1)


def entry_points(files: DataFrame, content: str = "content", most: int = 100) -> DataFrame:
    """(path): named entry files, and of the first `most` Python files those that run something; 0 lifts the bound."""
    text = F.col(content).cast("string")
    python = files.where("language = 'python'").orderBy("path")
    python = python.limit(most) if most else python
    marked = python.where(F.contains(text, F.lit("__main__")) | text.rlike(r"@\w+\.(route|command)|@click\."))
    return files.where("is_entry_point").select("path").union(marked.select("path")).distinct()


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or lines as rows; broken records keep their text in _corrupt_record."""
    return spark.read.schema(schema + ", _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """json, csv (with a header) or parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path)
