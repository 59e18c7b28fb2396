"""Facts of Python sources: one parse per file, on the executors, as rows of one wide table.

kind is one of function, class, import, call, assign, return, docstring, annotation, entry, dispatch, parse_error. A broken file gives a parse_error
row, never a failed task. Facts hold no resolution; joins resolve them (loomstone.operators.calls).
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.paths import module_name

FACTS = (
    "module string, kind string, id string, name string, scope array<string>, class string, lineno int, end_lineno int, seq int, "
    "target string, items array<string>, texts array<string>, flag boolean"
)
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
_KINDS = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "int": pa.int32(), "boolean": pa.bool_()}
KINDS = [_KINDS[c.split()[1]] for c in FACTS.split(", ")]
#: Facts that a task holds before it hands them on, besides those of one file.
HELD = 4096


def dotted(node: ast.AST) -> list[str] | None:
    """a.b.c as its names; calls and subscripts in between are passed through as nothing known."""
    out: list[str] = []
    while isinstance(node, ast.Attribute):
        out.append(node.attr)
        node = node.value
    return [node.id, *out[::-1]] if isinstance(node, ast.Name) else None


def value_shape(node: ast.AST | None) -> tuple[str, str | None]:
    """(shape, name) of a value: builtin with its type, call with the dotted callee, name, none or unknown."""
    kinds = {ast.List: "list", ast.ListComp: "list", ast.Dict: "dict", ast.DictComp: "dict", ast.Set: "set", ast.SetComp: "set", ast.JoinedStr: "str", ast.Tuple: "tuple"}
    if node is None or isinstance(node, ast.Constant) and node.value is None:
        return "none", None
    for kind, name in kinds.items():
        if isinstance(node, kind):
            return "builtin", name
    if isinstance(node, ast.Constant):
        return "builtin", type(node.value).__name__
    if isinstance(node, ast.Call) and (path := dotted(node.func)):
        return "call", ".".join(path)
    if isinstance(node, ast.Name):
        return "name", node.id
    return "unknown", None


class _Names(ast.NodeTransformer):
    def visit_Name(self, node: ast.Name) -> ast.AST:
        return ast.copy_location(ast.Name("v", node.ctx), node)

    def visit_arg(self, node: ast.arg) -> ast.AST:
        return ast.copy_location(ast.arg("a", None), node)

    def visit_FunctionDef(self, node: ast.FunctionDef) -> ast.AST:
        self.generic_visit(node)
        node.name = "f"
        return node


def typed_constant(value: object) -> str:
    """A constant as text that is equal when Python's values are: True and 1, 1 and 1.0."""
    if isinstance(value, (bool, int, float)) and abs(value) < 2**53 and value == int(value):
        return f"n:{int(value)}"
    return f"{type(value).__name__}:{value!r}"


def body_facts(node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    """What comparing function bodies needs, once per function."""
    inner = list(ast.walk(node))
    return {
        "operators": [type(n.op).__name__ for n in inner if isinstance(n, ast.BinOp)],
        "constants": sorted({typed_constant(n.value) for n in inner if isinstance(n, ast.Constant)}),
        "recursive": any(isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == node.name for n in inner),
        "nested": any(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for n in inner if n is not node),
        "empty": all(isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) for s in node.body),
        "normalised": ast.dump(_Names().visit(ast.parse(ast.unparse(node)))),
    }


class Visitor(ast.NodeVisitor):
    """Collects facts; scope is the path of enclosing classes and functions."""

    def __init__(self, module: str, source: str, bodies: bool):
        self.module, self.source, self.bodies = module, source, bodies
        self.rows: list[dict] = []
        self.scope: list[str] = []
        self.kinds: list[str] = []
        self.seq = 0

    def put(self, kind: str, node: ast.AST | None = None, **more: object) -> None:
        self.seq += 1
        row = dict.fromkeys(COLUMNS) | {"module": self.module, "kind": kind, "scope": list(self.scope), "class": self.own_class(), "seq": self.seq}
        if node is not None:
            row |= {"lineno": getattr(node, "lineno", None), "end_lineno": getattr(node, "end_lineno", None)}
        self.rows.append(row | more)

    def own_class(self) -> str | None:
        for name, kind in zip(reversed(self.scope), reversed(self.kinds), strict=True):
            if kind == "class":
                return name
        return None

    def owner(self) -> str:
        inside = any(k == "function" for k in self.kinds)
        return ".".join([self.module, *self.scope]) if inside else f"{self.module}.<module>"

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [".".join(p) for b in node.bases if (p := dotted(b))]
        self.put("class", node, id=".".join([self.module, *self.scope, node.name]), name=node.name, items=bases, flag=ast.get_docstring(node) is not None)
        for d in (*node.decorator_list, *node.bases):
            self.visit(d)
        self._inside(node, "class")

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        texts = None
        if self.bodies:
            b = body_facts(node)
            texts = [b["normalised"], "\n".join(b["operators"]), "\n".join(b["constants"]), str(b["recursive"]), str(b["nested"]), str(b["empty"]), ast.get_source_segment(self.source, node) or ""]
        fid = ".".join([self.module, *self.scope, node.name])
        self.put("function", node, id=fid, name=node.name, items=[a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)], texts=texts, flag=isinstance(node, ast.AsyncFunctionDef), target="class" if self.kinds[-1:] == ["class"] else "function" if self.kinds else None)
        if ast.get_docstring(node) is not None:
            self.put("docstring", node, id=fid)
        for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
            if a.annotation is not None and (path := dotted(a.annotation)):
                self.put("annotation", a, id=fid, name=a.arg, target=".".join(path))
        for d in node.decorator_list:
            self.visit(d)
        self._inside(node, "function")

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _inside(self, node: ast.AST, kind: str) -> None:
        self.scope.append(node.name)
        self.kinds.append(kind)
        for child in node.body:
            self.visit(child)
        self.scope.pop()
        self.kinds.pop()

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.put("import", node, name=a.asname or a.name.split(".")[0], target=a.name if a.asname else a.name.split(".")[0], items=["0", a.name, ""])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.put("import", node, name=a.asname or a.name, target=".".join(x for x in (node.module or "", a.name) if x), items=[str(node.level), node.module or "", a.name])

    def visit_Assign(self, node: ast.Assign) -> None:
        self.visit(node.value)
        for target in node.targets:
            if isinstance(node.value, ast.Dict):
                self._entries(target, node.value.values)
            if isinstance(target, ast.Subscript):
                self._entries(target.value, [node.value])
        if len(node.targets) == 1 and isinstance(node.targets[0], (ast.Name, ast.Attribute)):
            path = dotted(node.targets[0])
            shape, name = value_shape(node.value)
            if path:
                self.put("assign", node, name=".".join(path), target=name, items=[shape], id=self.owner())

    def _entries(self, registry: ast.AST, values: list[ast.AST]) -> None:
        """What a dispatch table holds: names put into a dictionary by a literal, a subscript or a registering call."""
        if isinstance(registry, ast.Name):
            for value in values:
                if path := dotted(value):
                    self.put("entry", value, id=self.owner(), name=registry.id, target=".".join(path))

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        path, kind = dotted(node.target), dotted(node.annotation)
        if path and kind:
            self.put("annotation", node, id=self.owner(), name=".".join(path), target=".".join(kind))
        self.generic_visit(node)

    def visit_Return(self, node: ast.Return) -> None:
        shape, name = value_shape(node.value)
        self.put("return", node, id=self.owner(), target=name, items=[shape])
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        path, made = dotted(node.func), node.func
        if isinstance(made, ast.Attribute) and made.attr in ("register", "setdefault"):
            self._entries(made.value, node.args)
        taken = made.value if isinstance(made, ast.Subscript) else made.func.value if isinstance(made, ast.Call) and isinstance(made.func, ast.Attribute) and made.func.attr == "get" else None
        if isinstance(taken, ast.Name):
            self.put("dispatch", node, id=self.owner(), name=taken.id)
        if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Call) and dotted(node.func.value.func) == ["super"]:
            path = ["super()", node.func.attr]
        name = node.func.attr if isinstance(node.func, ast.Attribute) else path[0] if path else None
        if name is not None:
            self.put("call", node, id=self.owner(), name=name, target=".".join(path) if path else None, items=path)
        self.generic_visit(node)


def file_facts(module: str, source: str, bodies: bool) -> list[dict]:
    visitor = Visitor(module, source, bodies)
    try:
        visitor.visit(ast.parse(source))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        visitor.rows = []
        visitor.scope, visitor.kinds = [], []
        visitor.put("parse_error", target=type(e).__name__)
    return visitor.rows


def fact_batches(batches: Iterator[pa.RecordBatch], bodies: bool) -> Iterator[pa.RecordBatch]:
    """Facts of (module, source) in batches of at most HELD; how many files a batch brings doesn't count."""
    rows: list[dict] = []

    def batch(part: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], k) for c, k in zip(COLUMNS, KINDS, strict=True)], names=COLUMNS)

    for files in batches:
        for module, source in zip(files.column(0), files.column(1), strict=True):
            rows += file_facts(module.as_py(), source.as_py(), bodies)
            while len(rows) >= HELD:
                yield batch(rows[:HELD])
                rows = rows[HELD:]
    yield batch(rows)


def python_facts(files: DataFrame, path: str = "path", source: str = "source", bodies: bool = False) -> DataFrame:
    """Facts of files (path, source); `bodies` adds what duplicate detection compares.

    Sources are small and take long to parse, so they are dealt to all tasks, however few parts they come in.
    """
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = files.select(module_name(F.col(path)).alias("module"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    return texts.repartition(tasks, "module", "source").mapInArrow(lambda batches: fact_batches(batches, bodies), FACTS)


def function_bodies(facts: DataFrame) -> DataFrame:
    """The functions table of loomstone.operators.duplicates."""
    t = lambda i: F.get("texts", i)
    lines = lambda i: F.filter(F.split(t(i), "\n"), lambda x: x != "")
    return facts.where("kind = 'function' AND NOT flag").select(
        "id", F.col("module").alias("file"), "name", F.col("lineno").alias("start_line"), t(0).alias("normalised"), lines(1).alias("operators"), lines(2).alias("constants"),
        (t(3) == "True").alias("recursive"), (t(4) == "True").alias("nested"), (F.col("target") == "function").alias("inner_"), (t(5) == "True").alias("empty"), t(6).alias("code"),
    ).withColumn("inner", F.coalesce("inner_", F.lit(False))).drop("inner_")
