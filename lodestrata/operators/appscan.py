"""Model references in application sources: Python by its syntax tree, JSON and TOML by their values."""

from __future__ import annotations

import ast
import json
import tomllib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Slots that name a model, packages of the providers' kits, folders that are left out.
CALL_SLOTS = ("model", "model_id")
CONFIG_SLOTS = ("model", "model_id", "model_name")
KITS = {"anthropic": "anthropic", "openai": "openai"}
SKIPPED = (".git", ".hg", ".svn", "node_modules", ".pnpm-store", ".venv", "venv", "env", "__pypackages__", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", "dist", "build", "site-packages", "eggs", "target", "vendor", ".idea", ".vscode", ".cursor")
MAX_BYTES = 1 << 20
SCHEMA = "path string, kind string, line long, key string, value string, provider string, reason string, expression string"


def project(spark: SparkSession, root: str) -> DataFrame:
    """path and content of .py, .json and .toml files of at most MAX_BYTES without a zero byte in the first 8 KiB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    some = files.where((F.col("length") <= MAX_BYTES) & F.lower("path").rlike(r"\.(py|json|toml)$"))
    # folders below the root count, not those that it lies in
    top = root.rstrip("/") + "/"
    below = F.concat(F.lit("/"), F.substring_index(F.col("path"), top, -1))
    for name in SKIPPED:
        some = some.where(~below.contains(f"/{name}/"))
    return some.where(F.locate("00", F.hex(F.substring("content", 1, 8192))) % 2 == 0).select("path", F.col("content").cast("string").alias("content"))


def constants(tree: ast.Module) -> dict[str, str]:
    """Names with exactly one binding in the whole file, that one being a string at module level."""
    bound: Counter[str] = Counter()
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load):
            bound[n.id] += 1
        elif isinstance(n, ast.arg):
            bound[n.arg] += 1
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            bound[n.name] += 1
        elif isinstance(n, ast.alias):
            bound[(n.asname or n.name).split(".")[0]] += 1
        elif isinstance(n, (ast.Global, ast.Nonlocal)):
            bound.update(n.names)
        elif isinstance(n, ast.ExceptHandler) and n.name:
            bound[n.name] += 1
        elif isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
            bound[n.name] += 1
    out = {}
    for n in tree.body:
        target = n.targets[0] if isinstance(n, ast.Assign) and len(n.targets) == 1 else n.target if isinstance(n, ast.AnnAssign) else None
        if isinstance(target, ast.Name) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) and bound[target.id] == 1:
            out[target.id] = n.value.value
    return out


def _environment(node: ast.expr) -> bool:
    """A call of getenv or getenvb, or environ subscripted or asked with get."""
    named = lambda n: n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else None
    if isinstance(node, ast.Subscript):
        return named(node.value) == "environ"
    if not isinstance(node, ast.Call):
        return False
    return named(node.func) in ("getenv", "getenvb") or isinstance(node.func, ast.Attribute) and node.func.attr == "get" and named(node.func.value) == "environ"


# Why a slot's value is not known, by the kind of its expression.
REASONS = {ast.Name: "name_not_bound", ast.Attribute: "unresolved_attribute", ast.Call: "dynamic_call", ast.Subscript: "dynamic_subscript", **dict.fromkeys((ast.JoinedStr, ast.BinOp, ast.BoolOp, ast.IfExp, ast.Await), "dynamic_expression")}


def _unbound(node: ast.expr) -> str:
    return "dynamic_expression" if _environment(node) else REASONS.get(type(node), "unresolved_expression")


def _shown(node: ast.expr, most: int = 160) -> str:
    """An expression on one line, cut where it is too long."""
    try:
        text = " ".join(ast.unparse(node).split())
    except (ValueError, RecursionError):
        text = type(node).__name__
    return text if len(text) <= most else text[: most - 3] + "..."


def python_references(source: str) -> list[tuple]:
    """(kind, line, key, value, provider, reason, expression); the provider is that of the one kit which the file imports."""
    tree = ast.parse(source)
    known, rows, kits = constants(tree), [], set()

    def slot(key: str, node: ast.expr):
        if isinstance(node, ast.Constant):
            if isinstance(node.value, str):
                rows.append(("literal", node.lineno, key, node.value, None, None))
        elif isinstance(node, ast.Name) and node.id in known:
            rows.append(("constant", node.lineno, key, known[node.id], None, None))
        else:
            rows.append(("unbound", node.lineno, key, None, _unbound(node), _shown(node)))

    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            slots = CONFIG_SLOTS if isinstance(n.func, ast.Name) and n.func.id == "dict" else CALL_SLOTS
            for k in n.keywords:
                if k.arg in slots:
                    slot(k.arg, k.value)
        elif isinstance(n, ast.Dict):
            for k, v in zip(n.keys, n.values, strict=True):
                if isinstance(k, ast.Constant) and k.value in CONFIG_SLOTS:
                    slot(k.value, v)
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or "", *(f"{n.module}.{a.name}" for a in n.names)]
            kits |= {p for p, kit in KITS.items() for x in names if x == kit or x.startswith(f"{kit}.")}
    provider = next(iter(kits)) if len(kits) == 1 else None
    return [(kind, line, key, value, provider, reason, text) for kind, line, key, value, reason, text in rows]


def config_references(value, at: str = "") -> list[tuple]:
    """The same of parsed JSON or TOML; key is the dotted path, with [i] for places in lists. Lines are not known."""
    rows = []
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{at}.{k}" if at else str(k)
            if k in CONFIG_SLOTS and isinstance(v, str):
                rows.append(("literal", None, path, v, None, None, None))
            rows += config_references(v, path)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            rows += config_references(v, f"{at}[{i}]")
    return rows


def observations(files: DataFrame) -> DataFrame:
    """References of files (path, content); a file that does not parse is one row of kind parse_error."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    text = text or ""
                    own = python_references(text) if path.lower().endswith(".py") else config_references(json.loads(text) if path.lower().endswith(".json") else tomllib.loads(text))
                except (SyntaxError, ValueError, RecursionError) as error:
                    own = [("parse_error", None, None, None, None, type(error).__name__, None)]
                rows += [(path, *r) for r in own]
            kinds = [pa.int64() if k == 2 else pa.string() for k in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def inventory(observed: DataFrame) -> DataFrame:
    """Dependencies: references with a value grouped by provider (null: not established) and value, with counts and first places."""
    some = observed.where("value IS NOT NULL")
    state = F.when(F.col("provider").isNotNull(), "established").otherwise("candidate")
    return some.groupBy("provider", F.col("value").alias("model_id"), state.alias("state")).agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_files"), F.min("path").alias("first_path"))


def unresolved(observed: DataFrame, most: int = 3) -> DataFrame:
    """Unbound references by reason, with the most frequent expressions."""
    from pyspark.sql import Window

    n = observed.where("kind = 'unbound'").groupBy("reason", "expression").agg(F.count("*").alias("n"))
    w = Window.partitionBy("reason")
    top = n.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "expression"))).withColumn("total", F.sum("n").over(w)).where(F.col("r") <= most)
    return top.groupBy("reason", "total").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "expression"))), lambda x: x["expression"]), " | ").alias("common"))
