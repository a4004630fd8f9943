"""What the syntax tree of a Python file says: its imports, and its symbols with their scopes and docstrings."""

from __future__ import annotations

import ast
import warnings
from collections import deque
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.session import written

_IMPORT = "struct<module: string, names: array<string>, level: int, line: int>"
_SYMBOL = "struct<name: string, kind: string, scope: string, line: int, docstring: string>"
TREE = f"parsed boolean, docstring string, imports array<{_IMPORT}>, symbols array<{_SYMBOL}>"
_KINDS = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}


def _tree(source: str | None) -> dict:
    """One file. Imports are those of the file's own level; symbols stand level by level, as deep as they are nested."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            module = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {"parsed": False, "docstring": None, "imports": [], "symbols": []}
    imports, symbols = [], []
    for node in module.body:
        if isinstance(node, ast.Import):
            imports += [{"module": a.name, "names": [], "level": 0, "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append({"module": node.module, "names": [a.name for a in node.names], "level": node.level, "line": node.lineno})
    queue = deque([(module, "")])
    while queue:
        node, scope = queue.popleft()
        for child in ast.iter_child_nodes(node):
            inner = scope
            if kind := _KINDS.get(type(child)):
                symbols.append({"name": child.name, "kind": kind, "scope": scope, "line": child.lineno, "docstring": ast.get_docstring(child)})
                inner = f"{scope}.{child.name}" if scope else child.name
            elif node is module and isinstance(child, ast.Assign | ast.AnnAssign):
                targets = child.targets if isinstance(child, ast.Assign) else [child.target]
                symbols += [{"name": n.id, "kind": "variable", "scope": "", "line": child.lineno, "docstring": None} for t in targets for n in ast.walk(t) if isinstance(n, ast.Name)]
            queue.append((child, inner))
    return {"parsed": True, "docstring": ast.get_docstring(module), "imports": imports, "symbols": symbols}


@cache
def _trees():
    @F.pandas_udf(TREE)
    def run(source: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_tree(x) for x in source], columns=["parsed", "docstring", "imports", "symbols"])

    return run


def tree(source: Column) -> Column:
    """struct<parsed, docstring, imports, symbols> of a file's text; a file that can't be parsed has parsed false and nothing else, a null one is empty."""
    return _trees()(source)


def documentation(path: Column, content: Column, t: Column) -> Column:
    """A file as a retrieval document: its path, its docstring, and each function or class that has one under its name. Files that can't be parsed keep their text."""
    own = F.filter(t["symbols"], lambda s: (s["kind"] != "variable") & (s["docstring"] != ""))
    each = F.transform(own, lambda s: F.concat(F.lit("\n\n"), s["name"], F.lit("\n"), s["docstring"]))
    return F.concat(path, F.lit("\n"), F.when(t["parsed"], F.concat(F.coalesce(t["docstring"], F.lit("")), F.array_join(each, ""))).otherwise(content))


def module_name(path: Column) -> Column:
    """The dotted name of a file; a package's __init__ has the package's."""
    return F.replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))


def symbol_names(path: Column, content: Column, t: Column) -> Column:
    """A file as a retrieval document: its path, module and docstring, and in the file's order the full names of its variables, functions and classes with their docstrings."""
    name = module_name(path)
    own = F.array_sort(t["symbols"], lambda a, b: F.when(a["line"] < b["line"], -1).when(a["line"] > b["line"], 1).otherwise(0))
    full = lambda s: F.concat_ws(".", name, F.nullif(s["scope"], F.lit("")), s["name"])
    each = F.transform(own, lambda s: F.concat(full(s), F.lit("\n"), F.when(s["docstring"] != "", F.concat(s["docstring"], F.lit("\n\n"))).otherwise("")))
    head = F.concat(name, F.lit("\n"), F.when(t["docstring"] != "", F.concat(t["docstring"], F.lit("\n\n"))).otherwise(""))
    return F.concat(path, F.lit("\n"), F.when(t["parsed"], F.concat(head, F.array_join(each, ""))).otherwise(content))


def imports(files: DataFrame, *, group: str, path: str, content: str) -> DataFrame:
    """(group, path, module, names, level, line) of each import statement at the level of a file."""
    return files.select(group, path, F.explode(tree(F.col(content))["imports"]).alias("_i")).select(group, path, "_i.*")


def import_edges(files: DataFrame, *, group: str = "repo", path: str = "path", content: str = "content") -> DataFrame:
    """(group, src, dst): which files of its group (a repository at a commit) a file's imports lead to.

    A module is the file of its name and the files directly in a folder of its name. An
    absolute name is looked for below any folder: the match with the fewest folders above it
    counts, ties by path. A relative one starts at the importing file's folder, one level
    higher for each further dot. Names that no file has lead nowhere. What a file's name may
    be called by (each ending of its dotted name) is made in its row, so names meet in one
    join by group and name. Null groups don't match; a file doesn't lead to itself.
    """
    f = files.select(F.col(group).alias("_g"), F.col(path).alias("_p"), F.col(content).alias("_c")).where(F.endswith(path, F.lit(".py")))
    own = imports(f, group="_g", path="_p", content="_c")
    parts = F.split(F.col("_p"), "/")
    base = F.slice(parts, 1, F.greatest(F.size(parts) - F.col("level"), F.lit(0)))
    asked = F.when(F.col("level") == 0, F.col("module")).otherwise(F.array_join(F.concat(base, F.when(F.col("module").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.replace("module", F.lit("."), F.lit("/"))))), "/"))
    asked = F.when(F.col("level") == 0, F.replace(asked, F.lit("."), F.lit("/"))).otherwise(asked)
    too_far = F.col("level") > F.size(parts)
    own = own.where(~too_far).select("_g", F.col("_p").alias("src"), asked.alias("_name"), (F.col("level") > 0).alias("_exact")).distinct()
    own = written(own, "imports")  # files are parsed once
    # a file by its own name, and by its folder's
    places = f.select("_g", F.col("_p").alias("dst"), F.explode(F.array(F.struct(F.regexp_replace("_p", r"\.py$", "").alias("at"), F.lit("file").alias("kind")), F.struct(F.when(F.contains("_p", F.lit("/")), F.regexp_replace("_p", "/[^/]*$", "")).otherwise("").alias("at"), F.lit("folder").alias("kind")))).alias("_x")).select("_g", "dst", "_x.*")
    steps = F.split("at", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.array_join(F.slice(steps, i, F.size(steps)), "/").alias("name"), (i - 1).alias("above")))
    places = places.select("_g", "dst", "kind", "at", F.explode(endings).alias("_e")).select("_g", "dst", "kind", "at", F.col("_e.name").alias("_name"), F.col("_e.above").alias("above"))
    # by the size of their files both sides look small enough to be broadcast, but rows are made from them, so they are shuffled; a name is looked up once, whoever imports it
    names = own.select("_g", "_name", "_exact").distinct()
    w = Window.partitionBy("_g", "_name", "_exact", "kind").orderBy("above", "at")
    hits = names.join(places.hint("merge"), ["_g", "_name"]).where(~F.col("_exact") | (F.col("above") == 0))
    hits = hits.withColumn("_rank", F.dense_rank().over(w)).where("_rank = 1").select("_g", "_name", "_exact", "dst")
    j = own.join(hits.hint("merge"), ["_g", "_name", "_exact"]).where(F.col("src") != F.col("dst"))
    return j.select(F.col("_g").alias(group), "src", "dst").distinct()
