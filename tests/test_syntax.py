"""Imports, symbols and documents by syntax tree; resolution of modules; what is reached."""

from pyspark.sql import functions as F

from runloom.functions import syntax
from runloom.operators import datasets, retrieval

SOURCE = '''"""Top."""
import os, a.b as c
from . import x
from ..pkg.mod import (y, z)
LIMIT: int = 3
first, (second, *rest) = range(3), (1, 2)
if True:
    def guarded():
        "Doc of guarded."
        import hidden
class Outer(Base):
    """Outer's."""
    size = 3
    async def run(self):
        class Inner:
            def go(self): pass
'''


def test_tree(spark):
    rows = [(1, SOURCE), (2, "def broken(:"), (3, None), (4, "x = '\x00'"), (5, "f(" * 4000)]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i long, s string").select("i", syntax.tree(F.col("s")).alias("t")).collect()}
    t = got[1]
    assert t["parsed"] and t["docstring"] == "Top."
    assert [(i["module"], i["names"], i["level"]) for i in t["imports"]] == [("os", [], 0), ("a.b", [], 0), (None, ["x"], 1), ("pkg.mod", ["y", "z"], 2)]
    assert {(s["scope"], s["name"], s["kind"]) for s in t["symbols"]} == {("", n, "variable") for n in ("LIMIT", "first", "second", "rest")} | {("", "guarded", "function"), ("", "Outer", "class"), ("Outer", "run", "function"), ("Outer.run", "Inner", "class"), ("Outer.run.Inner", "go", "function")}
    assert [got[i]["parsed"] for i in (2, 3, 4, 5)] == [False, True, False, False] and got[2]["imports"] == got[3]["symbols"] == []


def test_documents(spark):
    df = spark.createDataFrame([("src/a.py", SOURCE), ("b/__init__.py", "def broken(:")], "p string, c string")
    doc = lambda style: [r["d"] for r in df.select(datasets.document(F.col("p"), F.col("c"), style).alias("d")).collect()]
    assert doc("docstrings") == ["src/a.py\nTop.\n\nOuter\nOuter's.\n\nguarded\nDoc of guarded.", "b/__init__.py\ndef broken(:"]
    assert doc("content")[0] == "src/a.py\n" + SOURCE
    assert doc("symbols") == ["src/a.py\nsrc.a\nTop.\n\nsrc.a.LIMIT\nsrc.a.first\nsrc.a.second\nsrc.a.rest\nsrc.a.guarded\nDoc of guarded.\n\nsrc.a.Outer\nOuter's.\n\nsrc.a.Outer.run\nsrc.a.Outer.run.Inner\nsrc.a.Outer.run.Inner.go\n", "b/__init__.py\ndef broken(:"]


FILES = {
    "src/app/main.py": "import app.util, os\nfrom .sub import one\nfrom . import util\n",
    "src/app/util.py": "from app.sub.one import f\nimport main\n",
    "src/app/sub/__init__.py": "",
    "src/app/sub/one.py": "from ..main import x\nfrom ...lib import deep\nfrom ..... import too_far\n",
    "src/lib/deep.py": "import app.nothing, lib\n",
    "vendor/x/app/util.py": "import util\n",
    "util.py": "",
    "README.md": "import app",
}


def test_import_edges(spark):
    rows = [("r", p, c) for p, c in FILES.items()] + [("other", "app/util.py", "import main"), (None, "util.py", "import util")]
    files = spark.createDataFrame(rows, "repo string, path string, content string").repartition(3)
    edges = syntax.import_edges(files)
    got = {}
    for r in edges.collect():
        assert r["repo"] == "r"
        got.setdefault(r["src"], set()).add(r["dst"])
    assert got == {
        "src/app/main.py": {"src/app/util.py", "src/app/sub/__init__.py", "src/app/sub/one.py"},
        "src/app/util.py": {"src/app/sub/one.py", "src/app/main.py"},
        "src/app/sub/one.py": {"src/app/main.py", "src/lib/deep.py"},
        "vendor/x/app/util.py": {"util.py"},
    }
    starts = spark.createDataFrame([("r", "src/app/sub/one.py"), ("r", "util.py"), ("other", "src/app/main.py")], "repo string, start string")
    reached = {}
    for r in retrieval.reached(edges, starts, ["repo"]).collect():
        reached.setdefault((r["repo"], r["start"]), set()).add(r["node"])
    assert reached == {("r", "src/app/sub/one.py"): {"src/app/sub/one.py", "src/app/main.py", "src/lib/deep.py", "src/app/util.py", "src/app/sub/__init__.py"}, ("r", "util.py"): {"util.py"}, ("other", "src/app/main.py"): {"src/app/main.py"}}


def test_made_rows_are_not_broadcast(spark, tmp_path):
    rows = [("r", "a/b.py", "import c\nfrom . import d"), ("r", "a/d.py", ""), ("r", "c/e.py", "import a.b"), ("r", "c.py", "")]
    spark.createDataFrame(rows, "repo string, path string, content string").write.parquet(str(tmp_path / "f"))
    e = syntax.import_edges(spark.read.parquet(str(tmp_path / "f")))
    assert "BroadcastHashJoin" not in e._jdf.queryExecution().executedPlan().toString()
    assert {(r["src"], r["dst"]) for r in e.collect()} == {("a/b.py", "c.py"), ("a/b.py", "c/e.py"), ("a/b.py", "a/d.py"), ("c/e.py", "a/b.py")}
