"""Import resolution ladder (J6, J7), edges (G1) and dependents."""

from packtables.operators import graph
from packtables.operators.code import language_of
from packtables.operators.imports import extract_imports
from pyspark.sql import functions as F


def _files(spark, items):
    df = spark.createDataFrame([("r", p, c) for p, c in items], "repo_id string, path string, content string")
    return df.withColumn("lang", language_of("path"))


def _edges(spark, items):
    files = _files(spark, items)
    imps = extract_imports(files)
    return {(r.src, r.dst) for r in graph.build_edges(imps, files).collect()}


def test_stem_collision_later_path_wins(spark):
    e = _edges(spark, [("x/utils.py", "a = 1\n"), ("y/utils.py", "b = 1\n"), ("main.py", "import utils\n")])
    assert e == {("main.py", "y/utils.py")}


def test_relative_and_external_imports(spark):
    e = _edges(spark, [("pkg/a.py", "from . import x\nimport os\n"), ("pkg/b.ts", "import {a} from './c';\n"),
                       ("pkg/c.ts", "export const a = () => 1;\n"), ("app.go", 'import "pkg/c"\n')])
    assert e == {("pkg/b.ts", "pkg/c.ts"), ("app.go", "pkg/c.ts")}


def test_self_import_dropped(spark):
    assert _edges(spark, [("m.py", "import m\n")]) == set()


def test_dependents_cycle(spark):
    edges = spark.createDataFrame([("r", "A", "B"), ("r", "B", "A"), ("r", "C", "B")], "repo_id string, src string, dst string")
    seeds = spark.createDataFrame([("r", "A")], "repo_id string, path string")
    got = {(r.dependent, r.hops) for r in graph.dependents(seeds, edges, max_hops=2).collect()}
    assert got == {("B", 1), ("C", 2)}


def test_dependents_many_hops_cut_lineage(spark):
    chain = [("r", f"n{i+1}", f"n{i}") for i in range(8)]
    edges = spark.createDataFrame(chain, "repo_id string, src string, dst string")
    seeds = spark.createDataFrame([("r", "n0")], "repo_id string, path string")
    got = {(r.dependent, r.hops) for r in graph.dependents(seeds, edges, max_hops=7, checkpoint_every=2).collect()}
    assert got == {(f"n{i}", i) for i in range(1, 8)}


def test_normalize_path(spark):
    df = spark.createDataFrame([("a/b/../c/./d",), ("../x",), ("a/../../y",)], "p string")
    got = [r.n for r in df.select(graph.normalize_path(F.col("p")).alias("n")).collect()]
    assert got == ["a/c/d", "../x", "../y"]
