"""Index store: per-repo rebuild (S7, S8) and content-hash reuse."""

from pyspark.sql import functions as F

from packtables.operators.code import language_of
from packtables.plans.index import build_index, load_index
from packtables.sources.store import body_errors, read_index, requests_from_bodies, reuse_or_embed, write_index


def test_rebuild_replaces_only_its_repos(spark, tmp_path):
    path = str(tmp_path / "idx")
    v1 = spark.createDataFrame([("a", "x.py", "1"), ("a", "old.py", "2"), ("b", "y.py", "3")],
                               "repo_id string, path string, content string")
    write_index({"files": v1}, path)
    v2 = spark.createDataFrame([("a", "x.py", "9")], "repo_id string, path string, content string")
    write_index({"files": v2}, path)            # rebuild of repo a: old.py must go, repo b stays
    got = {(r.repo_id, r.path, r.content) for r in read_index(spark, path)["files"].collect()}
    assert got == {("a", "x.py", "9"), ("b", "y.py", "3")}
    only_b = read_index(spark, path, repos=["b"])["files"]
    assert {r.path for r in only_b.collect()} == {"y.py"}


def test_reuse_by_repo_and_hash(spark):
    chunks = spark.createDataFrame([("a", 1, "def f(): pass"), ("a", 2, "new text"), ("b", 3, "def f(): pass")],
                                   "repo_id string, chunk_id long, text string")
    stored = spark.createDataFrame([("a", "0" * 32, [0.0])], "repo_id string, content_hash string, embedding array<float>")
    stored = stored.unionByName(chunks.filter("chunk_id = 1").select(
        "repo_id", F.md5("text").alias("content_hash"), F.array(F.lit(7.0).cast("float")).alias("embedding")))
    out = {r.chunk_id: (r.reused, list(r.embedding)) for r in reuse_or_embed(chunks, stored, dim=4).collect()}
    assert out[1] == (True, [7.0])
    assert out[2][0] is False and len(out[2][1]) == 4
    assert out[3][0] is False                   # same text in another repo is not reused


def test_build_index_written_equals_in_memory(spark, tmp_path):
    import os

    files = spark.createDataFrame([("a", "m.py", "import n\n\ndef f():\n    return g()\n"), ("a", "n.py", "def g():\n    return 1\n"),
                                   ("b", "x.go", "package x\n\nfunc X() {}\n")],
                                  "repo_id string, path string, content string").withColumn("lang", language_of("path"))
    mem = build_index(files)
    disk = build_index(files, path=str(tmp_path / "idx"))
    for t in ("symbols", "imports", "calls", "edges"):
        a = {repr(tuple(r)) for r in getattr(mem, t).collect()}
        b = {repr(tuple(r)) for r in getattr(disk, t).collect()}
        assert a == b, t
    version, = (d for d in os.listdir(tmp_path / "idx" / "tagged") if d.startswith("commit="))
    assert sorted(d for d in os.listdir(tmp_path / "idx" / "tagged" / version) if d.startswith("part=")) == ["part=r_a", "part=r_b"]
    loaded = load_index(spark, str(tmp_path / "idx"))
    assert {r.text: len(r.embedding) for r in loaded.vectors.collect()} == {r.text: 64 for r in mem.chunks.collect()}


def test_rebuild_leaves_no_stale_rows(spark, tmp_path):
    """The only import of a repo goes, then all its files: no old import row or edge comes back."""
    path = str(tmp_path / "idx")
    rows = [("a", "m.py", "import n\n"), ("a", "n.py", "def g():\n    return 1\n"), ("b", "x.py", "import y\n"), ("b", "y.py", "y = 1\n"),
            ("007", "z.py", "z = 1\n"), (None, "q.py", "def q():\n    pass\n")]
    make = lambda rows: spark.createDataFrame(rows, "repo_id string, path string, content string").withColumn("lang", language_of("path"))
    assert build_index(make(rows), path=path).edges.count() == 2
    idx = build_index(make([("a", "m.py", "x = 1\n"), rows[1]]), path=path)
    assert [tuple(r)[:3] for r in idx.edges.collect()] == [("b", "x.py", "y.py")]
    assert {r.repo_id for r in idx.imports.collect()} == {"b"}
    assert {(r.repo_id, r.path) for r in idx.files.collect()} == {("a", "m.py"), ("a", "n.py"), ("b", "x.py"), ("b", "y.py"),
                                                                ("007", "z.py"), (None, "q.py")}
    gone = spark.createDataFrame([("b",)], "repo_id string")
    idx = build_index(make([rows[1]]), path=path, repos=gone)
    assert idx.edges.count() == 0 and {r.repo_id for r in idx.files.collect()} == {"a", "007", None}


def test_malformed_bodies_become_error_rows(spark):
    raw = spark.createDataFrame([(1, '{"messages": [{"role": "user", "content": "hi"}]}'), (2, "{oops"), (3, None)], "request_id long, body string")
    got = {r.request_id: r.messages for r in requests_from_bodies(raw).collect()}
    assert got[1][0].content == "hi" and got[2] is None and got[3] is None
    assert {tuple(r) for r in body_errors(raw).collect()} == {(2, "malformed JSON"), (3, "no body")}
