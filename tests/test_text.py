"""Text helpers (P9-P15) and the source-file scan."""

import pytest
import datetime as dt
import os
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from packtables.functions import text as tx
from packtables.options import PackOptions
from packtables.sources.files import excluded, scan_directories, watched


def test_relative_age_edges(spark):
    as_of = dt.datetime(2024, 1, 2, 0, 0, 0)
    ages = [59, 3600, 3601, 86399, 86400, -5]
    df = spark.createDataFrame([(as_of - dt.timedelta(seconds=a),) for a in ages], "c timestamp")
    got = [r.a for r in df.select(tx.relative_age(F.col("c"), F.lit(as_of)).alias("a")).collect()]
    assert got == ["0 minutes ago", "60 minutes ago", "1 hours ago", "23 hours ago", "1 days ago", "0 minutes ago"]


def test_short_message_and_hash(spark):
    df = spark.createDataFrame([("abcdef0123", "  first line " + "x" * 100 + "\nsecond  ")], "h string, m string")
    r = df.select(tx.short_hash("h").alias("h"), tx.short_message("m").alias("m")).first()
    assert r.h == "abcdef0" and r.m == ("first line " + "x" * 100)[:80]


def test_xml_escape_and_cdata_round_trip(spark):
    name, body = 'a"b&<c>', "x ]]> y & <z>"
    df = spark.createDataFrame([(name, body)], "n string, b string")
    r = df.select(tx.xml_escape("n").alias("n"), tx.cdata("b").alias("b")).first()
    doc = ET.fromstring(f'<e name="{r.n}">{r.b}</e>')
    assert doc.get("name") == name and doc.text == body


def test_truncate_and_head_summary(spark):
    body = "\n".join(str(i) for i in range(70))
    df = spark.createDataFrame([(body,)], "b string")
    r = df.select(tx.truncate_lines("b", 60).alias("t"), tx.head_summary("b", F.lit("s.py")).alias("h")).first()
    assert r.t == "\n".join(str(i) for i in range(60)) + "\n  // ... truncated"
    assert r.h == "// [blast radius - imports s.py]\n0\n1\n2\n// ..."


def test_scan_lists_hidden_names_and_replaces_bad_bytes(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text("def f():\n    return 1\n")
    (root / "_app.tsx").write_text("function App() { return 1; }\n")
    (root / "bad.py").write_bytes(b"bad\xff\xfe")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("x()")
    (root / "a.min.js").write_text("x()")
    (root / "notes.txt").write_text("x")
    files = scan_directories(spark, [("r", str(root))], PackOptions(), num_partitions=2)
    got = {r.path: r.content for r in files.collect()}
    assert set(got) == {"pkg/__init__.py", "_app.tsx", "bad.py"}
    assert got["bad.py"] == "bad��"


def test_exclude_and_watch_filters(spark):
    paths = ["src/a.py", "dist/a.py", "x/node_modules/y.ts", "src/a.min.js", "src/a.log", "lib/.next/a.ts",
             "src/.vscode/a.ts", "src/a.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: (r.e, r.w) for r in df.select("p", excluded("p", PackOptions().exclude).alias("e"),
                                              watched("p").alias("w")).collect()}
    assert got["src/a.py"] == (False, True)
    assert got["dist/a.py"][0] and not got["dist/a.py"][1]
    assert got["src/a.min.js"] == (True, True)
    assert got["src/a.log"] == (False, False)
    assert got["src/.vscode/a.ts"] == (False, False)
    assert got["src/a.md"] == (False, False)
    assert os.sep == "/"


def test_unreadable_folders_give_error_rows(spark, tmp_path):
    """A root that cannot be listed is a row with its error, one that went away is none; ``scan_directories`` raises."""
    from packtables.sources.files import scan

    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "a.py").write_text("x = 1\n")
    (tmp_path / "file").write_text("not a folder")
    roots = [("r", str(tmp_path / "ok")), ("bad", str(tmp_path / "file")), ("gone", str(tmp_path / "nothing"))]
    found = scan(spark, roots, PackOptions(), num_partitions=2)
    assert [(r.repo_id, r.path) for r in found.files.collect()] == [("r", "a.py")]
    assert [(r.repo_id, r.path, r.error.split(":")[0]) for r in found.errors.collect()] == [("bad", "", "NotADirectoryError")]
    with pytest.raises(OSError, match="bad"):
        scan_directories(spark, roots, PackOptions(), num_partitions=2)
