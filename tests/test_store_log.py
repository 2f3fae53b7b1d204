"""Commit log of the store: versions, streams over builds, replays, writers at once, deltas, compaction, vacuum."""

import datetime as dt
import hashlib
import os
import threading

import pytest

from packtables.operators.code import language_of
from packtables.plans.index import build_index, load_index
from packtables.sources import commitlog
from packtables.sources.commitlog import Conflict
from packtables.sources.store import compact, latest_version, read_index, vacuum, write_delta, write_index
from packtables.streaming.changes import CHANGE_SCHEMA, feed_between, feed_ranges, flush_store, follow_changes

T0 = dt.datetime(2024, 1, 1)
FILES = "repo_id string, path string, content string"


def files_of(spark, rows):
    return spark.createDataFrame(rows, FILES).withColumn("lang", language_of("path"))


def stored(spark, path, version=None):
    return {(r.repo_id, r.path, r.content) for r in read_index(spark, path, version=version)["files"].collect()}


def change(repo, path, kind, second, seq, content=None):
    return (repo, path, kind, T0 + dt.timedelta(seconds=second), seq, content, "python" if content is not None else None)


def noise(i):
    return "".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(16))


def bytes_below(path, part):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if part in d and f.endswith(".parquet"))


def test_stream_follows_several_builds(spark, tmp_path):
    """Builds v1 to v4, then a stream that changes D: the batches take later numbers, B and the others stay."""
    store, feed = str(tmp_path / "idx"), str(tmp_path / "feed")
    for repo in "CABD":
        build_index(files_of(spark, [(repo, "m.py", "import n\n"), (repo, "n.py", f"def of_{repo}():\n    return 1\n")]), path=store)
    assert latest_version(spark, store) == 4
    batches = [[change("D", "n.py", "modified", 10, 1, "def changed():\n    return 2\n")],
               [change("D", "o.py", "added", 100, 2, "import m\n"), change(None, "q.py", "added", 100, 3, "def q():\n    pass\n")],
               [change("D", "m.py", "deleted", 200, 4), change("zz", "x.py", "added", 900, 5, "x = 1\n")]]
    spark.createDataFrame(batches[0], CHANGE_SCHEMA).write.parquet(feed)
    q = follow_changes(spark, feed, store, str(tmp_path / "ck"), dim=8)
    q.processAllAvailable()
    for b in batches[1:]:
        spark.createDataFrame(b, CHANGE_SCHEMA).write.mode("append").parquet(feed)
        q.processAllAvailable()
    q.stop()
    assert {(r, p) for r, p, _ in stored(spark, store)} == {(r, p) for r in "ABC" for p in ("m.py", "n.py")} | {
        ("D", "n.py"), ("D", "o.py"), (None, "q.py")}
    idx = load_index(spark, store)
    assert {(r.repo_id, r.name) for r in idx.symbols.collect()} == {(r, f"of_{r}") for r in "ABC"} | {("D", "changed"), (None, "q")}
    assert {(r.repo_id, r.src, r.dst) for r in idx.edges.collect()} == {(r, "m.py", "n.py") for r in "ABC"}
    log = commitlog.commits(spark, store)
    assert [c.version for c in log] == list(range(1, len(log) + 1)) and len({c.query for c in log[4:]}) == 1
    assert stored(spark, store, version=4) == {(r, "m.py", "import n\n") for r in "ABCD"} | {
        (r, "n.py", f"def of_{r}():\n    return 1\n") for r in "ABCD"}


def test_replayed_batch_is_applied_once(spark, tmp_path):
    store = str(tmp_path / "idx")
    hits = spark.createDataFrame([change("a", "x.py", "added", 0, 1, "x = 1\n")], CHANGE_SCHEMA)
    assert flush_store(spark, store, hits, "query", 7, dim=8) == 1
    later = spark.createDataFrame([change("a", "x.py", "modified", 9, 2, "x = 2\n")], CHANGE_SCHEMA)
    assert flush_store(spark, store, later, "query", 8, dim=8) == 2
    assert flush_store(spark, store, hits, "query", 7, dim=8) == 1
    assert flush_store(spark, store, hits, "other", 7, dim=8) == 3       # another query's batch 7
    assert stored(spark, store) == {("a", "x.py", "x = 1\n")}


def test_numbers_of_writers_at_once(spark, tmp_path):
    """Ten writers publish at once: ten numbers, and a file that exists is never replaced."""
    store, got = str(tmp_path / "idx"), []
    one = lambda i: got.append(commitlog.publish(spark, store, f"c{i}", {}))
    threads = [threading.Thread(target=one, args=(i,)) for i in range(10)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = commitlog.commits(spark, store)
    assert sorted(got) == list(range(1, 11)) and len({c.commit for c in log}) == 10
    assert not commitlog.create_if_absent(spark, f"{store}/_log/{3:020d}.json", "{}")
    assert commitlog.commits(spark, store) == log and all(f.endswith(".json") or f.startswith(".") for f in os.listdir(f"{store}/_log"))


def test_writers_at_once_on_one_repository(spark, tmp_path):
    """A commit computed from an older version of the same repository is refused; the flush is computed anew."""
    store = str(tmp_path / "idx")
    write_index({"files": files_of(spark, [("a", "x.py", "1"), ("b", "y.py", "2")])}, store)
    rows = files_of(spark, [("a", "x.py", "9")])
    keys = lambda repo, path: spark.createDataFrame([(repo, path, "path")], "repo_id string, key string, kind string")
    write_delta({"files": files_of(spark, [("a", "z.py", "5")])}, keys("a", "z.py"), store, base=1)
    with pytest.raises(Conflict):
        write_delta({"files": rows}, keys("a", "x.py"), store, base=1)
    write_delta({"files": files_of(spark, [("b", "y.py", "3")])}, keys("b", "y.py"), store, base=1)
    errors = []

    def flush(i):
        try:
            flush_store(spark, store, spark.createDataFrame([change("a", f"w{i}.py", "added", i, i, f"w = {i}\n")], CHANGE_SCHEMA), dim=8)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=flush, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert stored(spark, store) == {("a", "x.py", "1"), ("a", "z.py", "5"), ("b", "y.py", "3")} | {("a", f"w{i}.py", f"w = {i}\n") for i in range(3)}


def test_delta_is_as_large_as_the_change(spark, tmp_path):
    """One file of a large repository: the bytes written follow it; the result equals a rebuild."""
    store, rebuilt = str(tmp_path / "idx"), str(tmp_path / "full")
    rows = [("big", f"p{i}.py", f"import p{i + 1}\n\ndef f{i}():\n    return '{noise(i)}'\n") for i in range(400)] + [(None, "n.py", "import k\n")]
    build_index(files_of(spark, rows), path=store, dim=8)
    before = bytes_below(store, "commit=")
    hits = [change("big", "p7.py", "modified", 0, 1, "import p9\n\ndef seven():\n    return 7\n"), change("big", "p400.py", "added", 0, 2, "y = 1\n"),
            change("big", "p11.py", "deleted", 0, 3), change(None, "k.py", "added", 0, 4, "def k():\n    return 1\n")]
    flush_store(spark, store, spark.createDataFrame(hits, CHANGE_SCHEMA), dim=8)
    written = bytes_below(store, "commit=") - before
    delta = commitlog.commits(spark, store)[-1].commit
    assert written < before / 10
    per_table = {t: spark.read.parquet(f"{store}/{t}/commit={delta}").count() for t in ("files", "chunks", "edges", "imports")}
    assert per_table == {"files": 3, "chunks": 2, "edges": 3, "imports": 1}
    after = [r for r in rows if r[1] not in ("p7.py", "p11.py")] + [(h[0], h[1], h[5]) for h in hits if h[5] is not None]
    build_index(files_of(spark, after), path=rebuilt, dim=8)
    mine, want = read_index(spark, store), read_index(spark, rebuilt)
    for t in want:
        cols = sorted(want[t].columns)
        assert sorted(map(repr, mine[t].select(cols).collect())) == sorted(map(repr, want[t].select(cols).collect())), t


def test_compaction_and_vacuum(spark, tmp_path):
    store = str(tmp_path / "idx")
    write_index({"files": files_of(spark, [("a", f"{i}.py", "0") for i in range(4)] + [("b", f"{i}.py", "0") for i in range(40)])}, store)
    for n in range(1, 4):
        hits = [change(r, f"{n}.py", "modified", n, n, f"v = {n}\n") for r in "ab"]
        flush_store(spark, store, spark.createDataFrame(hits, CHANGE_SCHEMA), "q", n, dim=8)
    before = stored(spark, store)
    assert compact(spark, store, ratio=0.5) == 5                # 3 of 4 files of a; 3 of 40 of b
    assert stored(spark, store) == before
    cov = {(r.repo_id, r.full) for r in spark.read.parquet(f"{store}/_covers/commit={commitlog.commits(spark, store)[-1].commit}").collect()}
    assert cov == {("a", True)}
    assert compact(spark, store, ratio=0.5) is None
    write_index({"files": files_of(spark, [("b", "new.py", "1")])}, store)
    open(os.path.join(store, "files", "stray"), "w").close()
    os.makedirs(os.path.join(store, "files", "commit=unfinished"))
    gone = vacuum(spark, store, keep=1, orphan_hours=24)
    assert len(gone) == 3                                       # the first build and two of three deltas; the query's last one stays
    assert os.path.isdir(os.path.join(store, "files", "commit=unfinished"))
    assert stored(spark, store) == {r for r in before if r[0] == "a"} | {("b", "new.py", "1")}
    assert flush_store(spark, store, spark.createDataFrame([change("a", "x.py", "added", 3, 3, "")], CHANGE_SCHEMA), "q", 3, dim=8) == 4
    assert "unfinished" in vacuum(spark, store, keep=1, orphan_hours=-1)


def test_flush_opens_the_files_of_its_sessions(spark, tmp_path):
    """The time index: each file of the feed is indexed once, and a time range opens only files that overlap it."""
    store, feed = str(tmp_path / "idx"), str(tmp_path / "feed")
    for i in range(12):
        spark.createDataFrame([change("a", f"{i}.py", "added", 100 * i + k, 10 * i + k, "x") for k in range(3)], CHANGE_SCHEMA).coalesce(1) \
            .write.mode("append").parquet(feed)
    part = feed_between(spark, feed, store, T0 + dt.timedelta(seconds=301), T0 + dt.timedelta(seconds=500))
    assert len(part.inputFiles()) == 3 and sorted(r.seq for r in part.collect()) == [31, 32, 40, 41, 42, 50]
    files = {f for f in os.listdir(os.path.join(store, "_feed")) if f.endswith(".parquet")}
    assert feed_ranges(spark, feed, store).count() == 12
    assert files == {f for f in os.listdir(os.path.join(store, "_feed")) if f.endswith(".parquet")}     # nothing was read again
    spark.createDataFrame([change("a", "late.py", "added", 350, 999, "x")], CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    part = feed_between(spark, feed, store, T0 + dt.timedelta(seconds=310), T0 + dt.timedelta(seconds=390))
    assert [r.seq for r in part.collect()] == [999] and len(part.inputFiles()) == 1
    assert feed_between(spark, feed, store, T0 - dt.timedelta(days=2), T0 - dt.timedelta(days=1)).count() == 0
