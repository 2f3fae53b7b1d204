"""Streams against their batch twins (T1, T5) and the hand-written TTL rows."""

import datetime as dt


from pyspark.sql import functions as F

from packtables.sources.store import read_index
from packtables.streaming.changes import CHANGE_SCHEMA, flush_rows, sessions
from packtables.streaming.requests import ttl_compiles, ttl_compiles_stream


def _changes(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", "a.py", "added", t0, 1, "x", "python"),
            ("r", "a.py", "modified", t0 + dt.timedelta(seconds=2), 2, "y", "python"),   # exactly gap: merges
            ("r", "b.py", "deleted", t0 + dt.timedelta(seconds=3), 3, None, None),
            ("r", "a.py", "deleted", t0 + dt.timedelta(seconds=10), 4, None, None),
            ("s", "c.py", "added", t0 + dt.timedelta(seconds=1), 5, "z", "python"),
            ("r", "z.py", "added", t0 + dt.timedelta(seconds=100), 6, "w", "python")]   # closes the stream
    return spark.createDataFrame(rows, CHANGE_SCHEMA)


def test_flush_keeps_last_change_per_path(spark):
    got = {(r.repo_id, r.path, r.change_type) for r in flush_rows(_changes(spark), 2).collect()}
    assert ("r", "a.py", "modified") in got and ("r", "a.py", "deleted") in got
    assert ("r", "b.py", "deleted") in got


def test_stream_sessions_equal_batch(spark, tmp_path):
    src = tmp_path / "feed"
    _changes(spark).write.parquet(str(src))
    stream = spark.readStream.schema(CHANGE_SCHEMA).parquet(str(src))
    q = (sessions(stream, "2 seconds", "1 second").writeStream.format("memory").queryName("sess_t")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    streamed = {tuple(r) for r in spark.sql("select repo_id, session_start, n_changes from sess_t").collect()}
    batch = {tuple(r) for r in sessions(_changes(spark), "2 seconds").select(
        "repo_id", "session_start", "n_changes").collect()}
    # the last session is still open on the stream (no later event closes it)
    assert streamed == batch - {max(batch, key=lambda x: x[1])}


def _requests(spark, secs):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("k", t0 + dt.timedelta(seconds=s), i) for i, s in enumerate(secs)],
                                 "fingerprint string, ts timestamp, seq long")


def test_ttl_rows(spark):
    rows = ttl_compiles(_requests(spark, [0, 299, 301, 600, 601, 1000])).orderBy("seq").collect()
    # 601 is within 300 s of the compile at 301; 1000 is not
    assert [r.compiled for r in rows] == [True, False, True, False, False, True]
    assert [r.served_by for r in rows] == [0, 0, 2, 2, 2, 5]


def test_ttl_stream_equals_batch(spark, tmp_path):
    secs = [0, 5, 299, 300, 301, 650, 700, 2000, 2001]
    df = _requests(spark, secs)
    src = tmp_path / "req"
    df.write.parquet(str(src))
    _requests(spark, [90_000]).withColumn("seq", F.lit(99).cast("long")).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = (ttl_compiles_stream(stream).writeStream.format("memory").queryName("ttl_t").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    streamed = {(r.seq, r.compiled) for r in spark.sql("select seq, compiled from ttl_t").collect()}
    batch = {(r.seq, r.compiled) for r in ttl_compiles(df).collect()}
    assert streamed == batch            # the request that moved the watermark still waits


def test_follow_changes_equals_batch(spark, tmp_path):
    """The snapshot left by the stream equals the batch rebuild of the final state."""
    from packtables.operators import code
    from packtables.streaming.changes import follow_changes, last_state

    t0 = dt.datetime(2024, 1, 1)
    py = "import b\n\ndef f():\n    return g()\n"
    rows1 = [("r", "a.py", "added", t0, 1, py, "python"),
             ("r", "b.py", "added", t0 + dt.timedelta(seconds=1), 2, "def g():\n    return 1\n", "python"),
             ("r", "c.py", "added", t0 + dt.timedelta(seconds=1), 3, "x = 1\n", "python")]
    rows2 = [("r", "c.py", "deleted", t0 + dt.timedelta(seconds=30), 4, None, None),
             ("r", "b.py", "modified", t0 + dt.timedelta(seconds=31), 5, "def h():\n    return 2\n", "python"),
             ("r", "x/README.md", "added", t0 + dt.timedelta(seconds=32), 6, "x", None),
             ("r", "zz.py", "added", t0 + dt.timedelta(seconds=300), 7, "y = 2\n", "python")]   # closes session 2
    feed, store, ck = tmp_path / "feed", str(tmp_path / "store"), str(tmp_path / "ck")
    spark.createDataFrame(rows1, CHANGE_SCHEMA).write.parquet(str(feed / "p1"))
    spark.createDataFrame(rows2, CHANGE_SCHEMA).write.parquet(str(feed / "p2"))
    q = follow_changes(spark, str(feed / "*"), store, ck, gap="2 seconds", watermark="1 second", trigger_once=True)
    q.awaitTermination(300)
    t = read_index(spark, store)
    files = {(r.path, r.content) for r in t["files"].collect()}
    all_changes = spark.createDataFrame(rows1 + rows2[:-1], CHANGE_SCHEMA)
    expect = {(r.path, r.content) for r in last_state(all_changes).filter("path like '%.py'").collect()}
    assert files == expect
    assert {r.name for r in code.symbols_of(t["tagged"]).collect()} == {"f", "h"}
    assert {(r.src, r.dst) for r in t["edges"].collect()} == {("a.py", "b.py")}
    assert {r.text.split("(")[0]: len(r.embedding) for r in t["chunks"].collect()} == {"def f": 64, "def h": 64}


def test_flush_keeps_untouched_repos(spark):
    """T4: a flush of repos a and z leaves the files, edges and chunks of b as they were, and b's vectors too."""
    from packtables.operators import code, graph
    from packtables.operators.imports import extract_imports
    from packtables.operators.vectors import embed_column
    from packtables.plans.index import chunks_of
    from packtables.streaming.changes import apply_flush

    t0 = dt.datetime(2024, 1, 1)
    old = [(r, "m.py", "import n\n\ndef f():\n    return 1\n", "python") for r in "ab"] + [(r, "n.py", "def g():\n    return 2\n", "python") for r in "ab"]
    files = spark.createDataFrame(old, "repo_id string, path string, content string, lang string")
    tagged = code.extract(files)
    edges = graph.build_edges(extract_imports(files), files)
    chunks = embed_column(chunks_of(code.symbols_of(tagged)), "text", dim=8)
    flush = spark.createDataFrame([("a", "n.py", "deleted", t0, 1, None, None), ("z", "k.py", "added", t0, 2, "import j\n", "python"),
                                   ("z", "j.py", "added", t0, 3, "def h():\n    return 3\n", "python")], CHANGE_SCHEMA)
    for given in (edges, None):
        out = apply_flush(files, tagged, flush, edges=given, chunks=chunks, dim=8)
        assert {(r.repo_id, r.src, r.dst) for r in out.edges.collect()} == {("b", "m.py", "n.py"), ("z", "k.py", "j.py")}
        assert {(r.repo_id, r.path) for r in out.chunks.collect()} == {("a", "m.py"), ("b", "m.py"), ("b", "n.py"), ("z", "j.py")}
        assert {(r.repo_id, r.path) for r in out.files.collect()} == {("a", "m.py"), ("b", "m.py"), ("b", "n.py"), ("z", "j.py"), ("z", "k.py")}


def test_long_sessions_have_few_buckets(spark, monkeypatch):
    """A session of many gaps is placed like the others, through coarser buckets."""
    from packtables.streaming import changes as C

    monkeypatch.setattr(C, "FAN", 4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", f"{i}.py", "added", t0 + dt.timedelta(seconds=2 * i), i, "x", "python") for i in range(300)]
    rows += [("r", "late.py", "added", t0 + dt.timedelta(seconds=900), 400, "x", "python"), (None, "n.py", "added", t0, 401, "x", "python")]
    ch = spark.createDataFrame(rows, CHANGE_SCHEMA)
    got = flush_rows(ch, 2).groupBy("repo_id", "session_start").count().collect()
    assert sorted(r["count"] for r in got) == [1, 1, 300]


def test_ttl_state_expires_in_a_later_batch(spark, tmp_path):
    """Two expiries in micro-batches of their own, then the key comes back."""
    t0 = dt.datetime(2024, 1, 1)
    src, batches = tmp_path / "req", [[("k", 0, 1), ("j", 5, 2), ("k", 10, 3)], [("x", 3000, 4)], [("y", 9000, 5), ("k", 9001, 6), ("k", 9002, 7)],
                                      [("x", 20000, 8)], [("k", 30000, 9)]]
    schema = "fingerprint string, ts timestamp, seq long"
    make = lambda rows: spark.createDataFrame([(k, t0 + dt.timedelta(seconds=s), i) for k, s, i in rows], schema)
    make(batches[0]).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = (ttl_compiles_stream(stream, ttl_seconds=300, watermark="10 seconds").writeStream.format("memory").queryName("ttl_x")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    for b in batches[1:]:
        make(b).write.mode("append").parquet(str(src))
        q.processAllAvailable()
    q.stop()
    streamed = {(r.seq, r.compiled) for r in spark.sql("select seq, compiled from ttl_x").collect()}
    rows = make([r for b in batches[:-1] for r in b])           # the last one moves the watermark past the others
    assert streamed == {(r.seq, r.compiled) for r in ttl_compiles(rows).collect()}


def test_ttl_of_shuffled_arrivals_equals_batch(spark, tmp_path):
    """Requests that come late, in other batches than later ones, are judged in the order of their times."""
    import random

    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = sorted((rng.choice("abc"), t0 + dt.timedelta(seconds=rng.randrange(4000)), i) for i in range(120))
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(500)))          # up to 500 s late
    rows.append(("end", t0 + dt.timedelta(days=1), 999))                                # moves the watermark past all others
    schema = "fingerprint string, ts timestamp, seq long"
    src = tmp_path / "req"
    make = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    make(rows[:40])
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = (ttl_compiles_stream(stream, ttl_seconds=300, watermark="10 minutes").writeStream.format("memory").queryName("ttl_s")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    for part in (rows[40:80], rows[80:]):
        make(part)
        q.processAllAvailable()
    q.stop()
    streamed = {(r.seq, r.compiled) for r in spark.sql("select seq, compiled from ttl_s").collect()}
    batch = {(r.seq, r.compiled) for r in ttl_compiles(spark.createDataFrame(rows[:-1], schema)).collect()}
    assert streamed == batch and 10 < sum(c for _, c in batch) < 110


def test_streamed_request_log_equals_batch(spark, tmp_path):
    """A4: late rows are added to their window; a replayed batch is not counted twice."""
    from packtables.streaming.requests import append_request_log, log_from_events, read_request_log, request_log

    ev = log_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).orderBy("tokens")
    src, sink = str(tmp_path / "log"), str(tmp_path / "sink")
    for part in ev.randomSplit([0.5, 0.5], seed=1):
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):
        append_request_log(stream, sink, str(tmp_path / "ck"), trigger_once=True).awaitTermination(120)
    got = {tuple(r) for r in read_request_log(spark, sink).select("window_start", "task_type", "status", "requests", "tokens").collect()}
    assert got == {tuple(r) for r in request_log(ev).collect()}


def test_ttl_of_null_keys_and_dense_requests(spark):
    """Null fingerprints are a key; chains inside long segments are followed."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(seconds=7 * i), i) for k in ("a", None) for i in range(400)]
    got = ttl_compiles(spark.createDataFrame(rows, "fingerprint string, ts timestamp, seq long"), ttl_seconds=60).collect()
    want, last = {}, None
    for i in range(400):
        if last is None or 7 * i > 7 * last + 60:
            last = i
        want[i] = last
    assert len(got) == 800 and all(r.served_by == want[r.seq] and r.compiled == (want[r.seq] == r.seq) for r in got)


def test_enrich_stream_writes_each_batch(spark, tmp_path):
    """A request stream compiled micro-batch by micro-batch (here: signals only)."""
    from packtables.functions.signals import with_signals
    from packtables.streaming.requests import enrich_stream

    src = tmp_path / "req"
    spark.createDataFrame([(1, "fix FooBar"), (2, "explain a.py")], "request_id long, prompt string") \
        .write.parquet(str(src))
    stream = spark.readStream.schema("request_id long, prompt string").parquet(str(src))
    q = enrich_stream(stream, lambda b: with_signals(b).select("request_id", "task_type"),
                      str(tmp_path / "out"), str(tmp_path / "ck"), trigger_once=True)
    q.awaitTermination(120)
    got = {(r.request_id, r.task_type) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "debug"), (2, "explain")}


def test_enrich_stream_compiles_packs(spark, tmp_path):
    """T6 with the ready-made compiler: packs for a streamed batch of requests."""
    from packtables.plans import registry as R
    from packtables.plans.index import embed_chunks
    from packtables.streaming.requests import enrich_stream, pack_compiler

    sf = "/root/testdata/sf0.001"
    inp = R.strategy_inputs(spark, sf)
    reqs = R.fixture(spark, sf).requests.limit(5)
    src = tmp_path / "req"
    reqs.write.parquet(str(src))
    stream = spark.readStream.schema(reqs.schema).parquet(str(src))
    fn = pack_compiler(inp.index, embed_chunks(inp.index, dim=16), inp.commit_summary, R.OPTS, dim=16)
    q = enrich_stream(stream, fn, str(tmp_path / "out"), str(tmp_path / "ck"), trigger_once=True)
    q.awaitTermination(300)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 5 and all(r.token_count <= R.OPTS.max_pack_tokens and r.xml.startswith("<context_pack")
                                 for r in out)
