"""Change feed -> debounced, incremental index updates.

The reference flushes pending file changes after a quiet period of the whole
repository, keeps the last change per path, re-indexes only those files, and
rebuilds the dependency graph. Here the quiet period is a session window on
event time per ``repo_id`` (events exactly ``gap`` apart stay in one
session), and a flush becomes a delta of the touched files' rows: applied to tables by keyed anti-joins and unions, or
committed to a store, whose readers always see whole versions.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packtables.operators import code, graph
from packtables.operators.imports import extract_imports
from packtables.operators.joins import null_safe_join
from packtables.operators.vectors import embed_column
from packtables.plans.index import chunks_of
from packtables.session import cut_lineage
from packtables.sources import commitlog
from packtables.sources.commitlog import Conflict
from packtables.sources.files import watched
from packtables.sources.store import latest_version, read_index, reuse_or_embed, write_delta

FAN = 1024            # buckets a session is cut into at most (twice that at a border)
CHANGE_SCHEMA = ("repo_id string, path string, change_type string, ts timestamp, seq long, "
                 "content string, lang string")


def read_change_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                       schema: str = CHANGE_SCHEMA, max_files_per_trigger: int | None = None) -> DataFrame:
    """A change feed folder (Parquet/JSON files appended by an exporter) as a stream."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def watch_filter(changes: DataFrame) -> DataFrame:
    """S6 on a change table or stream."""
    return changes.filter(watched("path"))


def sessions(changes: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """One row per quiet-period flush of a repository.

    ``(repo_id, session_start, session_end, last_ts, n_changes)``; works on a
    table or a stream (with ``watermark``; a session is emitted once the
    watermark passes its end). Aggregates are partial: events are merged into
    sessions inside each map task before the shuffle on ``repo_id``.
    """
    c = changes.withWatermark("ts", watermark) if watermark else changes
    return (c.groupBy("repo_id", F.session_window("ts", gap).alias("s"))
            .agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_changes"))
            .select("repo_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "last_ts", "n_changes"))


def assign_sessions(changes: DataFrame, closed: DataFrame, gap_seconds: float) -> DataFrame:
    """Attach ``session_start`` to every change of the given sessions.

    An as-of join done as an equi-join: sessions are exploded into the time
    buckets they cover and joined with the changes on ``(repo_id, bucket)``,
    then checked against the session bounds. Buckets start at the width of the
    gap (two sessions of a repo are more than that apart, so a bucket meets at
    most two) and are coarser for long sessions, whose level is part of the
    key: a session covers at most ``FAN`` buckets of its level, however long
    it is, and a busy repository is still spread over many keys.
    """
    width = int(gap_seconds * 1_000_000)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    # a session of n gaps is cut at level ceil(log_FAN(n)): bucket width gap * FAN^level
    span = (us("last_ts") - us("session_start")) / F.lit(width)
    level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(span / F.lit(FAN), F.lit(1.0))) / math.log(FAN))).cast("int")
    wide = (F.lit(float(width)) * F.pow(F.lit(float(FAN)), F.col("_l"))).cast("long")
    sb = closed.select("repo_id", "session_start", "last_ts", level.alias("_l"))
    levels = [r[0] for r in sb.select("_l").distinct().collect()] or [0]      # a few numbers: logarithms
    sb = sb.withColumn("_b", F.explode(F.sequence(F.floor(us("session_start") / wide), F.floor(us("last_ts") / wide))))
    ev = changes.withColumn("_l", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("_b", F.floor(us("ts") / wide))
    hit = null_safe_join(ev, sb, ["repo_id", "_l", "_b"])
    return (hit.filter((F.col("ts") >= F.col("session_start")) & (F.col("ts") <= F.col("last_ts")))
            .drop("_b", "_l", "last_ts"))


def flush_rows(changes: DataFrame, gap_seconds: float) -> DataFrame:
    """T1 + T2 (batch): the last change per path within each session.

    Sessions come from ``sessions`` (merged map-side per repo); changes are
    placed in their session by the bucketed equi-join of ``assign_sessions``.
    Returns ``(repo_id, session_start, path, change_type, seq, ts, content, lang)``.
    """
    closed = sessions(changes, f"{int(gap_seconds * 1_000_000)} microseconds")
    c = assign_sessions(changes, closed, gap_seconds)
    last = F.max_by(F.struct("change_type", "seq", "ts", "content", "lang"), "seq")
    return (c.groupBy("repo_id", "session_start", "path").agg(last.alias("l"))
            .select("repo_id", "session_start", "path", "l.change_type", "l.seq", "l.ts", "l.content", "l.lang"))


def last_state(changes: DataFrame) -> DataFrame:
    """The file table after applying every change in order (deleted files absent)."""
    last = F.max_by(F.struct("change_type", "content", "lang"), "seq")
    s = changes.groupBy("repo_id", "path").agg(last.alias("l"))
    return (s.filter(F.col("l.change_type") != "deleted")
            .select("repo_id", "path", F.col("l.content").alias("content"), F.col("l.lang").alias("lang")))


class Flush(NamedTuple):
    """Index tables after a flush, for all repositories, and the repositories it touched."""
    files: DataFrame
    tagged: DataFrame
    imports: DataFrame
    edges: DataFrame
    chunks: DataFrame
    repos: DataFrame


class Delta(NamedTuple):
    """What a flush changes: the new rows of the touched files, and the edges that leave ``sources``, files with other edges."""
    files: DataFrame
    tagged: DataFrame
    imports: DataFrame
    edges: DataFrame
    chunks: DataFrame
    touched: DataFrame          # repo_id, path: added, modified and deleted files
    sources: DataFrame          # repo_id, src

    def keys(self) -> DataFrame:
        """``repo_id, key, kind`` of all rows that the flush replaces (``sources.store.write_delta``)."""
        return (self.touched.select("repo_id", F.col("path").alias("key"), F.lit("path").alias("kind"))
                .unionByName(self.sources.select("repo_id", F.col("src").alias("key"), F.lit("src").alias("kind"))))


def flush_delta(files: DataFrame, imports: DataFrame, edges: DataFrame, chunks: DataFrame, flush: DataFrame, embedder=None,
                dim: int = 64, scanners: dict | None = None) -> Delta:
    """T3 + T4: the rows that one flush adds, and the keys whose older rows go.

    Added and modified files are read and parsed alone; vectors of equal text are reused from ``chunks``. Edges are resolved
    over the touched repositories (a new file may be the target of an old import), and those of a file are replaced
    only if they differ.
    """
    # the changed files, their rows and the edges of their repositories are read several times below
    last = cut_lineage(flush.groupBy("repo_id", "path").agg(F.max_by(F.struct("change_type", "content", "lang"), "seq").alias("l")))
    touched = last.select("repo_id", "path")
    upserts = (last.filter(F.col("l.change_type") != "deleted")
               .select("repo_id", "path", F.col("l.content").alias("content"), F.col("l.lang").alias("lang")))
    repos = touched.select("repo_id").distinct()
    own = lambda df: null_safe_join(df, repos, ["repo_id"], "left_semi")
    added, added_imports = cut_lineage(code.extract(upserts, scanners=scanners)), extract_imports(upserts)
    new_files = code.replace_files(own(files).select("repo_id", "path"), upserts.select("repo_id", "path"), touched)
    columns = ["repo_id", "src", "dst", "line", "col"]
    new_edges = cut_lineage(graph.build_edges(code.replace_files(own(imports), added_imports, touched), new_files).select(*columns))
    old_edges = own(edges).select(*columns)
    differing = null_safe_join(new_edges, old_edges, columns, "left_anti").unionByName(null_safe_join(old_edges, new_edges, columns, "left_anti"))
    sources = cut_lineage(differing.select("repo_id", "src").distinct())        # as few as the change has
    stored = own(chunks).select("repo_id", F.md5("text").alias("content_hash"), "embedding")
    new_chunks = reuse_or_embed(chunks_of(code.symbols_of(added)), stored, "text", embedder=embedder, dim=dim)
    new_chunks = new_chunks.select("repo_id", "chunk_id", "path", "start_line", "end_line", "text", "embedding")
    return Delta(upserts, added, added_imports, null_safe_join(new_edges, sources, ["repo_id", "src"], "left_semi"), new_chunks,
                 touched, sources)


def apply_flush(files: DataFrame, tagged: DataFrame, flush: DataFrame, edges: DataFrame | None = None,
                chunks: DataFrame | None = None, embedder=None, dim: int = 64, scanners: dict | None = None,
                imports: DataFrame | None = None) -> Flush:
    """T3 + T4 + X8: apply one flush to the index tables.

    Deleted paths leave every table; added/modified paths are re-read and
    re-extracted alone; untouched files are not parsed again. Edges are
    resolved for the touched repositories; those of the others are carried
    over from ``edges`` (without it, all are built). The chunks of the
    touched files are cut anew and embedded, with vectors of equal text reused
    from ``chunks``.
    """
    imports = extract_imports(files) if imports is None else imports
    edges = graph.build_edges(imports, files) if edges is None else edges
    if chunks is None:
        chunks = embed_column(chunks_of(code.symbols_of(tagged)), "text", "embedding", embedder=embedder, dim=dim)
    d = flush_delta(files, imports, edges, chunks, flush, embedder, dim, scanners)
    new_edges = null_safe_join(edges, d.sources, ["repo_id", "src"], "left_anti").unionByName(d.edges, allowMissingColumns=True)
    return Flush(code.replace_files(files.select("repo_id", "path", "content", "lang"), d.files, d.touched),
                 code.replace_files(tagged, d.tagged, d.touched), code.replace_files(imports, d.imports, d.touched), new_edges,
                 code.replace_files(chunks, d.chunks, d.touched), d.touched.select("repo_id").distinct())


STORED = {"files": "repo_id string, path string, content string, lang string", "tagged": code.EXTRACT_SCHEMA,
          "imports": "repo_id string, path string, source string, names array<string>, line int, col int",
          "edges": "repo_id string, src string, dst string, line int, col int",
          "chunks": "repo_id string, chunk_id long, path string, start_line int, end_line int, text string, embedding array<float>"}


def flush_store(spark: SparkSession, store_dir: str, hits: DataFrame, query: str | None = None, batch: int | None = None,
                embedder=None, dim: int = 64, attempts: int = 5) -> int:
    """T3 on a store: commit the delta of one flush (``hits`` in ``CHANGE_SCHEMA``); returns the version.

    If another writer commits to one of the repositories meanwhile, the delta is computed anew from the newer version.
    """
    for left in reversed(range(attempts)):
        base = latest_version(spark, store_dir) or 0
        stored = read_index(spark, store_dir, version=base) if base else {}
        prev = {t: stored[t] if t in stored else spark.createDataFrame([], ddl) for t, ddl in STORED.items()}
        d = flush_delta(prev["files"], prev["imports"], prev["edges"], prev["chunks"], hits, embedder=embedder, dim=dim)
        try:
            return write_delta({t: getattr(d, t) for t in STORED}, d.keys(), store_dir, query, batch, base)
        except Conflict:
            if not left:
                raise
    raise AssertionError("attempts must be positive")


def feed_ranges(spark: SparkSession, change_dir: str, store_dir: str) -> DataFrame:
    """``file, lo, hi``, the time range of each file of the feed, kept as a table beside the store.

    Files that the table does not hold yet are read once, their ``ts`` column only.
    """
    path = f"{store_dir}/_feed"
    ranges = "file string, lo timestamp, hi timestamp"
    known = spark.read.schema(ranges).parquet(path) if commitlog.children(spark, path) else spark.createDataFrame([], ranges)
    seen = {r.file for r in known.select("file").distinct().collect()}         # names, as the stream itself keeps them
    fresh = [f for f in spark.read.schema(CHANGE_SCHEMA).parquet(change_dir).inputFiles() if f not in seen]
    if fresh:
        new = spark.read.schema(CHANGE_SCHEMA).parquet(*fresh).select("ts", F.col("_metadata.file_path").alias("path"))
        found = new.groupBy("path").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        listed = spark.createDataFrame([(f, _plain(f)) for f in fresh], "file string, path string")
        found = listed.join(found.withColumn("path", _plain_column("path")), "path", "left").select("file", "lo", "hi")   # a file without rows too
        found.coalesce(1).write.mode("append").parquet(path)
        return spark.read.schema(ranges).parquet(path)
    return known


def _plain(uri: str) -> str:
    """A path without scheme slashes, so that ``file:/x`` and ``file:///x`` agree."""
    return re.sub(r"^([a-z][a-z0-9+.-]*:)/{2,}", r"\1/", uri)


def _plain_column(name: str):
    return F.regexp_replace(F.col(name), r"^([a-z][a-z0-9+.-]*:)/{2,}", "$1/")


def feed_between(spark: SparkSession, change_dir: str, store_dir: str, lo, hi) -> DataFrame:
    """The changes of the feed from ``lo`` to ``hi``; only files whose time range overlaps are opened."""
    ranges = feed_ranges(spark, change_dir, store_dir)
    files = [r.file for r in ranges.filter((F.col("lo") <= F.lit(hi)) & (F.col("hi") >= F.lit(lo))).select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], CHANGE_SCHEMA)
    return spark.read.schema(CHANGE_SCHEMA).parquet(*files).filter((F.col("ts") >= F.lit(lo)) & (F.col("ts") <= F.lit(hi)))


def follow_changes(spark: SparkSession, change_dir: str, store_dir: str, checkpoint_dir: str,
                   gap: str = "2 seconds", watermark: str = "10 seconds", trigger_once: bool = False,
                   embedder=None, dim: int = 64):
    """Follow a change feed and keep an index store up to date, after an initial ``build_index`` or from nothing.

    Each micro-batch (``foreachBatch``) takes the sessions the watermark has
    closed, gathers their changes from the files of the feed that overlap them, and commits the
    delta (``flush_store``) under the next version of the store. The query's id and the batch id are
    recorded in the commit, so a batch replayed after a failure is found in the log and not applied again.
    """
    stream = read_change_stream(spark, change_dir)
    closed = sessions(watch_filter(stream), gap, watermark)
    gap_seconds = _seconds(gap)

    def apply(batch: DataFrame, batch_id: int):
        query = spark.read.schema("id string").json(f"{checkpoint_dir}/metadata").first().id     # the stream's id, kept over restarts
        if commitlog.version_of(commitlog.commits(spark, store_dir), query, batch_id) is not None:
            return
        bounds = cut_lineage(batch.select("repo_id", "session_start", "last_ts"))
        lo, hi = bounds.agg(F.min("session_start"), F.max("last_ts")).first()
        if lo is None:
            return
        raw = watch_filter(feed_between(spark, change_dir, store_dir, lo, hi))
        hits = cut_lineage(assign_sessions(raw, bounds, gap_seconds))
        flush_store(spark, store_dir, hits, query, batch_id, embedder=embedder, dim=dim)

    q = (closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint_dir)
         .foreachBatch(apply))
    if trigger_once:
        q = q.trigger(availableNow=True)
    return q.start()


def _seconds(interval: str) -> float:
    n, unit = interval.split()
    scale = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
             "millisecond": 1e-3, "milliseconds": 1e-3}[unit]
    return float(n) * scale
