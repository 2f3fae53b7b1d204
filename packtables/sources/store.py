"""Index storage and request/commit sources.

A store folder holds commits (``sources.commitlog``): ``<table>/commit=<id>/part=r_<repo_id>``, and for each commit the
repositories it covers. A *full* commit holds all rows of its repositories: a covered repository without rows is
empty from there on (Q11), the others stay as they were. A *delta* holds the rows of changed files only, and the keys that it
touched: rows of older commits under a touched key are no longer read (merge on read), so a deleted file is a touched
key without rows. Readers take each repository from its newest full commit and the deltas after it; ``compact`` makes full
commits of repositories whose deltas have grown, ``vacuum`` removes data that no kept version reads.

Stored vectors are reused by ``(repo_id, content_hash)``, so only new or
changed chunk text is embedded (Q10: the reference reuses any non-empty
store regardless of repository or staleness).
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from packtables.operators.joins import null_safe_join
from packtables.operators.vectors import embed_checked, embed_column
from packtables.sources import commitlog
from packtables.sources.commitlog import Commit

#: Column that holds a row's key in tables other than those keyed by ``path``: an edge belongs to the file it leaves.
KEYS = {"edges": "src"}
COVERS = "repo_id string, full boolean, n_keys long"
TOUCHED = "repo_id string, key string, kind string"
ORPHAN_HOURS = 24.0


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest finished commit."""
    log = commitlog.commits(spark, path)
    return log[-1].version if log else None


def _key_of(table: str, columns: list[str]) -> str | None:
    return next((c for c in (KEYS.get(table, "path"),) if c in columns), None)


def _write_tables(tables: dict[str, DataFrame], path: str, commit: str) -> dict[str, str]:
    part = F.coalesce(F.concat(F.lit("r_"), "repo_id"), F.lit("none"))
    for name, df in tables.items():
        # one task writes a repository's rows unless there are many of them (AQE splits large partitions)
        df.withColumn("part", part).hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/{name}/commit={commit}")
    return {name: df.schema.json() for name, df in tables.items()}


def _overlaps(spark: SparkSession, path: str, commit: str):
    """Whether any of some commits covers a repository that ``commit`` covers."""
    def asked(others: list[Commit]) -> bool:
        mine = spark.read.schema(COVERS).parquet(f"{path}/_covers/commit={commit}")
        theirs = spark.read.schema(COVERS).parquet(*[f"{path}/_covers/commit={c.commit}" for c in others])
        return not null_safe_join(mine, theirs.select("repo_id").distinct(), ["repo_id"], "left_semi").isEmpty()

    return asked


def write_index(tables: dict[str, DataFrame], path: str, repos: DataFrame | None = None, query: str | None = None,
                batch: int | None = None, base: int | None = None) -> int:
    """Commit ``tables`` as all rows of ``repos`` (``repo_id``; default: those of the tables); returns the version.

    A covered repository without rows is empty from this version on; the others stay as they were. With ``base`` (the version
    that the tables were computed from) a later commit on the same repositories is a ``Conflict``.
    """
    spark = next(iter(tables.values())).sparkSession
    done = commitlog.version_of(commitlog.commits(spark, path), query, batch)
    if done is not None:
        return done
    commit = uuid.uuid4().hex
    schemas = _write_tables(tables, path, commit)
    stored = [spark.read.schema(df.schema).parquet(f"{path}/{name}/commit={commit}") for name, df in tables.items()]
    covered = repos.select("repo_id") if repos is not None else None
    if covered is None:
        for df in stored:
            covered = df.select("repo_id") if covered is None else covered.union(df.select("repo_id"))
    counts = stored[0].groupBy("repo_id").agg(F.count("*").alias("n_keys"))
    rows = null_safe_join(covered.distinct(), counts, ["repo_id"], "left")
    rows.select("repo_id", F.lit(True).alias("full"), F.coalesce("n_keys", F.lit(0)).alias("n_keys")) \
        .write.parquet(f"{path}/_covers/commit={commit}")
    return commitlog.publish(spark, path, commit, schemas, query, batch, base, _overlaps(spark, path, commit))


def write_delta(tables: dict[str, DataFrame], touched: DataFrame, path: str, query: str | None = None, batch: int | None = None,
                base: int | None = None) -> int:
    """Commit the new rows of the ``touched(repo_id, key, kind)`` keys; returns the version.

    ``kind`` is the key column (``path``, or ``src`` for edges). A touched key without new rows is deleted. What is written
    follows the change, not the size of its repositories.
    """
    spark = touched.sparkSession
    done = commitlog.version_of(commitlog.commits(spark, path), query, batch)
    if done is not None:
        return done
    commit = uuid.uuid4().hex
    schemas = {**_write_tables(tables, path, commit), "_touched": ""}
    part = F.coalesce(F.concat(F.lit("r_"), "repo_id"), F.lit("none"))
    touched.select("repo_id", "key", "kind").distinct().withColumn("part", part).hint("rebalance", "part") \
        .write.partitionBy("part").parquet(f"{path}/_touched/commit={commit}")
    keys = spark.read.schema(TOUCHED).parquet(f"{path}/_touched/commit={commit}")
    keys.groupBy("repo_id").agg(F.lit(False).alias("full"), F.count_if(F.col("kind") == "path").alias("n_keys")) \
        .write.parquet(f"{path}/_covers/commit={commit}")
    return commitlog.publish(spark, path, commit, schemas, query, batch, base, _overlaps(spark, path, commit))


def _read(spark: SparkSession, path: str, table: str, log: list[Commit], schema: StructType, numbers: DataFrame) -> DataFrame:
    """Rows of ``table`` in the commits of ``log`` with their version ``_v``."""
    full = StructType([*schema.fields, StructField("commit", StringType()), StructField("part", StringType())])
    rows = spark.read.schema(full).option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/commit={c.commit}" for c in log])
    return rows.join(F.broadcast(numbers), "commit").drop("commit")      # one row for each commit of the log


def covers(spark: SparkSession, path: str, log: list[Commit]) -> DataFrame:
    """``repo_id, full, n_keys, _v`` of each commit."""
    numbers = spark.createDataFrame([(c.commit, c.version) for c in log], "commit string, _v long")
    return _read(spark, path, "_covers", log, StructType.fromDDL(COVERS), numbers).drop("part")


def read_index(spark: SparkSession, path: str, repos: list[str] | None = None, version: int | None = None) -> dict[str, DataFrame]:
    """The stored tables as of ``version`` (default: the newest); ``repos`` prunes partitions."""
    log = commitlog.commits(spark, path, version)
    if not log:
        return {}
    numbers = spark.createDataFrame([(c.commit, c.version) for c in log], "commit string, _v long")
    cov = covers(spark, path, log)
    since = cov.filter("full").groupBy("repo_id").agg(F.max("_v").alias("_since"))
    deltas = [c for c in log if "_touched" in c.tables]
    wanted = F.col("part").isin(*[f"r_{r}" for r in repos]) if repos else F.lit(True)
    touched = None
    if deltas:
        touched = _read(spark, path, "_touched", deltas, StructType.fromDDL(TOUCHED), numbers).filter(wanted)
        touched = touched.groupBy("repo_id", "key", "kind").agg(F.max("_v").alias("_touched"))
    out = {}
    for name in dict.fromkeys(t for c in log for t in c.tables if t != "_touched"):
        own = [c for c in log if name in c.tables]
        schema = StructType.fromJson(json.loads(own[-1].tables[name]))
        rows = _read(spark, path, name, own, schema, numbers).filter(wanted)
        rows = null_safe_join(rows, since, ["repo_id"], "left").filter(F.col("_v") >= F.coalesce("_since", F.lit(0)))
        key = _key_of(name, schema.names)
        if touched is not None and key:
            t = touched.filter(F.col("kind") == KEYS.get(name, "path")).select("repo_id", F.col("key").alias(key), "_touched")
            rows = null_safe_join(rows, t, ["repo_id", key], "left").filter(F.col("_v") >= F.coalesce("_touched", F.lit(0)))
        out[name] = rows.select(*schema.names)
    return out


def compact(spark: SparkSession, path: str, ratio: float = 0.5) -> int | None:
    """Full commits for the repositories whose deltas touched more than ``ratio`` of their files; None if there is none."""
    log = commitlog.commits(spark, path)
    if not log:
        return None
    cov = covers(spark, path, log)
    since = cov.filter("full").groupBy("repo_id").agg(F.max("_v").alias("_since"), F.max_by("n_keys", "_v").alias("held"))
    later = null_safe_join(cov.filter("not full"), since, ["repo_id"], "left").filter(F.col("_v") > F.coalesce("_since", F.lit(0)))
    grown = later.groupBy("repo_id").agg(F.sum("n_keys").alias("n"), F.coalesce(F.max("held"), F.lit(0)).alias("held"))
    repos = grown.filter(F.col("n") > ratio * F.col("held")).select("repo_id")
    if repos.isEmpty():
        return None
    now = read_index(spark, path, version=log[-1].version)
    return write_index({t: null_safe_join(df, repos, ["repo_id"], "left_semi") for t, df in now.items()}, path, repos=repos,
                       base=log[-1].version)


def vacuum(spark: SparkSession, path: str, keep: int = 10, orphan_hours: float = ORPHAN_HOURS) -> list[str]:
    """Remove what the newest ``keep`` versions do not read, and data of commits that never finished; returns the commit ids.

    Commits of which a later full commit covers every repository go, but for the last one of each streaming query, by
    which its replays are known. Unfinished data goes once it is ``orphan_hours`` old.
    """
    log = commitlog.commits(spark, path)
    gone = []
    if len(log) > keep:
        oldest = log[-keep]
        cov = covers(spark, path, log)
        since = cov.filter(F.col("full") & (F.col("_v") <= oldest.version)).groupBy("repo_id").agg(F.max("_v").alias("_since"))
        read = null_safe_join(cov, since, ["repo_id"], "left").filter(F.col("_v") >= F.coalesce("_since", F.lit(0)))
        live = {r._v for r in read.select("_v").distinct().collect()}       # commits, not repositories
        last = {c.query: c.version for c in log if c.query is not None}
        for c in log:
            if c.version < oldest.version and c.version not in live and c.version not in last.values():
                commitlog.remove(spark, f"{path}/_log/{c.version:020d}.json")
                gone.append(c.commit)
    known = {c.commit for c in commitlog.commits(spark, path)} | set(gone)
    before = (time.time() - orphan_hours * 3600) * 1000
    folders = [t for t, _ in commitlog.children(spark, path) if t != "_log"]
    for t in folders:
        for name, changed in commitlog.children(spark, f"{path}/{t}"):
            commit = name.removeprefix("commit=")
            if commit in gone or (name.startswith("commit=") and commit not in known and changed <= before):
                commitlog.remove(spark, f"{path}/{t}/{name}")
                gone.append(commit)
    return list(dict.fromkeys(gone))


def reuse_or_embed(chunks: DataFrame, stored: DataFrame, text_col: str = "text", embedder=None,
                   dim: int = 64, checked: bool = False) -> DataFrame:
    """Attach vectors, reusing stored ones by (repo_id, md5(text)).

    ``checked`` keeps the rows whose batch the embedder failed on, without a vector and with ``embedding_error``.

    ``stored(repo_id, content_hash, embedding)``. Returns the chunks with
    ``embedding`` and ``reused``. Only the anti-joined remainder goes through
    the embedder (U1).
    """
    c = chunks.withColumn("content_hash", F.md5(F.col(text_col)))
    s = stored.select("repo_id", "content_hash", "embedding").dropDuplicates(["repo_id", "content_hash"])
    hit = null_safe_join(c, s, ["repo_id", "content_hash"]).withColumn("reused", F.lit(True))
    miss = null_safe_join(c, s.select("repo_id", "content_hash"), ["repo_id", "content_hash"], "left_anti")
    new = (embed_checked if checked else embed_column)(miss, text_col, "embedding", embedder=embedder, dim=dim).withColumn("reused", F.lit(False))
    return hit.unionByName(new, allowMissingColumns=True)


REQUEST_JSON_SCHEMA = "request_id long, ts timestamp, body string"


def read_requests_json(spark: SparkSession, path: str) -> DataFrame:
    """S3: chat request bodies (one JSON document per line: request_id, ts, body).

    ``content`` of a message is a string or a list of parts; both are read
    through VARIANT: ``messages array<struct<role, content, parts>>`` with
    ``parts`` holding only what the list form carries.
    """
    raw = spark.read.schema(REQUEST_JSON_SCHEMA).json(path)
    return requests_from_bodies(raw)


def requests_from_bodies(raw: DataFrame, body_col: str = "body") -> DataFrame:
    """Requests with ``messages``; a body that is no JSON gives null messages (listed by ``body_errors``)."""
    v = F.try_parse_json(F.col(body_col))
    msgs = F.try_variant_get(v, "$.messages", "array<variant>")
    parts_t = "array<struct<type:string,text:string>>"
    as_struct = F.transform(msgs, lambda m: F.struct(
        F.try_variant_get(m, "$.role", "string").alias("role"),
        F.when(F.schema_of_variant(F.variant_get(m, "$.content", "variant")) == "STRING",
               F.try_variant_get(m, "$.content", "string")).alias("content"),
        F.try_variant_get(m, "$.content", parts_t).alias("parts")))
    return raw.withColumn("messages", as_struct).drop(body_col)


def body_errors(raw: DataFrame, body_col: str = "body") -> DataFrame:
    """S3: one row per request whose body cannot be read: ``request_id, error``."""
    bad = raw.filter(F.col(body_col).isNull() | F.try_parse_json(F.col(body_col)).isNull())
    return bad.select("request_id", F.when(F.col(body_col).isNull(), "no body").otherwise("malformed JSON").alias("error"))


def read_commits(spark: SparkSession, commits_path: str, files_path: str, fmt: str = "parquet"):
    """Commit history export: ``commits(repo_id, hash, message, author, committed_at)``
    and ``commit_files(repo_id, hash, path)``."""
    c = spark.read.format(fmt).load(commits_path).select("repo_id", "hash", "message", "author", "committed_at")
    f = spark.read.format(fmt).load(files_path).select("repo_id", "hash", "path")
    return c, f


def write_packs(packs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Pack sink (XML column plus counts), JSON or Parquet."""
    packs.write.mode("overwrite").format(fmt).save(path)
