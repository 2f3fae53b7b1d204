"""Commit history.

``commits(repo_id, hash, message, author, committed_at)`` and
``commit_files(repo_id, hash, path)`` are plain input tables (a git export);
the library does not read git object stores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packtables.functions.text import relative_age, short_hash, short_message


def of_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows whose ``(repo_id, path)`` is one of ``paths``, which are sent to them while they are few."""
    from packtables.operators.joins import sent

    return rows.join(sent(paths.select("repo_id", "path").distinct()), ["repo_id", "path"], "left_semi")


def recent_commits(commits: DataFrame, commit_files: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` latest commits per ``(repo_id, path)``.

    Ties on time break on hash. ``row_number() <= n`` plans as a partial
    WindowGroupLimit before the shuffle, so a file touched by a third of all
    commits still sends at most ``n`` rows per map task.
    """
    j = commit_files.select("repo_id", "hash", "path").join(
        commits.select("repo_id", "hash", "message", "author", "committed_at"), ["repo_id", "hash"])
    w = Window.partitionBy("repo_id", "path").orderBy(F.col("committed_at").desc(), F.col("hash").asc())
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def commit_summary(recent: DataFrame, as_of: Column) -> DataFrame:
    """P13 + P14: short hash, first message line, author and relative age."""
    return recent.select(
        "repo_id", "path", "rank", "committed_at",
        short_hash("hash").alias("hash"), short_message("message").alias("message"), "author",
        relative_age("committed_at", as_of).alias("date"))
