"""Source-file scans and path filters.

S1 lists paths itself instead of using the ``binaryFile`` source, which skips
names starting with ``_`` or ``.`` (``__init__.py``, ``_app.tsx``). Roots are
a table of folders on a file system that all executors share; they are listed
level by level, the path table is filtered (extension, then exclude patterns)
before any content is read, repartitioned, and read in a second ``mapInPandas``
with bad bytes replaced.
"""

from __future__ import annotations

import fnmatch
import os
import time
from typing import Iterator, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packtables.operators.code import language_of
from packtables.options import PackOptions
from packtables.session import cut_lineage

# Extensions indexed, and the watcher's noise lists.
INDEXABLE_EXTS = (".ts", ".tsx", ".js", ".jsx", ".py", ".go")
WATCH_IGNORE_DIRS = (".next", "node_modules", ".git", "dist", "build", "__pycache__", ".vscode", "coverage")
WATCH_IGNORE_SUFFIXES = (".log", ".tmp", ".cache")


def glob_regex(patterns) -> str:
    """One anchored regex equal to fnmatch on any of ``patterns``."""
    parts = []
    for p in patterns:
        rx = fnmatch.translate(p)          # '(?s:...)\\Z'
        body = rx[len("(?s:"):-len(")\\Z")] if rx.startswith("(?s:") and rx.endswith(")\\Z") else rx
        parts.append(body)
    return "(?s)^(?:" + "|".join(parts) + ")$"


def excluded(rel_path, patterns) -> Column:
    """Any path component, or the whole relative path, matches a pattern."""
    rx = glob_regex(patterns)
    rel = F.col(rel_path) if isinstance(rel_path, str) else rel_path
    return F.exists(F.split(rel, "/"), lambda part: part.rlike(rx)) | rel.rlike(rx)


def _suffix(path) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    return F.regexp_extract(name, r"^.*[^.](\.[^.]*)$", 1)


def watched(path) -> Column:
    """Whether a changed path is indexable and in no noise folder."""
    p = F.col(path) if isinstance(path, str) else path
    suf = _suffix(p)
    return (~suf.isin(*WATCH_IGNORE_SUFFIXES) & suf.isin(*INDEXABLE_EXTS)
            & ~F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(d) for d in WATCH_IGNORE_DIRS])))


READ_AT_ONCE = 64          # files whose contents are held in one frame


RETRIES, WAIT = 3, 0.2     # attempts at a folder or file that cannot be read, and seconds before the next one


def _tried(read, *args):
    """``read(*args)``, again after a pause if the file system fails; what went away is None, what stays unreadable its error."""
    for turn in range(RETRIES):
        try:
            return read(*args), None
        except FileNotFoundError:
            return None, None
        except OSError as e:
            error = f"{type(e).__name__}: {e}"
            if isinstance(e, (NotADirectoryError, PermissionError)):
                break
        time.sleep(WAIT * 2 ** turn)
    return None, error


def _entries(root: str, folder: str) -> list[tuple[str, bool]]:
    with os.scandir(os.path.join(root, folder)) as entries:
        own = [(f"{folder}/{e.name}" if folder else e.name, e) for e in entries]
        return [(rel, e.is_dir(follow_symlinks=False)) for rel, e in own if e.is_dir(follow_symlinks=False) or e.is_file()]


def _text(root: str, path: str) -> str:
    with open(os.path.join(root, path), "rb") as fh:
        return fh.read().decode("utf-8", errors="replace")


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The direct entries of each folder: files, folders to list next, and a row with an error for one that cannot be listed."""
    for pdf in batches:
        for repo_id, root, folder in zip(pdf["repo_id"], pdf["root"], pdf["path"]):
            found, error = _tried(_entries, root, folder)
            out = [(repo_id, root, rel, is_dir, None) for rel, is_dir in found or []]
            if error:
                out.append((repo_id, root, folder, False, error))
            yield pd.DataFrame(out, columns=["repo_id", "root", "path", "is_dir", "error"]).astype({"is_dir": bool, "error": object})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in (b.iloc[i:i + READ_AT_ONCE] for b in batches for i in range(0, len(b), READ_AT_ONCE)):
        got = [_tried(_text, root, path) for root, path in zip(pdf["root"], pdf["path"])]
        pdf = pdf.assign(content=pd.Series([g[0] for g in got], index=pdf.index, dtype=object),
                         error=pd.Series([g[1] for g in got], index=pdf.index, dtype=object))
        yield pdf[pdf["content"].notna() | pdf["error"].notna()]


class Scan(NamedTuple):
    """``files(repo_id, path, ext, lang, content)``; ``errors(repo_id, path, error)``: folders and files that could not be read; ``unlisted``: the folders."""
    files: DataFrame
    errors: DataFrame
    unlisted: DataFrame


def list_directories(roots: DataFrame, num_partitions: int) -> tuple[DataFrame, DataFrame]:
    """``repo_id, root, path`` of all files below the roots, and of the folders that cannot be listed with the ``error``.

    Level by level: the folders of a level are spread over tasks, so one large root is not one task.
    """
    kind = "repo_id string, root string, path string"
    level = roots.select("repo_id", "root", F.lit("").alias("path"))
    found = None
    while found is None or not level.isEmpty():
        own = cut_lineage(level.repartition(num_partitions, "repo_id", "root", "path").mapInPandas(_list, f"{kind}, is_dir boolean, error string"))
        found = own if found is None else found.union(own)
        level = own.filter("is_dir").select("repo_id", "root", "path")
    return (found.filter("not is_dir and error is null").select("repo_id", "root", "path"),
            found.filter("error is not null").select("repo_id", "root", "path", "error"))


def scan(spark: SparkSession, roots: list[tuple[str, str]] | DataFrame, opts: PackOptions = PackOptions(),
         num_partitions: int | None = None) -> Scan:
    """The files below folders on a shared file system, and a row for each folder or file that cannot be read.

    A folder or file that went away between listing and reading is no error; anything else is tried ``RETRIES`` times.
    """
    if not isinstance(roots, DataFrame):
        roots = spark.createDataFrame(list(roots), "repo_id string, root string")
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed, unlisted = list_directories(roots, n)
    ext = _suffix("path")
    keep = listed.filter(ext.isin(*INDEXABLE_EXTS) & ~excluded("path", opts.exclude))
    read = (keep.repartition(n, "repo_id", "path")
            .mapInPandas(_read, "repo_id string, root string, path string, content string, error string"))
    files = read.filter("error is null").select("repo_id", "path", _suffix("path").alias("ext"),
                                                language_of("path", opts.languages).alias("lang"), "content")
    unlisted = unlisted.select("repo_id", "path", "error")
    return Scan(files, unlisted.unionByName(read.filter("error is not null").select("repo_id", "path", "error")), unlisted)


def scan_directories(spark: SparkSession, roots: list[tuple[str, str]] | DataFrame,
                     opts: PackOptions = PackOptions(), num_partitions: int | None = None) -> DataFrame:
    """The files of ``scan``; unreadable files are left out, a folder that cannot be listed is an ``OSError``
    (its files would be missing from the index without a word)."""
    found = scan(spark, roots, opts, num_partitions)
    bad = found.unlisted.limit(3).collect()
    if bad:
        raise OSError("; ".join(f"{r.repo_id}: {r.path or '.'}: {r.error}" for r in bad))
    return found.files
