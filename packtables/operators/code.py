"""Code-structure extraction (X1-X3, X7, X8, P8, A5) into one tagged table; imports (X4-X6) are in imports.py.

``files`` -> rows tagged ``symbol | call | error``: JavaScript, TypeScript and Go by column functions and windows
(``braces.py``), Python files by the standard parser in ``mapInPandas`` (``scanners.py``), any language by a function of the
user's. Callers persist the tagged table once (``index.build_index`` writes it) and split it by tag.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packtables.operators.braces import extract_braced
from packtables.operators.joins import null_safe_join
from packtables.operators.scanners import BRACED, EXT_LANG, SCANNERS

EXTRACT_SCHEMA = (
    "repo_id string, path string, tag string, name string, kind string, start_line int, end_line int, "
    "col int, body string, signature string, line int, error string")

_FIELDS = ["name", "kind", "start_line", "end_line", "col", "body", "signature", "line"]


def language_of(path, languages=("typescript", "python", "javascript", "go")) -> Column:
    """Language from the extension; ``.tsx`` is on when typescript is; unknown -> null."""
    p = F.col(path) if isinstance(path, str) else path
    ext = F.regexp_extract(p, r"(\.[^./]+)$", 1)
    expr = None
    for e, lang in EXT_LANG.items():
        enabled = lang in languages or (lang == "tsx" and "typescript" in languages)
        if not enabled:
            continue
        cond = ext == e
        expr = F.when(cond, F.lit(lang)) if expr is None else expr.when(cond, F.lit(lang))
    return expr if expr is not None else F.lit(None).cast("string")


FILES_AT_ONCE = 256       # files whose rows are held in one frame


def _extract_batches(batches: Iterator[pd.DataFrame], scanners: dict = SCANNERS) -> Iterator[pd.DataFrame]:
    for pdf in (b.iloc[i:i + FILES_AT_ONCE] for b in batches for i in range(0, len(b), FILES_AT_ONCE)):
        rows = []
        for repo_id, path, lang, content in zip(pdf["repo_id"], pdf["path"], pdf["lang"], pdf["content"]):
            scanner = scanners.get(lang)
            if scanner is None:
                continue
            try:
                found = scanner(content or "")
            except Exception as e:      # R8: a bad file becomes an error row
                rows.append(dict(repo_id=repo_id, path=path, tag="error", error=f"{type(e).__name__}: {e}"))
                continue
            for r in found:
                r = dict(r)
                r["repo_id"] = repo_id
                r["path"] = path
                rows.append(r)
        if not rows:
            continue
        out = pd.DataFrame(rows)
        for c in _FIELDS + ["error"]:
            if c not in out.columns:
                out[c] = None
        for c in ("start_line", "end_line", "col", "line"):
            out[c] = out[c].astype("Int32")
        for c in ("name", "kind", "body", "signature", "error"):
            out[c] = out[c].astype(object).where(out[c].notna(), None)
        yield out[["repo_id", "path", "tag"] + _FIELDS + ["error"]]


def extract(files: DataFrame, num_partitions: int | None = None, scanners: dict | None = None) -> DataFrame:
    """Tagged extraction rows for every file with a known language.

    Python files are parsed where they lie, others dealt out by file once: a files table read from Parquet is split
    by bytes already, and shuffling all contents only to balance the Python
    work would cost more than the parsing at scale. ``num_partitions`` asks for
    a hash partitioning by (repo_id, path) first, for an input in few partitions.
    ``scanners`` (U2: language -> function of a text) replaces or adds scanners.
    """
    src = files.select("repo_id", "path", "lang", "content").filter(F.col("lang").isNotNull())
    known = {**SCANNERS, **(scanners or {})}
    parsed = src.filter(F.col("lang").isin(*known))
    if num_partitions:
        parsed = parsed.repartition(num_partitions, "repo_id", "path")
    out = parsed.mapInPandas(lambda batches: _extract_batches(batches, known), schema=EXTRACT_SCHEMA)
    present = {r.lang: r.n or 0 for r in src.groupBy("lang").agg(F.sum(F.octet_length("content")).alias("n")).collect()}         # a few names
    own = {rules: [x for x in langs if x in present and x not in known] for rules, langs in BRACED.items()}
    braced = {rules: src.filter(F.col("lang").isin(*langs)) for rules, langs in own.items() if langs}
    sizes = {rules: sum(present[x] for x in langs) for rules, langs in own.items()}
    return out.unionByName(extract_braced(braced, sizes).select(*out.columns)) if braced else out


def symbols_of(tagged: DataFrame) -> DataFrame:
    """``symbols(repo_id, path, name, kind, start_line, end_line, col, body, signature)``."""
    return (tagged.filter(F.col("tag") == "symbol")
            .select("repo_id", "path", "name", "kind", "start_line", "end_line", "col",
                    F.coalesce("body", F.lit("")).alias("body"), F.coalesce("signature", F.lit("")).alias("signature")))


def calls_of(tagged: DataFrame) -> DataFrame:
    """``calls(repo_id, path, symbol_name, line, col)``."""
    return (tagged.filter(F.col("tag") == "call")
            .select("repo_id", "path", F.col("name").alias("symbol_name"), "line", "col"))


def errors_of(tagged: DataFrame) -> DataFrame:
    """Files a scanner could not read."""
    return tagged.filter(F.col("tag") == "error").select("repo_id", "path", "error")


def replace_files(old: DataFrame, new_rows: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """Drop every row of the changed files, then add their new rows.

    ``changed_paths(repo_id, path)`` lists touched files (deleted ones included); a null ``repo_id`` is a repository.
    """
    keep = null_safe_join(old, changed_paths.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")
    return keep.unionByName(new_rows, allowMissingColumns=True)


def definitions_by_name(symbols: DataFrame) -> DataFrame:
    """A5: per (repo_id, name): how many definitions, and the first in file order.

    The reference keeps a list per name; a name such as ``run`` can be defined
    in a large share of all files, so the list itself is not gathered into one
    row here: ``definitions`` returns it as ordered rows. These aggregates are
    partial (map-side) and skew-safe.
    """
    first = F.min(F.struct("path", "start_line", "col"))
    return (symbols.groupBy("repo_id", "name")
            .agg(F.count(F.lit(1)).alias("n_definitions"), first.alias("first"))
            .select("repo_id", "name", "n_definitions", F.col("first.path").alias("first_path"),
                    F.col("first.start_line").alias("first_line")))


def definitions(symbols: DataFrame) -> DataFrame:
    """A5: the definitions of each (repo_id, name) as rows, numbered in file order from 1.

    The numbering is a running count that spreads a name with many definitions over tasks.
    """
    from packtables.operators.scan import running_sum

    s = symbols.select("repo_id", "name", "path", "start_line", "col", "kind")
    return running_sum(s, ["repo_id", "name"], ["path", "start_line", "col", "kind"], F.lit(1), "rank")
