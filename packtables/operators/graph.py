"""File dependency graph.

Import resolution is a keyed join: every import expands into a short,
fixed list of candidate keys with a priority, the candidates are equi-joined
with a lookup table, and the best priority wins per import. Traversals are
iterative joins with a per-hop anti-join on what is already reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packtables.operators.joins import null_safe_join
from packtables.session import cut_lineage

# Extension lists tried by the resolution ladder, in order.
RELATIVE_EXTS = ("", ".ts", ".tsx", ".js", ".jsx", ".py", ".go")
DOTTED_EXTS = ("", ".py", ".ts", ".js", ".go")


def strip_suffix(path) -> Column:
    """Path without the last suffix of its final component (``Path.with_suffix('')``)."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(p, r"(?<=[^/])\.[^./]+$", "")


def path_keys(files: DataFrame) -> DataFrame:
    """``(repo_id, key, path)``; rel-without-extension, rel, stem, dotted.

    Files are walked in path order and a later file overwrites a key, so the
    winner of a key is its largest path. ``max`` is a partial aggregate: a key
    shared by many files does not gather them in one task.
    """
    no_ext = strip_suffix("path")
    stem = F.regexp_extract(no_ext, r"([^/]*)$", 1)
    dotted = F.translate(no_ext, "/\\", "..")
    keys = F.array_distinct(F.array(no_ext, F.col("path"), stem, dotted))
    return (files.select("repo_id", "path", F.explode(keys).alias("key"))
            .groupBy("repo_id", "key").agg(F.max("path").alias("path")))


def normalize_path(path) -> Column:
    """Resolve ``.`` and ``..`` parts; escaping the root leaves a ``..`` part (never matches)."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    norm = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."),
              F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))))
    return F.array_join(norm, "/")


def _candidates() -> Column:
    """``prio, ns, key, ext`` of what a source may mean; with ``ext`` its extensions count too, which the lookup table has taken off."""
    s = F.col("source")
    rel = normalize_path(F.concat_ws("/", F.col("folder"), s))
    slashed = F.translate(s, ".", "/")
    one = lambda prio, ns, key, ext: F.struct(F.lit(prio).alias("prio"), F.lit(ns).alias("ns"), key.alias("key"), F.lit(ext).alias("ext"))
    c = [one(0, "k", s, False), one(1, "p", F.when(s.startswith("."), rel), True), one(10, "k", slashed, True),
         one(20, "k", F.element_at(F.split(slashed, "/"), -1), False)]
    return F.filter(F.array(*c), lambda x: x["key"].isNotNull())


def _with_stems(look: DataFrame) -> DataFrame:
    """``look`` with ``step`` 0, and a row for each key that ends with an extension of its ladder: without it, at that rung."""
    rungs = F.array(F.struct(F.col("key").alias("key"), F.lit(0).alias("step")), *[
        F.when((F.col("ns") == ns) & F.col("key").endswith(e), F.struct(F.left("key", F.length("key") - len(e)).alias("key"), F.lit(i).alias("step")))
        for ns, exts in (("p", RELATIVE_EXTS), ("k", DOTTED_EXTS)) for i, e in enumerate(exts) if e])
    rows = look.withColumn("_r", F.explode(F.filter(rungs, lambda x: x.isNotNull())))
    return rows.select("repo_id", "ns", F.col("_r.key").alias("key"), F.col("_r.step").alias("step"), "path")


def lookup_table(files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Keys (namespace ``k``) plus exact paths (namespace ``p``) for the ladder."""
    keys = keys if keys is not None else path_keys(files)
    return (keys.select("repo_id", F.lit("k").alias("ns"), "key", "path")
            .unionByName(files.select("repo_id", F.lit("p").alias("ns"), F.col("path").alias("key"), "path")))


def resolve_imports(imports: DataFrame, files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``(repo_id, path, source, line, col, target)``; unresolved imports are dropped.

    Ladder: exact key; relative path plus each extension; dotted-to-slashes
    plus each extension; last component as a stem. Self-imports are dropped.
    """
    look = lookup_table(files, keys)
    # a source is resolved once per repository (a relative one: once per folder), however many files import it
    folder = F.when(F.col("source").startswith("."), F.regexp_extract(F.col("path"), r"^(.*)/[^/]*$", 1)).otherwise("")
    named = imports.select("repo_id", "path", "source", "line", "col", folder.alias("folder"))
    cand = named.select("repo_id", "source", "folder").distinct()
    cand = cand.select("repo_id", "source", "folder", F.explode(_candidates()).alias("c"))
    cand = cand.select("repo_id", "source", "folder", "c.*")
    # the ladder's extensions are taken off the keys, once a file, not put on each source
    hit = null_safe_join(cand, _with_stems(look).withColumnRenamed("path", "target"), ["repo_id", "ns", "key"])
    hit = hit.filter(F.col("ext") | (F.col("step") == 0))
    best = hit.groupBy("repo_id", "source", "folder").agg(F.min_by("target", F.col("prio") + F.col("step")).alias("target"))
    out = null_safe_join(named, best, ["repo_id", "source", "folder"]).select("repo_id", "path", "source", "line", "col", "target")
    return out.filter(F.col("target") != F.col("path")).distinct()


def build_edges(imports: DataFrame, files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """G1: distinct ``(repo_id, src, dst, line, col)``; A imports B gives A -> B.

    ``line``/``col`` is the first import that made the edge (successor order).
    """
    r = resolve_imports(imports, files, keys)
    first = F.min(F.struct("line", "col"))
    return (r.groupBy("repo_id", F.col("path").alias("src"), F.col("target").alias("dst")).agg(first.alias("_f"))
            .select("repo_id", "src", "dst", F.col("_f.line").alias("line"), F.col("_f.col").alias("col")))


def dependencies(seeds: DataFrame, edges: DataFrame, seed_col: str = "path") -> DataFrame:
    """Files each seed imports directly. ``seeds`` has repo_id and ``seed_col``."""
    return (seeds.join(edges.withColumnRenamed("src", seed_col), ["repo_id", seed_col])
            .withColumnRenamed("dst", "dependency"))


def dependents(seeds: DataFrame, edges: DataFrame, max_hops: int = 2, key_cols: tuple[str, ...] = (),
               seed_col: str = "path", checkpoint_every: int = 1) -> DataFrame:
    """Files that import each seed within ``max_hops`` (seed excluded).

    Returns ``(*key_cols, repo_id, seed, dependent, hops)`` with the smallest
    hop count. Each hop joins the frontier with the edges on ``dst``, keeps
    new nodes only (anti-join on what is reached), and unions them in. A
    hop's rows are written to the shared checkpoint folder every
    ``checkpoint_every`` hops.
    """
    keys = list(key_cols) + ["repo_id", "seed"]
    start = seeds.select(*key_cols, "repo_id", F.col(seed_col).alias("seed")).distinct()
    frontier = start.withColumn("node", F.col("seed"))
    reached = None
    rev = edges.select("repo_id", F.col("dst").alias("node"), F.col("src").alias("dependent"))
    for hop in range(1, max_hops + 1):
        nxt = (frontier.join(rev, ["repo_id", "node"])
               .filter(F.col("dependent") != F.col("seed"))
               .select(*keys, "dependent").distinct())
        if reached is not None:
            nxt = nxt.join(reached.select(*keys, "dependent"), keys + ["dependent"], "left_anti")
        nxt = nxt.withColumn("hops", F.lit(hop))
        if hop < max_hops and hop % checkpoint_every == 0:
            nxt = cut_lineage(nxt)          # read by the union, the next hop's join and its anti-join
        reached = nxt if reached is None else reached.unionByName(nxt)
        if hop < max_hops:
            frontier = nxt.select(*keys, F.col("dependent").alias("node"))
    return reached


def graph_size(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts per repo."""
    n = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, "repo_id", "left").fillna(0, ["n_edges"])
