"""k-nearest-neighbour search (J11, J12, J14, W1, P12) and the embedder hook.

Exact search (``knn_pairs``): the chunks of a group (repository) are dealt to a tree of cells whose depth follows the group's
own count. A cell of more than ``LEAF`` rows is cut into at most ``FAN`` by the nearest of as many centroids, which come
from a sample of the cell (a hash threshold from its exact count); each level is one distributed pass over the rows of
the cells that are still too large, and records every new cell's centroid, radius (its furthest chunk) and count.
A query first descends to its nearest leaf; the k-th distance found there bounds the answer. By the triangle inequality no chunk of
a cell is nearer than the centroid's distance less the radius, so the tree is walked once more and only cells below
the bound are kept. Their leaves are visited in rounds, the lowest bounds first and more of them each time, and each
round lowers the bound for the next. Centroids and samples decide how much is pruned, never the result.

Approximate search (``knn_approx``, opt-in): bands of random projections. A chunk has one key for each band, the signs of a few
projections; a query meets the chunks that share a key, and keys that differ where its own projection is least
certain. The distances of those that meet are exact.

In a visit, blocks of a cell's chunks meet blocks of its queries in a cogroup, where
NumPy keeps each query's local top-k (ties by chunk_id, so never more than k): tiles of products in single precision
leave a few pairs to measure, by what was found so far. A row_number window over these rows gives the global top-k. No pair rows are
materialised; block counts follow the row counts of each group and
cell, so a block always fits in one task's memory, and cells of many equal vectors, which cannot be cut, are blocked alike.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packtables.functions.text import similarity

TILE = 512, 4096                            # queries and chunks whose products are held at once
PAIRS = 32_768                              # pairs whose differences are held at once
CROWDED = 16                                # a tile with more than one pair in so many to measure is looked at in double precision first


def _first_equal(cm: np.ndarray, most: int) -> np.ndarray:
    """Rows to keep, in order: of equal vectors the first ``most``, since ties go to the smallest ids."""
    same = np.unique(cm, axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    runs = same[order]
    return np.sort(order[np.arange(len(runs)) - np.searchsorted(runs, runs) < most])


def _merged(k: int, rows: np.ndarray, cols: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each row by distance, then column."""
    order = np.lexsort((cols, d2, rows))
    rows, cols, d2 = rows[order], cols[order], d2[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[best], cols[best], d2[best]


def nearest(qid: np.ndarray, qm: np.ndarray, cid: np.ndarray, cm: np.ndarray, k: int, exclude_self: bool,
            bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and chunks, and squared distances, of each query's ``k`` nearest chunks; ties by place, so ``cm`` is in order of ``cid``.

    Products in single precision, with a bound on their error, tell which pairs may be among the nearest; the distances of these
    alone are taken, from the differences of the vectors. A query's chunks beyond its ``bound`` (a distance) do not count.
    """
    own = np.unique(cid, return_counts=True)[1].max() if exclude_self else 0       # chunks that may be the query itself
    keep = np.flatnonzero(np.isfinite(cm).all(axis=1))
    keep = keep[_first_equal(cm[keep], k + own)] if len(keep) else keep
    cid, cm = cid[keep], cm[keep]
    rows = cols = np.array([], dtype=np.int64)
    if not len(keep):
        return rows, cols, np.array([])
    mid = cm.mean(axis=0)
    c, q = cm - mid, qm - mid
    unit = max(np.abs(c).max(initial=0), np.abs(q[np.isfinite(q)]).max(initial=0)) or 1.0
    c, q, moved = c / unit, q / unit, 4 * np.finfo(float).eps * np.sqrt(mid @ mid) / unit
    cn, qn = np.einsum("ij,ij->i", c, c), np.einsum("ij,ij->i", q, q)
    # the product of (q, 1) and (c, -|c|^2 / 2) is half of |q|^2 less the squared distance
    sides = np.concatenate([q, np.ones((len(q), 1))], axis=1), np.concatenate([c, -cn[:, None] / 2], axis=1)
    single = tuple(np.ascontiguousarray(x, dtype=np.float32) for x in sides)
    held = np.empty(TILE[0] * TILE[1], dtype=np.float32)       # memory that is new for each tile costs as much as the products
    far = np.full(len(q), np.inf) if bound is None else bound * bound      # of the k-th found, or else the bound
    out = []

    def candidates(qs: slice, ct: slice) -> tuple[np.ndarray, np.ndarray]:
        shape = qs.stop - qs.start, ct.stop - ct.start
        for qa, ca in (single, sides):
            out = held[:shape[0] * shape[1]].reshape(shape) if qa is single[0] else None
            p = np.matmul(qa[qs], ca[ct].T, out=out)
            big = np.sqrt(qn[qs]), np.sqrt(cn[ct].max())
            slack = 2 * (q.shape[1] + 8) * np.finfo(p.dtype).eps * (big[0] + big[1]) ** 2 + moved * (big[0] + big[1] + moved) + 1e-37
            least = (qn[qs] - far[qs] / unit / unit) / 2 - slack
            at = p.shape[1] - k - own
            if at > 0 and np.isinf(far[qs]).any():         # at least k chunks are no further than this
                least = np.fmax(least, np.partition(p, at, axis=1)[:, at] - 2 * slack)
            places = np.flatnonzero(p >= np.nextafter(least.astype(p.dtype), p.dtype.type(-np.inf))[:, None])
            if len(places) * CROWDED <= p.size:
                break
        return places // shape[1] + qs.start, places % shape[1] + ct.start

    with np.errstate(all="ignore"):
        for s in range(0, len(q), TILE[0]):
            qs = slice(s, min(len(q), s + TILE[0]))
            rows, cols, d2 = rows[:0], cols[:0], np.array([])
            for t in range(0, len(c), TILE[1]):
                r, x = candidates(qs, slice(t, min(len(c), t + TILE[1])))
                for i in range(0, len(r), PAIRS):
                    ri, xi = r[i:i + PAIRS], x[i:i + PAIRS]
                    diff = qm[ri] - cm[xi]
                    dd = np.einsum("ij,ij->i", diff, diff)
                    near = np.isfinite(dd) & (dd <= far[ri]) & ((qid[ri] != cid[xi]) if exclude_self else True)
                    rows, cols, d2 = _merged(k, np.concatenate([rows, ri[near]]), np.concatenate([cols, xi[near]]), np.concatenate([d2, dd[near]]))
                full = np.flatnonzero(np.bincount(rows - s, minlength=qs.stop - s) == k) + s
                far[full] = np.minimum(far[full], d2[np.searchsorted(rows, full, side="right") - 1]) if len(full) else far[full]
            out.append((rows, keep[cols], d2))
    return tuple(np.concatenate(x) for x in zip(*out))


def _local_topk(k: int, exclude_self: bool, group: str):
    def run(qdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or cdf.empty:
            return pd.DataFrame({group: pd.Series([], dtype="object"),
                                 "query_id": pd.Series([], dtype="int64"),
                                 "chunk_id": pd.Series([], dtype="int64"),
                                 "distance": pd.Series([], dtype="float64")})
        cdf = cdf.sort_values("chunk_id", kind="stable")
        cid, qid = cdf["chunk_id"].to_numpy(dtype=np.int64), qdf["query_id"].to_numpy(dtype=np.int64)
        bound = qdf["bound"].fillna(np.inf).to_numpy(dtype=np.float64) if "bound" in qdf else np.full(len(qid), np.inf)
        rows, cols, d2 = nearest(qid, _matrix(qdf["vec"]), cid, _matrix(cdf["vec"]), k, exclude_self, bound * (1 + SLACK) + SLACK)
        return pd.DataFrame({group: qdf[group].iloc[0], "query_id": qid[rows], "chunk_id": cid[cols], "distance": np.sqrt(d2)})
    return run


LEAF, FAN, SAMPLE = 65_536, 16, 1_024       # rows of a leaf, cells a cell is cut into at most, rows its centroids come from
BLOCKS = 8                                  # query blocks that a leaf's chunks are sent to, unless these would be too large
FIRST, MORE = 4, 8                          # leaves a query visits in the first bounded round; factor of the next ones
SLACK = 1e-6                                # distances come from a formula that rounds


def fit_centroids(vecs: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """A few rounds of k-means from evenly spaced rows; equal centroids are one."""
    cent = vecs[np.linspace(0, len(vecs) - 1, min(n, len(vecs))).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(vecs, cent).argmin(axis=1)
        for i in np.unique(near):
            cent[i] = vecs[near == i].mean(axis=0)
    return np.unique(cent, axis=0)


def _distances(x: np.ndarray, cent: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - c) ** 2).sum(axis=1) for c in cent], axis=1))


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in s.to_numpy()])


def _meeting(rows: DataFrame, table: DataFrame, keys: list[str], id_col: str, per: int, fn, schema: str) -> DataFrame:
    """``fn(rows, table)`` of each key, in blocks of about ``per`` rows; every block sees the key's whole table (a cell's children)."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / per).cast("long").alias("_n"))
    left = rows.join(n, keys).withColumn("_b", F.pmod(F.xxhash64(id_col), F.col("_n"))).drop("_n")
    right = table.join(n, keys).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    return left.groupBy(*keys, "_b").cogroup(right.groupBy(*keys, "_b")).applyInPandas(fn, schema)


class CellTree(NamedTuple):
    """``leaves(_g, node, chunk_id, vec)`` and, for each level, ``cells(_g, node, child, centroid, radius, n)``."""
    leaves: DataFrame
    levels: list[DataFrame]


def cell_tree(chunks: DataFrame, leaf: int = LEAF, fan: int = FAN, sample: int = SAMPLE, block: int = 65_536) -> CellTree:
    """The tree of ``chunks(_g, chunk_id, vec)``; a node is a path of child numbers, the root an empty one."""
    from packtables.session import cut_lineage

    vec = chunks.schema["vec"].dataType.simpleString()
    rows, done, levels = cut_lineage(chunks.withColumn("node", F.lit(""))), [], []
    keys = ["_g", "node"]

    def centroids(df: pd.DataFrame) -> pd.DataFrame:
        parts = min(fan, -(-2 * int(df["n"].iloc[0]) // leaf))      # cells of about half a leaf
        cent = fit_centroids(_matrix(df.sort_values("chunk_id")["vec"]), parts)
        return pd.DataFrame({"_g": df["_g"].iloc[0], "node": df["node"].iloc[0], "child": np.arange(len(cent), dtype="int32"), "centroid": list(cent)})

    def assign(cdf: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if cdf.empty or cells.empty:
            return pd.DataFrame({"_g": [], "node": [], "chunk_id": [], "vec": [], "child": [], "dist": []})
        d = _distances(_matrix(cdf["vec"]), _matrix(cells.sort_values("child")["centroid"]))
        near = d.argmin(axis=1)
        return cdf[["_g", "node", "chunk_id", "vec"]].assign(child=near.astype("int32"), dist=d[np.arange(len(d)), near])

    while True:
        counts = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("n")))
        large = counts.filter(F.col("n") > leaf)
        if large.isEmpty():
            return CellTree(_union([*done, rows.select("_g", "node", "chunk_id", "vec")]), levels)
        done.append(rows.join(large, keys, "left_anti").select("_g", "node", "chunk_id", "vec"))
        rows = rows.join(large, keys)
        some = rows.filter(F.shiftrightunsigned(F.xxhash64("chunk_id", F.lit(len(levels))), 1) < F.lit(float(2 ** 63)) * sample / F.col("n"))
        cent = cut_lineage(some.select("_g", "node", "chunk_id", "vec", "n").groupBy(*keys).applyInPandas(
            centroids, "_g string, node string, child int, centroid array<double>"))
        dealt = cut_lineage(_meeting(rows.drop("n"), cent, keys, "chunk_id", block, assign,
                                     f"_g string, node string, chunk_id long, vec {vec}, child int, dist double"))
        cells = dealt.groupBy(*keys, "child").agg(F.max("dist").alias("radius"), F.count("*").alias("n")).join(cent, [*keys, "child"])
        path = F.concat(F.col("node"), F.lit("/"), F.col("child").cast("string"))
        levels.append(cut_lineage(cells.select("_g", "node", path.alias("child"), "centroid", "radius", "n")))
        # a cell whose rows all went to one child cannot be cut: its rows are equal, or nearly; that child stays a leaf
        stuck = levels[-1].groupBy(*keys).agg(F.count("*").alias("parts")).filter("parts = 1").select(*keys)
        done.append(dealt.join(stuck, keys, "left_semi").select("_g", path.alias("node"), "chunk_id", "vec"))
        rows = dealt.join(stuck, keys, "left_anti").select("_g", path.alias("node"), "chunk_id", "vec")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _walked(rows: DataFrame, tree: CellTree, nearest: bool, vec: str, block: int) -> DataFrame:
    """``rows(_g, row, query_id, vec, node, lower, bound)`` moved down to leaves: to the nearest child, or to all below the bound."""
    names_ = ["_g", "row", "query_id", "vec", "node", "lower", "bound"]

    def step(qdf: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or cells.empty:
            return qdf[names_]
        cells = cells.sort_values("child")
        d = _distances(_matrix(qdf["vec"]), _matrix(cells["centroid"]))
        names = cells["child"].to_numpy()
        if nearest:
            return qdf.assign(node=names[d.argmin(axis=1)])[names_]
        lower, bound = d - cells["radius"].to_numpy(), qdf["bound"].fillna(np.inf).to_numpy(dtype=float)[:, None]
        r, c = np.nonzero(lower <= bound + SLACK * (1 + np.where(np.isfinite(bound), bound, 0)))
        return qdf.iloc[r].assign(node=names[c], lower=lower[r, c])[names_]

    for cells in tree.levels:
        rows = _meeting(rows, cells, ["_g", "node"], "query_id", block, step,
                        f"_g string, row long, query_id long, vec {vec}, node string, lower double, bound double")
    return rows


def _sides(queries: DataFrame, chunks: DataFrame, group: str | None) -> tuple[DataFrame, DataFrame]:
    """Fresh projections (both sides may be one table) with a group key that is never null."""
    g = F.coalesce(F.concat(F.lit("r_"), F.col(group).cast("string")), F.lit("none")) if group else F.lit("")
    return tuple(df.select(g.alias("_g"), F.col(i).cast("long").alias(i), F.col("vec").alias("vec")).filter("vec is not null")
                 for df, i in ((queries, "query_id"), (chunks, "chunk_id")))


def _visited(rows: DataFrame, cells: DataFrame, k: int, exclude_self: bool, query_block_rows: int, chunk_block_rows: int) -> DataFrame:
    """Local top-k rows: ``rows(_g, node, query_id, vec)`` meet the chunks of ``cells(_g, node, chunk_id, vec)``."""
    keys = ["_g", "node"]
    # more queries make larger blocks before they make more of them, each of which gets the chunks
    per = F.greatest(F.lit(query_block_rows), F.least(F.lit(chunk_block_rows), F.ceil(F.count("*") / BLOCKS)))
    nq = rows.groupBy(*keys).agg(F.ceil(F.count("*") / per).cast("long").alias("bq"))
    nc = cells.groupBy(*keys).agg(F.ceil(F.count("*") / chunk_block_rows).cast("long").alias("bc"))
    asked = nq.join(nc, keys)
    known = [c for c in rows.columns if c == "bound"]       # distances beyond which a query's chunks do not count
    left = rows.select(*keys, "query_id", "vec", *known).join(asked, keys).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("bq"))).withColumn(
        "cb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bc") - 1))).drop("bq", "bc")
    right = cells.select(*keys, "chunk_id", "vec").join(asked, keys).withColumn("cb", F.pmod(F.xxhash64("chunk_id"), F.col("bc"))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bq") - 1))).drop("bq", "bc")
    return left.groupBy(*keys, "qb", "cb").cogroup(right.groupBy(*keys, "qb", "cb")).applyInPandas(
        _local_topk(k, exclude_self, "_g"), schema="_g string, query_id long, chunk_id long, distance double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("_g", "query_id").orderBy("distance", "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _named(top: DataFrame, group: str | None, kind: str | None) -> DataFrame:
    g = F.when(F.col("_g") != "none", F.substring("_g", 3, 2 ** 31 - 1)).cast(kind) if group else None
    return top.select(*([g.alias(group)] if group else []), "query_id", "chunk_id", "distance", "rank")


def knn_pairs(queries: DataFrame, chunks: DataFrame, k: int, *, exclude_self: bool = False,
              query_block_rows: int = 4096, chunk_block_rows: int = 65536, group: str | None = None,
              visits: list | None = None, leaf_rows: int = LEAF) -> DataFrame:
    """Exact top-k per query by Euclidean distance, ties broken by chunk_id.

    ``queries(query_id long, vec array<float|double>)``,
    ``chunks(chunk_id long, vec array<float|double>)``; with ``group`` (e.g.
    ``repo_id``) on both sides a query only meets chunks of its own group, null being one.
    A leaf with ``Q`` visiting queries and ``C`` chunks is cut into ``ceil(C / chunk_block_rows)`` blocks of chunks by
    ``ceil(Q / query_block_rows)`` of queries; beyond ``BLOCKS`` of these, they grow up to ``chunk_block_rows`` instead.
    Returns ``(group, query_id, chunk_id, distance, rank)``, ``group`` only if it was given; ids need to be unique
    within a group only. ``visits``, if given, gets the frames of each round's (query, leaf) rows.
    """
    from packtables.session import cut_lineage

    kind = queries.schema[group].dataType.simpleString() if group else None
    q, c = _sides(queries, chunks, group)
    vec = q.schema["vec"].dataType.simpleString()
    tree = cell_tree(c, leaf_rows, block=chunk_block_rows)
    visit = lambda rows: _visited(rows, tree.leaves, k, exclude_self, query_block_rows, chunk_block_rows)
    start = q.select("_g", F.monotonically_increasing_id().alias("row"), "query_id", "vec", F.lit("").alias("node"), F.lit(0.0).alias("lower"), F.lit(None).cast("double").alias("bound"))
    start = cut_lineage(start)          # read in each round
    if not tree.levels:                 # every group is one leaf
        if visits is not None:
            visits.append(start)
        return _named(_best(visit(start), k), group, kind)
    near = cut_lineage(_walked(start, tree, True, vec, query_block_rows))
    if visits is not None:
        visits.append(near)
    found = cut_lineage(_best(visit(near), k).drop("rank"))

    def bounded(rows: DataFrame) -> DataFrame:
        far = found.groupBy("_g", "query_id").agg(F.max("distance").alias("far"), F.count("*").alias("got"))
        far = far.select("_g", "query_id", F.when(F.col("got") >= k, F.col("far")).alias("bound"))
        return rows.drop("bound").join(far, ["_g", "query_id"], "left")

    # a row for each query and leaf: the vectors stay behind until a leaf is visited
    left = _walked(bounded(start).select(*start.columns), tree, False, vec, query_block_rows).drop("vec")
    left = left.join(near.select("_g", "query_id", "node"), ["_g", "query_id", "node"], "left_anti")
    take = FIRST
    while True:
        # a group of one leaf has been visited whole; elsewhere a null bound means fewer than k chunks so far
        open_rows = bounded(left).filter(F.col("bound").isNull() | (F.col("lower") <= F.col("bound") + SLACK * (1 + F.col("bound"))))
        open_rows = cut_lineage(open_rows.withColumn("turn", F.row_number().over(Window.partitionBy("_g", "query_id").orderBy("lower", "node"))))
        now = open_rows.filter(F.col("turn") <= take)
        if now.isEmpty():
            return _named(_best(found, k), group, kind)
        if visits is not None:
            visits.append(now)
        asked = now.join(start.select("row", "vec"), "row")
        found = cut_lineage(_best(found.unionByName(visit(asked)), k).drop("rank"))
        left, take = open_rows.filter(F.col("turn") > take).drop("turn"), take * MORE


BANDS, PROBES, APPROX_CELL = 12, 2, 256


def _projected(df: DataFrame, planes: np.ndarray, mean: np.ndarray, bands: int, probes: int) -> DataFrame:
    """``df(_g, bits, ..., vec)`` with ``node``, the keys of each row: one for each band, and ``probes`` more with its least certain signs turned."""
    @F.pandas_udf("array<string>")
    def keys(vec: pd.Series, bits: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype="object")
        p = (_matrix(vec) - mean) @ planes.T
        out = []
        for row, b in zip(p.reshape(len(p), bands, -1), bits):
            own = []
            for band, x in enumerate(row[:, :b]):
                sign = x > 0
                for turned in [None, *np.argsort(np.abs(x), kind="stable")[:probes]]:
                    s = sign.copy()
                    if turned is not None:
                        s[turned] = ~s[turned]
                    own.append(f"{band}:{''.join('01'[int(v)] for v in s)}")
            out.append(own)
        return pd.Series(out)

    return df.withColumn("node", F.explode(keys("vec", "bits")))


def knn_approx(queries: DataFrame, chunks: DataFrame, k: int, *, exclude_self: bool = False, bands: int = BANDS, probes: int = PROBES,
               cell_rows: int = APPROX_CELL, most_bits: int = 24, query_block_rows: int = 4096, chunk_block_rows: int = 65536,
               group: str | None = None, seed: int = 5) -> DataFrame:
    """Top-k among the chunks that share a key with the query; recall below one, distances exact.

    The number of projections of a key follows the group's count, so that a key has about ``cell_rows`` chunks; ``bands``
    and ``probes`` trade work for recall. Inputs and result are those of ``knn_pairs``; a query may get fewer than k rows.
    """
    from packtables.session import cut_lineage

    kind = queries.schema[group].dataType.simpleString() if group else None
    q, c = (cut_lineage(side) for side in _sides(queries, chunks, group))
    mean = [r.m for r in c.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()]
    planes = np.random.default_rng(seed).standard_normal((bands * most_bits, max(1, len(mean))))
    bits = F.least(F.lit(most_bits), F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / F.lit(float(cell_rows)))))).cast("int")
    depth = c.groupBy("_g").agg(bits.alias("bits"))
    cells = cut_lineage(_projected(c.join(depth, "_g"), planes, np.array(mean), bands, 0).select("_g", "node", "chunk_id", "vec"))
    rows = _projected(q.join(depth, "_g"), planes, np.array(mean), bands, probes).select("_g", "node", "query_id", "vec")
    pairs = _visited(cut_lineage(rows), cells, k, exclude_self, query_block_rows, chunk_block_rows)
    once = pairs.groupBy("_g", "query_id", "chunk_id").agg(F.min("distance").alias("distance"))     # a pair may meet under several keys
    return _named(_best(once, k), group, kind)


def search(queries: DataFrame, chunks: DataFrame, k: int = 8, threshold: float = 0.40, *,
           exclude_self: bool = False, query_block_rows: int = 4096,
           chunk_block_rows: int = 65536, group: str | None = None, approximate: bool = False) -> DataFrame:
    """Top ``k`` first, threshold on score second (Q15); ``approximate`` searches by keys.

    Returns ``(group, query_id, chunk_id, rank, distance, score)``, ``group`` only if it was given.
    """
    pairs = (knn_approx if approximate else knn_pairs)(queries, chunks, k, exclude_self=exclude_self, query_block_rows=query_block_rows,
                                                       chunk_block_rows=chunk_block_rows, group=group)
    return (pairs.withColumn("score", similarity("distance"))
            .filter(F.col("score") >= F.lit(threshold)))


# ---------------------------------------------------------------------------
# Embedder hook. The default embeds text by hashing its word pieces into
# a fixed number of dimensions (deterministic, runs anywhere). Any callable
# ``list[str] -> np.ndarray`` can replace it; it is called once per Arrow batch
# and loaded once per worker. A failing batch gives an error in each of its rows.

def hashed_bag_embedder(dim: int = 64):
    import re
    import zlib

    piece = re.compile(r"[A-Za-z0-9_]+")

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in piece.findall((t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1.0 if (h >> 31) & 1 else -1.0
            n = np.linalg.norm(out[i])
            if n > 0:
                out[i] /= n
        return out
    return embed


def embed_column(df: DataFrame, text_col: str, out_col: str = "embedding", embedder=None,
                 dim: int = 64) -> DataFrame:
    """``df`` with a vector of each text, without the rows whose batch failed (``embed_checked`` lists those)."""
    checked = embed_checked(df, text_col, out_col, embedder, dim)
    return checked.filter(F.col(out_col).isNotNull()).drop(f"{out_col}_error")


def embed_checked(df: DataFrame, text_col: str, out_col: str = "embedding", embedder=None, dim: int = 64) -> DataFrame:
    """``df`` with a vector of each text and ``<out_col>_error``: what the embedder raised for the row's batch, or null."""
    make = embedder or (lambda: hashed_bag_embedder(dim))

    @F.pandas_udf("vec array<float>, error string")
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = make()
        for s in batches:
            try:
                vecs = [np.asarray(v, dtype=np.float32) for v in fn(s.fillna("").tolist())]
                yield pd.DataFrame({"vec": vecs, "error": None})
            except Exception as e:      # a batch that fails is reported row by row; the others go on
                yield pd.DataFrame({"vec": [None] * len(s), "error": f"{type(e).__name__}: {e}"})

    both = df.withColumn("_embedded", _embed(F.col(text_col)))
    return both.withColumn(out_col, F.col("_embedded.vec")).withColumn(f"{out_col}_error", F.col("_embedded.error")).drop("_embedded")
