"""SimHash near-duplicates, joined through vantage-point trees.

A document's fingerprint has 64 bits; two fingerprints link when at most
``max_bits`` bits differ. Linked pairs are found by a vantage-point tree: each
inner node splits fingerprints by their Hamming distance ``d(x, v)`` to a
vantage point ``v`` at a radius ``mu``. By the triangle inequality, two
fingerprints within ``max_bits`` of each other have distances to ``v`` that
differ by ``max_bits`` at most, so only the fingerprints whose distance lies in
that band around ``mu`` have to be looked up on the far side as well.

* The top of the tree is fitted on a bounded sample of distinct fingerprints
  (``SAMPLE``); it only decides where rows go. *Every* fingerprint is placed: a
  home row in one shard, query rows in each shard its band overlaps. The pairs
  are therefore exact whatever the sample.
* In a shard the same split goes on in memory until ``LEAF`` rows are left.
* A shard that holds a large cluster (its estimated rows exceed ``CELL``) is
  cut into a grid of home blocks by query blocks, so no task gets it whole.
* A task returns a spanning forest of the links it found, never all pairs of a
  group; links between different fingerprints are all represented in the
  forests, so connected components lose none.

Components come from alternating large-star and small-star steps on those
forests, each written to the shared folder.

Defined results: a null or wordless text has fingerprint zero, which links like
any other; repeated rows stay separate rows of the same component; a null
``doc_id`` never names a component unless all members have null ids; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packtables.llm.common import free_name, texts_of, trimmed, written

SEED = 42
SAMPLE = 65_536        # distinct fingerprints the top of the tree is fitted on
SHARD = 4_096          # wanted home rows of a shard
MAX_SHARDS = 4_096
CELL = 65_536          # home rows of a shard beyond which it is cut into a grid
LEAF = 512             # rows compared directly
BLOCK = 65_536         # hashes whose bits are unpacked at once


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of one text (unsigned)."""
    words = (text or "").encode("utf-8").lower().split()     # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else \
        map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        block = hashes[i:i + BLOCK].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id`` and the fingerprint's 64 bits as a signed long ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in texts_of(b)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(trimmed(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


# ---------------------------------------------------------------- vantage-point tree

def distances(x: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ v)


def choose_split(x: np.ndarray, seed: int) -> tuple[np.uint64, int] | None:
    """The vantage point, out of a few members, whose distances spread most; None if no split parts ``x``."""
    rng = np.random.default_rng(seed)
    best = None
    for v in x[rng.integers(0, len(x), 8)]:
        d = distances(x, v)
        mu = int(np.median(d))
        if d.max() == mu:
            mu -= 1
        spread = float(d.std())
        if d.min() <= mu < d.max() and (best is None or spread > best[0]):
            best = (spread, v, mu)
    return best and best[1:]


def build_tree(sample: np.ndarray, depth: int, n_rows: int, seed: int = 1) -> dict:
    """Nested dict: inner nodes have v, mu, near, far; leaves have their estimated share of ``n_rows``."""
    if depth and len(sample) >= 16 and (cut := choose_split(sample, seed)):
        v, mu = cut
        near = distances(sample, v) <= mu
        k = int(n_rows * near.mean())
        return {"v": int(v), "mu": mu, "near": build_tree(sample[near], depth - 1, k, 2 * seed),
                "far": build_tree(sample[~near], depth - 1, n_rows - k, 2 * seed + 1)}
    return {"rows": n_rows}


def number_leaves(tree: dict, leaves: list[dict]) -> dict:
    if "v" in tree:
        number_leaves(tree["near"], leaves)
        number_leaves(tree["far"], leaves)
    else:
        tree["shard"] = len(leaves)
        leaves.append(tree)
    return tree


def route(tree: dict, x: np.ndarray, home: np.ndarray, rows: np.ndarray, r: int, out: list) -> None:
    """Appends (shard, rows, home flags). A home row goes to one side; its query copy goes to the far side only,
    because of any pair that a node parts, the near member's copy meets the far member at home."""
    if not len(rows):
        return
    if "v" not in tree:
        out.append((tree["shard"], rows, home))
        return
    d = distances(x[rows], np.uint64(tree["v"])).astype(np.int64)
    mu = tree["mu"]
    near, far = d <= mu, d > mu
    to_near = np.where(home, near, d - r <= mu)
    to_far = np.where(home, far | (d + r > mu), d + r > mu)
    route(tree["near"], x, home[to_near], rows[to_near], r, out)
    route(tree["far"], x, (home & far)[to_far], rows[to_far], r, out)


def local_links(homes: np.ndarray, queries: np.ndarray, r: int, leaf: int, seed: int = 1) -> Iterator[np.ndarray]:
    """Blocks of linked pairs (two rows) among ``homes`` and between ``queries`` and ``homes``."""
    if not len(homes):
        return
    work = len(homes) * (len(homes) // 2 + len(queries))
    if work > leaf * leaf and (cut := choose_split(homes, seed)):
        v, mu = cut
        dh, dq = distances(homes, v).astype(np.int64), distances(queries, v).astype(np.int64)
        h_near, h_far = homes[dh <= mu], homes[dh > mu]
        q_near = queries[dq - r <= mu]
        q_far = np.concatenate([queries[dq + r > mu], homes[(dh <= mu) & (dh + r > mu)]])
        after = len(h_near) * (len(h_near) // 2 + len(q_near)) + len(h_far) * (len(h_far) // 2 + len(q_far))
        if after < 0.8 * work:
            yield from local_links(h_near, q_near, r, leaf, 2 * seed % (1 << 30))
            yield from local_links(h_far, q_far, r, leaf, (2 * seed + 1) % (1 << 30))
            return
    step = max(1, (1 << 20) // len(homes))
    for q, same in ((homes, True), (queries, False)):
        for i in range(0, len(q), step):
            part = q[i:i + step]
            a, b = np.nonzero(np.bitwise_count(part[:, None] ^ homes[None, :]) <= r)
            keep = a + i < b if same else part[a] != homes[b]
            if keep.any():
                yield np.stack([part[a[keep]], homes[b[keep]]])


def forest(links: np.ndarray) -> np.ndarray:
    """A star for each component of the links: pairs (node, smallest node)."""
    nodes, ends = np.unique(links, return_inverse=True)
    a, b = ends.reshape(links.shape)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return np.stack([nodes[rest], nodes[label[rest]]])


def cell_forest(homes: np.ndarray, queries: np.ndarray, r: int, leaf: int) -> np.ndarray:
    kept, size = [], 0
    for links in local_links(homes, queries, r, leaf):
        kept.append(links)
        size += links.shape[1]
        if size > 1 << 20:
            kept = [forest(np.concatenate(kept, axis=1))]
            size = kept[0].shape[1] // 2          # let it grow by new links before the next merge
    return forest(np.concatenate(kept, axis=1)) if kept else np.zeros((2, 0), np.uint64)


def fingerprint_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Spanning forests (a, b) of the links between distinct fingerprints ``fp``."""
    n = fps.count()
    sample = np.array([x.fp for x in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()],
                      np.int64).view(np.uint64)
    depth = int(np.clip(np.ceil(np.log2(max(1, n) / SHARD)), 0, np.log2(MAX_SHARDS)))
    leaves: list[dict] = []
    tree = number_leaves(build_tree(sample, depth, n), leaves)
    grid = [int(np.ceil(x["rows"] / CELL)) or 1 for x in leaves]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            out: list = []
            route(tree, x, np.ones(len(x), bool), np.arange(len(x)), max_bits, out)
            for shard, rows, home in out:
                k = grid[shard]
                own = (x[rows] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(k)
                for other in range(k):
                    # grid cell (home block, query block): a home row is a query row too where the blocks differ
                    for is_home in (True, False):
                        if is_home:
                            sel = home
                            cell = own * np.uint64(k) + np.uint64(other)
                        else:
                            sel = ~home if k == 1 else ~home | (own != other)
                            cell = np.uint64(other * k) + own
                        if sel.any():
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(int(sel.sum()), shard, np.int64)), pa.array(cell[sel].astype(np.int64)),
                                 pa.array(np.full(int(sel.sum()), is_home)), pa.array(x[rows][sel].view(np.int64))],
                                ["shard", "cell", "home", "fp"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        x, home = pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
        a, b = cell_forest(x[home], x[~home], max_bits, LEAF)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    placed = fps.select("fp").mapInArrow(place, "shard long, cell long, home boolean, fp long")
    return placed.groupBy("shard", "cell").applyInPandas(join, "a long, b long")


# ---------------------------------------------------------------- components

def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): ``node`` and the smallest node ``root`` of its component.

    Large-star and small-star steps; a round's table is written to the shared folder. It stops when a round
    changes no row (compared by count and a sum of row hashes).
    """
    def norm(e: DataFrame) -> DataFrame:
        return (e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .filter("u <> v").distinct())

    edges = written(norm(links), "links")
    mark = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")) \
            .union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = written(norm(small), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(fp: DataFrame, max_bits: int) -> DataFrame:
    """``fp`` (distinct fingerprints) with the smallest fingerprint ``root`` of its component."""
    first = fp.select("fp").distinct()
    comp = components(fingerprint_links(first, max_bits))
    return first.join(comp.select(F.col("node").alias("fp"), "root"), "fp", "left") \
        .select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest doc_id of the component)."""
    fp = written(fingerprints(docs, shingle), "fingerprints")
    roots = written(grouped(fp, max_bits), "roots")
    first = fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(roots, "fp")
    named = first.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = roots.join(named, "root").select("fp", "component_id")
    return fp.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each component of ``docs``, all columns: the smallest doc_id (null ids last), then the smallest
    text hash; of rows that agree in both, any one."""
    key, copies = free_name(docs, "text_key"), free_name(docs, "n_copies")
    slim = docs.select("doc_id", "text")
    fp = written(fingerprints(slim.select(F.struct("doc_id", F.xxhash64("text").alias("key")).alias("doc_id"), "text"),
                              shingle), "fingerprints")
    roots = grouped(fp, max_bits)
    # the first row of each fingerprint, then of each component: a fingerprint of many copies meets its root once
    rows = fp.groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    first = rows.groupBy("fp").agg(F.min(F.struct(
        F.col("doc_id.doc_id").isNull().alias("last"), F.col("doc_id.doc_id").alias("id"),
        F.col("doc_id.key").alias("key"), "n")).alias("k"))
    keep = first.join(roots, "fp").groupBy("root").agg(F.min("k").alias("k"))
    keep = written(keep.select(F.col("k.id").alias("keep_id"), F.col("k.key").alias("keep_key"),
                               F.col("k.n").alias(copies)), "kept")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    on = keyed["doc_id"].eqNullSafe(keep["keep_id"]) & (keyed[key] == keep["keep_key"])
    out = keyed.join(keep.filter(F.col(copies) == 1), on, "left_semi")
    several = keep.filter(F.col(copies) > 1)
    if not several.isEmpty():       # only rows repeated with their id have to be told apart
        out = out.union(keyed.join(several, on, "left_semi").dropDuplicates(["doc_id", key]))
    return out.select(*docs.columns)
