"""Block kNN (J12, W1) and n-gram substring lookups (J2, J4, J5) against brute force."""

import numpy as np
from pyspark.sql import functions as F

from packtables.operators import vectors
from packtables.operators.lookup import containing, first_containing


def test_block_knn_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    q = rng.normal(size=(37, 6)).astype(np.float32)
    c = rng.normal(size=(101, 6)).astype(np.float32)
    c[5] = c[9]                    # a tie: broken by chunk_id
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<float>")
    cd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "chunk_id long, vec array<float>")
    got = vectors.search(qd, cd, k=4, threshold=0.2, query_block_rows=10, chunk_block_rows=17)
    got = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 9)) for r in got.collect()}
    exp = {}
    for i, v in enumerate(q.astype(np.float64)):
        d = np.sqrt(((c.astype(np.float64) - v) ** 2).sum(axis=1))
        order = sorted(range(len(c)), key=lambda j: (d[j], j))[:4]
        for r, j in enumerate(order, start=1):
            s = 1.0 / (1.0 + d[j])
            if s >= 0.2:
                exp[(i, r)] = (j, round(s, 9))
    assert got == exp


def test_containing_equals_brute_force(spark):
    hay = ["src/app/main.py", "src/lib/util.ts", "docs/readme.md", "a/b/c.go", "src/app/util.py"]
    needles = ["util", "app/m", "c.go", "zz", "src", "ut", "u"]
    h = spark.createDataFrame([("r", p) for p in hay], "repo_id string, path string")
    n = spark.createDataFrame([("r", x) for x in needles], "repo_id string, mention string")
    got = {(r.mention, r.path) for r in containing(n, h, needle="mention", value="path", q=3).collect()}
    assert got == {(x, p) for x in needles for p in hay if x in p}
    first = {r.mention: r.match for r in first_containing(n, h, needle="mention", value="path",
                                                         order="path", q=3).collect()}
    assert first == {x: min(p for p in hay if x in p) for x in needles if any(x in p for p in hay)}


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab/.c", min_size=1, max_size=8), min_size=1, max_size=12, unique=True),
       st.lists(st.text(alphabet="ab/.c", min_size=1, max_size=4), min_size=1, max_size=8, unique=True),
       st.sampled_from([2, 3]))
def test_containing_random(spark, hay, needles, q):
    h = spark.createDataFrame([("r", p) for p in hay], "repo_id string, path string")
    n = spark.createDataFrame([("r", x) for x in needles], "repo_id string, mention string")
    got = {(r.mention, r.path) for r in containing(n, h, needle="mention", value="path", q=q).collect()}
    assert got == {(x, p) for x in needles for p in hay if x in p}


def test_grouped_knn_per_repo_blocks(spark):
    """Queries only meet chunks of their repo; block counts follow each repo's size."""
    rng = np.random.default_rng(3)
    data = {"big": (rng.normal(size=(30, 4)), rng.normal(size=(90, 4))), "small": (rng.normal(size=(3, 4)),
                                                                                  rng.normal(size=(5, 4)))}
    qrows, crows, qid, cid = [], [], 0, 0
    exp = {}
    for repo, (qs, cs) in data.items():
        cids = list(range(cid, cid + len(cs)))
        for v in qs:
            d = np.sqrt(((cs - v) ** 2).sum(axis=1))
            order = sorted(range(len(cs)), key=lambda j: (d[j], cids[j]))[:3]
            for r, j in enumerate(order, start=1):
                exp[(qid, r)] = cids[j]
            qrows.append((repo, qid, v.astype(np.float32).tolist()))
            qid += 1
        crows += [(repo, c, v.astype(np.float32).tolist()) for c, v in zip(cids, cs)]
        cid += len(cs)
    q = spark.createDataFrame(qrows, "repo_id string, query_id long, vec array<float>")
    c = spark.createDataFrame(crows, "repo_id string, chunk_id long, vec array<float>")
    got = vectors.knn_pairs(q, c, 3, group="repo_id", query_block_rows=7, chunk_block_rows=11)
    assert {(r.query_id, r.rank): r.chunk_id for r in got.collect()} == exp


def test_knn_visits_fewer_cells_than_all(spark):
    """Clustered vectors: exact results from few of the (query, cell) pairs; null and equal vectors included."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 20
    c = np.concatenate([centres[i] + rng.normal(size=(60, 8)) * 0.3 for i in range(12)])
    c[100] = c[101] = c[102]
    q = centres[rng.integers(0, 12, 40)] + rng.normal(size=(40, 8)) * 0.3
    cd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)] + [(9999, None)], "chunk_id long, vec array<double>")
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(9999, None)], "query_id long, vec array<double>")
    visits = []
    got = vectors.knn_pairs(qd, cd, 5, query_block_rows=7, chunk_block_rows=20, visits=visits, leaf_rows=70).collect()
    want = {}
    for i, v in enumerate(q):
        d = np.sqrt(((c - v) ** 2).sum(axis=1))
        for r, j in enumerate(sorted(range(len(c)), key=lambda j: (round(d[j], 9), j))[:5], start=1):
            want[(i, r)] = j
    assert {(r.query_id, r["rank"]): r.chunk_id for r in got} == want
    sizes = {r.node: r["count"] for r in vectors.cell_tree(vectors._sides(qd, cd, None)[1], leaf=70).leaves.groupBy("node").count().collect()}
    assert max(sizes.values()) <= 70 and len(sizes) >= 11
    assert sum(sizes[r.node] for v in visits for r in v.select("node").collect()) < 0.4 * 40 * len(c)


def brute(q, c, k):
    out = {}
    for i, v in enumerate(q):
        d = np.sqrt(((c - v) ** 2).sum(axis=1))
        for r, j in enumerate(sorted(range(len(c)), key=lambda j: (round(d[j], 9), j))[:k], start=1):
            out[(i, r)] = j
    return out


def frames(spark, q, c):
    return (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<double>"),
            spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "chunk_id long, vec array<double>"))


def test_visited_share_falls_as_chunks_grow(spark):
    """The tree deepens with the count: results stay exact while the share of the chunks that a query meets goes down."""
    shares = []
    for n in (300, 1200, 4800):
        rng = np.random.default_rng(11)
        c = np.cumsum(rng.normal(size=(n, 3)), axis=0) / 3          # a walk: neighbours in order are neighbours in space
        q = c[rng.integers(0, n, 30)] + rng.normal(size=(30, 3)) * 0.1
        qd, cd = frames(spark, q, c)
        visits = []
        got = vectors.knn_pairs(qd, cd, 4, leaf_rows=60, visits=visits).collect()
        assert {(r.query_id, r["rank"]): r.chunk_id for r in got} == brute(q, c, 4)
        tree = vectors.cell_tree(vectors._sides(qd, cd, None)[1], leaf=60)
        sizes = {r.node: r["count"] for r in tree.leaves.groupBy("node").count().collect()}
        shares.append(sum(sizes[r.node] for v in visits for r in v.select("node").collect()) / (30 * n))
    assert len(tree.levels) >= 2 and shares[0] > 1.5 * shares[1] and shares[1] > 1.5 * shares[2]


def test_equal_vectors_cannot_be_cut(spark):
    """More equal chunks than a leaf holds: a leaf of its own, blocked like any other; null repositories are one."""
    rng = np.random.default_rng(6)
    c = np.concatenate([np.ones((150, 4)), rng.normal(size=(60, 4))])
    rows = [(g, i, v.tolist()) for g in ("a", None) for i, v in enumerate(c)]
    qs = [(g, i, (np.ones(4) * (1 + 0.1 * i)).tolist()) for g in ("a", None, "nobody") for i in range(3)]
    cd = spark.createDataFrame(rows, "repo_id string, chunk_id long, vec array<double>")
    qd = spark.createDataFrame(qs, "repo_id string, query_id long, vec array<double>")
    got = vectors.knn_pairs(qd, cd, 3, group="repo_id", leaf_rows=20, chunk_block_rows=30).collect()
    assert {(r.repo_id, r.query_id, r["rank"], r.chunk_id) for r in got} == {(g, q, r, r - 1) for g in ("a", None) for q in range(3) for r in (1, 2, 3)}


def test_approximate_search(spark):
    """Distances are exact, recall@8 on the given vectors is at least 0.9, and fewer chunks are met than there are."""
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = np.stack([np.asarray(r.embedding, float) for r in emb.orderBy("vec_id").collect()])
    ids = sorted(r.vec_id for r in emb.collect())
    q = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    c = emb.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    got = vectors.knn_approx(q, c, 8, exclude_self=True, cell_rows=125).collect()
    at = {v: i for i, v in enumerate(ids)}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nearest = np.argsort(d, axis=1, kind="stable")[:, :8]
    hits = sum(at[r.chunk_id] in nearest[at[r.query_id]] for r in got)
    assert hits / (8 * len(x)) >= 0.9
    assert all(abs(r.distance - d[at[r.query_id], at[r.chunk_id]]) < 1e-6 for r in got)
    assert vectors.knn_approx(q, c.limit(0), 8).collect() == [] and vectors.knn_approx(q.limit(0), c, 8).collect() == []
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    c = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.5
    qd, cd = frames(spark, c[:60], c)
    found = {(r.query_id, r.chunk_id) for r in vectors.knn_approx(qd, cd, 8).collect()}
    want = {(i, j) for (i, _), j in brute(c[:60], c, 8).items()}
    assert len(found & want) >= 0.9 * len(want)


def test_knn_of_few_or_no_chunks(spark):
    qd = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "query_id long, vec array<double>")
    cd = spark.createDataFrame([(1, [0.5]), (2, [0.5])], "chunk_id long, vec array<double>")
    assert len(vectors.knn_pairs(qd, cd, 5).collect()) == 4
    assert vectors.knn_pairs(qd, cd.limit(0), 5).collect() == []
    assert vectors.knn_pairs(qd.limit(0), cd, 5).collect() == []
    assert {(r.query_id, r.chunk_id) for r in vectors.knn_pairs(qd, cd, 1, exclude_self=True).collect()} == {(1, 2), (2, 1)}
