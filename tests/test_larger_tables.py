"""What grows with the tables in the queries of packs and in the search (round 4 findings)."""

import numpy as np
from pyspark.sql import functions as F

from packtables.operators import vectors
from packtables.plans import registry as R


def tables(spark, folder, n=60):
    """A folder of small tables; line items and orders come twice and have nulls, files of parts 7 and 8 come twice."""
    part = [(i,) for i in [*range(n), 7, 8]]
    orders = [(i, i % 7, "OF"[i % 2], f"{i % 5}-P") for i in [*range(200), 11, 12]] + [(None, 3, "O", "1-P")]
    items = [(i % 211, (i * i) % (n + 9)) for i in range(900)] + [(5, 7), (5, 7), (None, 7), (6, None)]
    talk = [(c, 0, "user", f"rename Cls{c % n} and pkg{c % 20}/mod_{c % n}") for c in range(30)]
    rows = {"part": spark.createDataFrame(part, "p_partkey long"),
            "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
            .withColumn("o_orderdate", F.timestamp_seconds(9 * 10 ** 8 + F.pmod(F.col("o_orderkey") * 7919, F.lit(90)) * 86400)),
            "lineitem": spark.createDataFrame(items, "l_orderkey long, l_partkey long"),
            "conversations": spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"),
            "embeddings": spark.range(20).selectExpr("id as vec_id", "int(id % 5) as label", "array(float(id), float(1)) as embedding")}
    for name, df in rows.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_commits_are_ranked_for_the_paths_of_packs_alone(spark, tmp_path):
    """the git context of packs is that of the whole summary, which is not made for it."""
    from packtables.operators.history import commit_summary, recent_commits

    folder = tables(spark, tmp_path)
    got = R.QUERIES["git_context"](spark, folder).collect()
    inp, fx = R.strategy_inputs(spark, folder), R.fixture(spark, folder)
    assert "commit_summary" not in inp.__dict__ and "commit_files" not in fx._cache
    whole = commit_summary(recent_commits(fx.commits, fx.commit_files, 5), F.lit(R.AS_OF).cast("timestamp"))
    asked = spark.createDataFrame([("fx", "pkg7/mod_7.js"), ("fx", "pkg3/mod_3.go"), ("fx", "no such file"), (None, "pkg7/mod_7.js")], "repo_id string, path string")
    rows = whole.collect()
    of = lambda path: sorted(tuple(r) for r in rows if r.path == path)
    some = sorted(map(tuple, inp.commits_of(asked).collect()))
    assert some == of("pkg3/mod_3.go") + of("pkg7/mod_7.js") and len({r[1] for r in some}) == 2
    text = lambda path: ";".join("|".join(r[4:]) for r in of(path) if r[2] <= R.OPTS.pack_commits)
    assert len(got) > 20 and all(r.commits == text(r.path) for r in got)


def test_a_given_summary_is_the_one_that_is_read(spark, tmp_path):
    """inputs with a summary of their own are asked for that one."""
    from packtables.plans.strategies import StrategyInputs

    inp = R.strategy_inputs(spark, tables(spark, tmp_path))
    own = spark.createDataFrame([("fx", "a", 1, "h"), ("fx", "b", 1, "i"), (None, "a", 1, "j")], "repo_id string, path string, rank int, hash string")
    asked = spark.createDataFrame([("fx", "a"), ("fx", "a"), (None, "a")], "repo_id string, path string")
    for held in (R.FixtureInputs(commit_summary=own), StrategyInputs(inp.signals, None, None, None, own)):
        assert [r.hash for r in held.commits_of(asked).collect()] == ["h"]


def test_keys_are_sent_by_their_counted_size(spark, monkeypatch):
    """few keys are broadcast, many are not."""
    from packtables.operators import joins

    keys = spark.range(1000).selectExpr("concat('k', id) as k", "id")
    assert "hint" in joins.sent(keys)._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(joins, "SMALL", 1000 * 50)
    assert "hint" not in joins.sent(keys)._jdf.queryExecution().logical().toString().lower()
    assert joins.sent(keys.limit(0)).count() == 0


def brute(qid, q, cid, c, k, other):
    """Places of each query's nearest finite vectors by the differences, ties by place."""
    out = []
    for i, v in enumerate(q):
        d = ((c - v) ** 2).sum(axis=1)
        ok = np.isfinite(d) & ((cid != qid[i]) if other else True)
        out.append([(j, d[j]) for j in np.lexsort((np.arange(len(c)), d)) if ok[j]][:k])
    return out


def test_nearest_is_exact_over_tiles(monkeypatch):
    """ties, copies, ids that repeat, vectors far from the origin, of very unlike sizes and not finite; few pairs are measured."""
    monkeypatch.setattr(vectors, "TILE", (50, 70))
    monkeypatch.setattr(vectors, "PAIRS", 500)
    rng = np.random.default_rng(2)
    for case in range(36):
        n, m, dim, k = (int(rng.integers(1, top)) for top in (400, 120, 9, 10))
        c = rng.normal(size=(n, dim))
        if case % 6 == 1:
            c = np.round(c)
        elif case % 6 == 2:
            c = c * 1e-5 + rng.integers(0, 2, size=(n, 1)) * 10 + 1e6
        elif case % 6 == 3:
            c[rng.random(n) < .5] = c[0]
        elif case % 6 == 4:
            c = c * 10.0 ** int(rng.integers(-30, 20))
            c[rng.random(n) < .05] = np.nan
        elif case % 6 == 5:
            c, c[0] = c * 1e-9, 1e9
        q = c[rng.integers(0, n, m)].copy() if case % 2 else rng.normal(size=(m, dim))
        cid, qid, other = np.sort(rng.integers(0, n, n)), rng.integers(0, n, m), case % 3 > 0
        want = brute(qid, q, cid, c, k, other)
        got = [[] for _ in q]
        for i, j, d in zip(*vectors.nearest(qid, q, cid, c, k, other)):
            got[i].append((j, d))
        for a, b in zip(got, want):
            assert len(a) == len(b) and ([x for x, _ in a] == [x for x, _ in b] or np.allclose([d for _, d in a], [d for _, d in b], rtol=1e-12, atol=0))
        bound = np.array([np.sqrt(x[len(x) // 2][1]) if x else np.inf for x in want])
        near = [0] * m
        for i, j, d in zip(*vectors.nearest(qid, q, cid, c, k, other, bound * (1 + 1e-12))):
            near[i] += 1
            assert d <= bound[i] ** 2 * (1 + 1e-11)
        assert all(got_ >= len(x) // 2 for got_, x in zip(near, want))


def test_few_pairs_are_measured(monkeypatch):
    """of 400 by 20,000 pairs, a few of each query's are measured and none is sorted after the first tile."""
    seen = []
    merged = vectors._merged
    monkeypatch.setattr(vectors, "_merged", lambda k, rows, *rest: seen.append(len(rows)) or merged(k, rows, *rest))
    c = np.random.default_rng(3).normal(size=(20_000, 16))
    rows, cols, d2 = vectors.nearest(np.arange(400), c[:400], np.arange(20_000), c, 8, True)
    assert len(rows) == 3200 and sum(seen) < 400 * 20_000 / 100
    c[:10_000] = c[0]                           # copies: the nearest of each other are those of the smallest ids
    rows, cols, d2 = vectors.nearest(np.arange(400), c[:400], np.arange(20_000), c, 8, True)
    assert cols[rows == 5].tolist() == [0, 1, 2, 3, 4, 6, 7, 8] and cols[rows == 300].tolist() == list(range(8)) and not d2.any()


def test_later_visits_know_the_distance_to_beat(spark, monkeypatch):
    """a leaf gives no rows beyond a query's bound, and the result is that of one leaf."""
    c = np.random.default_rng(4).normal(size=(1500, 4))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "id long, vec array<float>")
    q, ch = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id")
    given = []
    visited = vectors._visited
    monkeypatch.setattr(vectors, "_visited", lambda rows, *rest: given.append(visited(rows, *rest)) or given[-1])
    take = lambda leaf: sorted(map(tuple, vectors.knn_pairs(q, ch, 5, exclude_self=True, leaf_rows=leaf).select("query_id", "chunk_id", "rank").collect()))
    assert take(200) == take(2000)
    assert len(given) > 2 and given[1].count() < 1500 * 5
