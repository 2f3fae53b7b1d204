"""What the retrieval queries gather, build and send as their tables grow."""

import numpy as np

from packtables.operators import vectors
from packtables.operators.lookup import GramIndex, containing, first_containing
from packtables.plans import registry as R


def tables(spark, folder, n=400):
    """Few bytes of keys that stand for many texts: parts, events, conversations and the rest of a folder."""
    rows = {"part": spark.range(n).selectExpr("id as p_partkey"),
            "events": spark.range(3 * n).selectExpr("id as event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, int(id)) as ts", f"id % {n} as user_id",
                                                    "case id % 4 when 0 then 'signup' when 1 then 'error' else 'view' end as event_type"),
            "conversations": spark.range(40).selectExpr("id as conv_id", "0L as turn", "'user' as role", "'rename Cls1 please' as text"),
            "embeddings": spark.range(20).selectExpr("id as vec_id", "int(id % 5) as label", "array(float(id), float(1)) as embedding")}
    for name, df in rows.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_join_side_is_gathered_by_its_estimate(spark, tmp_path):
    """the files' few key bytes stand for their texts, so the change feed must not plan a broadcast of them."""
    fx = R.fixture(spark, tables(spark, tmp_path))
    assert "Broadcast" not in plan(fx.changes) and "SortMergeJoin" in plan(fx.changes)
    assert fx.changes.count() == 1200 and fx.changes.filter("content is not null").count() == 900
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert before != "-1" and fx.spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == before      # the caller's session is as it was
    assert fx.spark.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


def test_texts_are_not_gathered_by_their_estimate(spark, tmp_path):
    """entries meet contents and definitions without a planned broadcast of these."""
    from packtables.plans.strategies import file_expand_strategy, symbol_strategy

    inp = R.strategy_inputs(spark, tables(spark, tmp_path))
    for e in (file_expand_strategy(inp.signals, inp.index, R.OPTS), symbol_strategy(inp.signals, inp.index, R.OPTS)):
        first = plan(e.select("request_id", "path", "content", "body"))
        gathered = [x for x in first.split("\n") if "BroadcastHashJoin" in x]
        assert "SortMergeJoin" in first and all("_g#" in x for x in gathered)     # n-grams of mentions alone, up to a size that is counted
        assert e.count() > 0


def test_inputs_are_built_by_the_query_that_reads_them(spark, tmp_path):
    """F16: routes come from the signals alone, without extraction, vectors or commits."""
    folder = tables(spark, tmp_path)
    assert R.QUERIES["routing"](spark, folder).filter("strategy = 'blast_radius'").count() == 40
    assert not {"index", "chunks", "qvec", "commits"} & set(R.fixture(spark, folder)._cache)


def test_long_needles_have_rare_grams(spark):
    """a path is looked up by long n-grams, which few others hold; needles of any length find all they are in."""
    hay = [f"pkg{i % 20}/mod_{i}.py" for i in range(3000)]
    h = spark.createDataFrame([("r", p) for p in hay], "repo_id string, path string")
    index = GramIndex(h, "path")
    mention = "pkg3/mod_1203.py"
    freq = {r["_g"]: r["count"] for r in index.grams([3, 12]).groupBy("_g").count().collect()}
    held = lambda k: min(freq[mention[i:i + k]] for i in range(len(mention) - k + 1))
    assert held(12) == 1 < 10 < held(3)
    needles = [mention, "9/mod_29", "mod_1203.py", "mod_299", "3.p", "py", "q", "pkg3/mod_1203.pyx", "pkg1", ""]
    n = spark.createDataFrame([("r", x) for x in needles] + [("other", "py"), (None, "py"), ("r", None)], "repo_id string, mention string")
    got = [(r.mention, r.path) for r in containing(n, needle="mention", value="path", index=index).collect()]
    assert sorted(got) == sorted((x, p) for x in needles for p in hay if x and x in p)
    first = {r.mention: r.match for r in first_containing(n, needle="mention", value="path", order="path", index=index).collect()}
    assert first == {x: min(p for p in hay if x in p) for x in needles if x and any(x in p for p in hay)}


def test_search_rows_carry_no_vectors_between_visits(spark):
    """A leaf is as large as a block and cells are cut no finer; rows of a query and a leaf are without vectors."""
    rng = np.random.default_rng(5)
    c = rng.normal(size=(900, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(c)]
    cd = spark.createDataFrame(rows, "chunk_id long, vec array<double>")
    qd = spark.createDataFrame(rows[:50] + rows[:2], "query_id long, vec array<double>")      # ids may repeat
    visits = []
    got = {(r.query_id, r["rank"]): r.chunk_id for r in vectors.knn_pairs(qd.limit(50), cd, 4, leaf_rows=300, visits=visits).collect()}
    for i in range(50):
        d = np.sqrt(((c - c[i]) ** 2).sum(axis=1))
        assert [got[(i, r)] for r in range(1, 5)] == sorted(range(900), key=lambda j: (round(d[j], 9), j))[:4]
    assert len(visits) >= 2 and all("vec" not in v.columns for v in visits[1:])
    tree = vectors.cell_tree(vectors._sides(qd, cd, None)[1], leaf=300)
    assert tree.levels[0].count() <= 6              # 900 rows are three leaves, not sixteen
    assert vectors.LEAF >= 65_536
    assert vectors.knn_pairs(qd, cd, 4, leaf_rows=300).count() == 50 * 4
