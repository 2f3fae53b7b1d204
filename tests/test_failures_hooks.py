"""Error rows (R8, U1), bounded kNN ties (J12), pack reuse (T5 + B7), counter and scanner hooks (U2, U3), null packs (B1)."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from packtables.functions.tokens import TOKEN_PATTERN, TokenCounter, count_tokens
from packtables.operators import vectors
from packtables.operators.budget import apply_budget
from packtables.plans import registry as R

SF = "/root/testdata/sf0.001"


def test_failing_strategies_give_error_rows(spark):
    """One that fails when planned and one that fails at run time: two error rows, all other entries."""
    from packtables.plans.strategies import Strategy, entries, pos, run_strategies, strategy_errors

    inp = R.strategy_inputs(spark, SF)

    def late(sig, inp, opts):
        bad = sig.select("request_id", "repo_id", F.raise_error(F.lit("late failure")).cast("string").alias("content"))
        return entries(bad, "conventions", pos=pos(0, 1))

    def early(sig, inp, opts):
        raise RuntimeError("early failure")

    errors = []
    out = run_strategies(inp, R.OPTS, extra=[Strategy("late", F.lit(True), late), Strategy("early", F.lit(True), early)],
                         materialize=True, errors=errors)
    assert out.count() == run_strategies(inp, R.OPTS).count()
    got = {r.strategy: r.error for r in strategy_errors(spark, errors).collect()}
    assert set(got) == {"late", "early"} and "early failure" in got["early"]


def test_failing_embedding_batches_give_errors(spark):
    def embedder():
        def embed(texts):
            if "bad" in texts:
                raise ValueError("no vector")
            return [[1.0, 2.0]] * len(texts)
        return embed

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, text string").repartition(2, "id")
    rows = {r.id: (r.embedding, r.embedding_error) for r in vectors.embed_checked(df, "text", embedder=embedder).collect()}
    assert rows[2][0] is None and "no vector" in rows[2][1]
    good = vectors.embed_column(df, "text", embedder=embedder)
    assert good.columns == ["id", "text", "embedding"] and 2 not in {r.id for r in good.collect()}


def test_equal_vectors_are_bounded_by_k(spark):
    """Many equal chunks: k rows a query and block, smallest ids first; groups with the same ids stay apart."""
    pdf = vectors._local_topk(3, False, "g")
    import pandas as pd

    q = pd.DataFrame({"g": "a", "query_id": [1, 2], "vec": [np.zeros(2), np.ones(2)]})
    c = pd.DataFrame({"g": "a", "chunk_id": np.arange(5000)[::-1], "vec": [np.ones(2)] * 5000})
    out = pdf(q, c)
    assert len(out) == 6 and sorted(set(out["chunk_id"])) == [0, 1, 2]
    qs = spark.createDataFrame([("a", 1, [0.0, 0.0]), ("b", 1, [5.0, 5.0])], "g string, query_id long, vec array<double>")
    cs = spark.createDataFrame([("a", 1, [0.0, 1.0]), ("b", 1, [5.0, 5.0]), ("b", 2, [0.0, 0.0])], "g string, chunk_id long, vec array<double>")
    got = {(r.g, r.query_id, r.chunk_id, r["rank"]) for r in vectors.knn_pairs(qs, cs, 2, group="g").collect()}
    assert got == {("a", 1, 1, 1), ("b", 1, 1, 1), ("b", 1, 2, 2)}


def test_budget_keeps_null_packs(spark):
    rows = [(k, i, 10) for k in ("a", None) for i in range(30)]
    df = spark.createDataFrame(rows, "pack string, i long, delta long").withColumn("base", F.lit(0))
    for method in ("window", "scan"):
        out = apply_budget(df, ["pack"], ["i"], budget=100, method=method, **({"num_blocks": 4} if method == "scan" else {})).collect()
        assert len(out) == 60
        assert {(r.pack, r.final_tokens) for r in out} == {("a", 100), (None, 100)}


def test_packs_are_reused_within_the_ttl(spark):
    """Equal prompts of a repository share a pack for the TTL; the one compile serves the others."""
    from dataclasses import replace

    from packtables.plans.packs import compile_packs
    from packtables.streaming.requests import compile_reusing

    inp = R.strategy_inputs(spark, SF)
    one = inp.signals.orderBy("request_id").limit(2)
    t0 = dt.datetime(2024, 1, 1)
    times = spark.createDataFrame([(0, t0), (1, t0 + dt.timedelta(seconds=100)), (2, t0 + dt.timedelta(seconds=500))], "copy long, ts timestamp")
    many = one.join(times).withColumn("request_id", F.col("request_id") * 10 + F.col("copy")).drop("copy")
    vec = inp.query_vectors.join(times.select("copy")).withColumn("request_id", F.col("request_id") * 10 + F.col("copy")).drop("copy")
    got = {r.request_id: r for r in compile_reusing(replace(inp, signals=many, query_vectors=vec), R.OPTS).collect()}
    assert len(got) == 6
    assert all(got[i].compiled == (i % 10 != 1) and got[i].served_by == i - (i % 10 == 1) for i in got)
    assert all(got[i].xml == got[i - 1].xml for i in got if i % 10 == 1)
    plain = {r.request_id: r.n_entries for r in compile_packs(inp, R.OPTS).collect()}     # token counts differ by the pack id
    assert all(got[i].n_entries == plain[i // 10] for i in got)


def test_counter_hook_changes_the_budget(spark):
    from dataclasses import replace

    from packtables.plans.packs import compile_packs

    import re

    double = TokenCounter(lambda c: count_tokens(c) * 2, lambda a: F.transform(a, lambda c: count_tokens(c) * 2),
                          lambda t: 2 * len(re.findall(TOKEN_PATTERN, t)))
    inp = R.strategy_inputs(spark, SF)
    base = {r.request_id: r.token_count for r in compile_packs(inp, R.OPTS).collect()}
    twice = {r.request_id: r.token_count for r in compile_packs(inp, replace(R.OPTS, counter=double)).collect()}
    assert all(twice[i] == 2 * n for i, n in base.items() if 2 * n <= R.OPTS.max_pack_tokens)      # nothing was dropped
    assert all(n <= R.OPTS.max_pack_tokens for n in twice.values()) and any(2 * n <= R.OPTS.max_pack_tokens for n in base.values())


def test_bpe_counter(spark):
    import pytest

    P = pytest.importorskip("public_tokenizers")
    from packtables.functions.tokens import bpe_counter

    c = bpe_counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = spark.createDataFrame([("Hello world", ["a b", None, ""])], "t string, a array<string>").select(c.one("t").alias("t"), c.many("a").alias("a")).first()
    assert (r.t, r.a) == (2, [2, 0, 0]) and c.literal("Hello world") == 2


def test_scanner_hook(spark):
    from packtables.operators import code

    files = spark.createDataFrame([("r", "a.rs", "rust", "fn x")], "repo_id string, path string, lang string, content string")
    rows = code.extract(files, scanners={"rust": lambda text: [dict(tag="symbol", name=text.split()[1], kind="function", start_line=1, end_line=1, col=0)]})
    assert [r.name for r in code.symbols_of(rows).collect()] == ["x"]


def test_definitions_are_ordered(spark):
    from packtables.operators.code import definitions

    s = spark.createDataFrame([("r", "run", f"f{i % 7}.py", i, 0, "function") for i in range(200)] + [(None, "x", "a.py", 1, 0, "class")],
                              "repo_id string, name string, path string, start_line int, col int, kind string")
    got = [(r.path, r.start_line) for r in definitions(s).filter("name = 'run'").orderBy("rank").collect()]
    assert got == sorted(got) and len(got) == 200 and definitions(s).count() == 201


def test_failing_jobs_of_built_in_strategies_raise(spark, monkeypatch):
    """A job that is aborted raises; a frame that cannot be built is listed, and the registered query raises for it."""
    import pytest

    from packtables.plans import strategies as T

    inp = R.strategy_inputs(spark, SF)

    def late(sig, *_):
        bad = sig.select("request_id", "repo_id", F.raise_error(F.lit("late failure")).cast("string").alias("content"))
        return T.entries(bad, "symbols", pos=T.pos(0, 1))

    def early(sig, *_):
        return sig.select("no_such_column")

    for name in ("symbol_strategy", "file_expand_strategy", "semantic_hits"):
        with monkeypatch.context() as m:
            m.setattr(T, name, late)
            with pytest.raises(Exception, match="late failure"):
                T.run_strategies(inp, R.OPTS, materialize=True)
    monkeypatch.setattr(T, "symbol_strategy", early)
    errors = []
    T.run_strategies(inp, R.OPTS, errors=errors)
    assert [name for name, _ in errors] == ["symbol"]
    monkeypatch.delattr(R.fixture(spark, SF), "packs", raising=False)
    with pytest.raises(RuntimeError, match="symbol"):
        R.compiled_packs(spark, SF)


def test_failed_embedding_batches_stay_in_the_index(spark, tmp_path):
    """A stored build tells which chunks have no vector and why; the next build embeds them."""
    from packtables.operators.code import language_of
    from packtables.plans.index import build_index

    files = spark.createDataFrame([("r", "a.py", "def good():\n    return 1\n"), ("r", "b.py", "def bad():\n    return 2\n")],
                                  "repo_id string, path string, content string").withColumn("lang", language_of("path")).repartition(2, "path")

    def picky():
        def embed(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no vector for this one")
            return [[1.0, 2.0]] * len(texts)
        return embed

    idx = build_index(files, path=str(tmp_path / "idx"), embedder=picky, num_partitions=8)
    kept, failed = {r.path for r in idx.vectors.collect()}, {(r.path, r.error) for r in idx.errors.collect()}
    assert kept | {p for p, _ in failed} == {"a.py", "b.py"} and ("b.py", "ValueError: no vector for this one") in failed
    again = build_index(files, path=str(tmp_path / "idx"), dim=2)
    assert {r.path for r in again.vectors.collect()} == {"a.py", "b.py"} and again.errors.count() == 0
