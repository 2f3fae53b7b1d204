"""Closed-form trim (B1) and the halving ladder (B3) against literal loops."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packtables.operators.budget import apply_budget, halving_ladder


def greedy(base, deltas, budget):
    current = base + sum(deltas)
    applied = []
    for d in deltas:
        if current > budget:
            applied.append(True)
            current -= d
        else:
            applied.append(False)
    return applied, current


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(-20, 200), min_size=0, max_size=12), min_size=1, max_size=6),
       st.integers(0, 50), st.integers(0, 600))
def test_closed_form_equals_greedy(spark, ladders, base, budget):
    rows = [(p, i, d, base) for p, ds in enumerate(ladders) for i, d in enumerate(ds)]
    if not rows:
        return
    df = spark.createDataFrame(rows, "pack long, ord long, delta long, base long")
    got = {(r.pack, r.ord): (r.applied, r.final_tokens)
           for r in apply_budget(df, ["pack"], ["ord"], budget=budget).collect()}
    for p, ds in enumerate(ladders):
        applied, final = greedy(base, ds, budget)
        for i, a in enumerate(applied):
            assert got[(p, i)] == (a, final)


def halving_loop(body):
    lines = body.split("\n")
    out = [body]
    while len(lines) > 5:
        lines = lines[:len(lines) // 2]
        out.append("\n".join(lines) + "\n  // ... trimmed")
    return out


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 200))
def test_halving_ladder(spark, n):
    body = "\n".join(f"line {i}" for i in range(n)) if n else ""
    df = spark.createDataFrame([(body,)], "b string")
    got = df.select(halving_ladder(F.col("b")).alias("v")).first().v
    assert got == (halving_loop(body) if body else [body])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(-20, 200), min_size=0, max_size=40), min_size=1, max_size=4),
       st.integers(0, 50), st.integers(0, 900))
def test_scan_equals_greedy(spark, ladders, base, budget):
    """The split-pack scan gives the greedy answer even when packs span many blocks."""
    rows = [(p, i, d, base) for p, ds in enumerate(ladders) for i, d in enumerate(ds)]
    if not rows:
        return
    df = spark.createDataFrame(rows, "pack long, ord long, delta long, base long")
    res = apply_budget(df, ["pack"], ["ord"], budget=budget, method="scan", num_blocks=7)
    got = {(r.pack, r.ord): (r.applied, r.final_tokens) for r in res.collect()}
    for p, ds in enumerate(ladders):
        applied, final = greedy(base, ds, budget)
        for i, a in enumerate(applied):
            assert got[(p, i)] == (a, final)


def test_running_sum_hot_key(spark):
    """One key holds most rows; the split-block running sum equals a plain cumulative sum."""
    from packtables.operators.scan import running_sum

    rows = [("hot", i, (i * 7) % 5) for i in range(300)] + [(f"k{j}", i, 1) for j in range(5) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r.k, r.o): r.s for r in running_sum(df, ["k"], ["o"], "v", "s", num_blocks=9).collect()}
    exp, acc = {}, {}
    for k, o, v in sorted(rows):
        acc[k] = acc.get(k, 0) + v
        exp[(k, o)] = acc[k]
    assert got == exp
