"""Pareto order sampling against a literal version, targets by hand, unequal importance, edge rows."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from packtables.llm import mixing as M
from packtables.llm.queries import op11_mixing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size string, target string"


def literal_targets(sizes, weights=(1, 2, 3), cap=3):
    """Reshare the excess one round at a time; ``sizes`` by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(cap * sizes[s] for s in fixed)) / max(1, sum(w[s] for s in free))
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return {s: min(level * w[s], cap * sizes[s]) for s in names}
        fixed |= over


def literal(rows, target):
    """Copies of each ``(source, size, u)`` with one probability for all of a source."""
    of, out = defaultdict(list), {}
    for i, (source, size, u) in enumerate(rows):
        of[source].append((i, size, u))
    for source, own in of.items():
        held = sum(size for _, size, _ in own)
        each = target[source] / held if held else 0.0
        whole, p = int(each), each - int(each)
        left, at = target[source] - whole * held, 0
        for i, size, u in sorted(own, key=lambda r: r[2] / (1 - r[2]) * (1 - p) / p if p else 0):
            at += size
            out[i] = whole + (p > 0 and size > 0 and at - size / 2 <= left)
    return out


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def compare(df, got):
    us = {(r.doc_id, r.source): r.u for r in df.select("doc_id", "source", M.random_unit(
        F.lit(M.SEED), F.col("doc_id"), F.col("source"), F.coalesce("text", F.lit(""))).alias("u")).collect()}
    rows = [(r.doc_id, r.source, size_of(r.text)) for r in df.collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    target = literal_targets(sizes)
    copies = literal([(s, n, us[d, s]) for d, s, n in rows], target)
    want = {d: (n, sizes[s], copies[i] * n) for i, (d, s, n) in enumerate(rows)}
    assert {r.doc_id: (r.size, r.source_size, r.taken) for r in got} == want
    assert all(r.target == pytest.approx(target[r.source]) for r in got)
    return target


def test_query_matches_literal_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op11_mixing(spark, SF).collect()
    target = compare(docs, got)
    taken, largest = Counter(), Counter()
    for r in got:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - t) <= largest[s] / 2 + 1e-6 for s, t in target.items())
    assert sum(target.values()) == pytest.approx(sum(r.size for r in got))
    assert sorted(got) == sorted(op11_mixing(spark, SF).collect())


def test_targets_reshare_until_none_is_above(spark):
    sizes = {"a": 1000, "b": 10, "c": 2, "d": 0, "\U0001F600": 40, "￿": 7, None: 500}
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = literal_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    assert got["c"] == 6 and got["d"] == 0 and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_edge_rows(spark):
    long = "word " * 30_000
    rows = [(i, f"w{i} x y z", "s" if i % 3 else None, "c", "c") for i in range(200)]
    rows += [(500, None, "s", "c", "c"), (501, " \n", "empty", "c", "c"), (502, long, "long", "c", "c")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    compare(df, M.allocation(df).collect())
    assert M.allocation(df.limit(0)).collect() == [] and M.mixture(df.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, "", "a", "", ""), (2, None, None, "", "")], SCHEMA)
    assert [tuple(r)[1:5] for r in M.allocation(blank).collect()] == [(0, 0, 0.0, 0)] * 2


def test_repeated_rows_are_drawn_one_by_one(spark):
    """A source of equal rows, ids null, meets its target as closely as one of different rows."""
    rows = [(None, "a b", "one", "", "")] * 300 + [(i, "a b c d e", "two", "", "") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    taken, target = Counter(), {}
    for r in M.allocation(df).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)


def test_mixture_repeats_the_rows_as_allocated(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("row_number", F.lit("x"))
    copies = {r.doc_id: r.copies for r in M.allocation(df).collect()}
    mix = M.mixture(df)
    assert mix.columns == df.columns
    assert Counter(r.doc_id for r in mix.select("doc_id").collect()) == Counter({d: n for d, n in copies.items() if n})


def test_importance_gives_unequal_inclusion(spark):
    """Inclusion follows the importance: shares over many seeds, with the sum of words fixed every time."""
    rows = [(i, "w " * 10, "s", "", "") for i in range(60)] + [(100 + i, "w " * 10, "t", "", "") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1).cache()
    weight = F.when(F.col("doc_id") % 100 < 20, 3).when(F.col("doc_id") % 100 < 40, 1).otherwise(None)
    taken = Counter()
    for seed in range(6):
        got = M.allocation(df, weights=(1,), importance=weight, seed=seed).collect()
        words = Counter()
        for r in got:
            taken[min(2, r.doc_id % 100 // 20)] += r.copies
            words[r.source] += r.taken
            assert r.copies <= 3
        assert all(abs(words[s] - 600) <= 10 for s in "st")
    assert taken[2] == 0 and taken[0] / taken[1] == pytest.approx(3, rel=0.12)
    df.unpersist()
