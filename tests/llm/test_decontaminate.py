"""Decontamination against the oracle SQL and a word-by-word reading of the contract."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from packtables.llm import decontaminate as D
from tests.llm.oracle import arrow, same

SF = "/root/testdata/sf0.001"
DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_hit", pa.string())])
ITEMS = pa.schema([("item_id", pa.int64()), ("text", pa.string())])


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n=10):
    wins = set()
    for i, t in items:
        w = words(t)
        if w:
            wins |= {(("" if i is None else str(i)), tuple(w[k:k + n])) for k in range(max(1, len(w) - n + 1))}
    out = []
    for d, t in docs:
        w, hit, found, near = words(t), set(), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if sum(x != y for x, y in zip(w[k:k + len(win)], win)) <= (len(win) == n):
                    near.add(item)
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(item)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    vocab = ["the", "of", "a"] * 6 + [f"w{i}" for i in range(25)] + ["É", "é", "straße", "ÀB", "漢字"]
    sent = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, sent(rng.choice([12, 15, 30, 10]))) for i in range(12)]
    items += [(20, "w1 w2"), (21, "w3"), (22, None), (23, "!!"), (None, sent(11)), (24, items[0][1]), (0, items[1][1]),
              (25, "the the the the the the the the the the the")]
    docs = []
    for i in range(60):
        parts = [sent(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1] or ""
            w = w.split()
            a = rng.randrange(max(1, len(w) - 10))
            parts += [" ".join(w[a:a + rng.choice([5, 9, 10, 12, 40])]), sent(rng.randrange(4))]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts).upper() if i % 7 == 0 else "--".join(parts)))
    for j, (i, t) in enumerate(x for x in items[:12]):              # one word changed: at either end, rare, in no document
        w = t.split()
        w[(0, 9, 4, j % 10)[j % 4]] = ("the", "zz", f"only{j}")[j % 3]
        docs.append((200 + j, " ".join(w[:10]) + ("" if j % 2 else " the end")))
        docs.append((230 + j, " ".join(w[1:10])))
    items += [(40, "p1 p2 p3 p4 p5 p6 p7 p8 p9 nowhere"), (41, "q1 q2 absent q4 q5 q6 q7 q8 missing q10")]
    docs += [(250, "x p1 p2 p3 p4 p5 p6 p7 p8 p9 other"), (251, "p1 p2 p3 p4 p5 p6 p7 p8 p9"), (252, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10")]
    docs += [(100, None), (101, ""), (102, "?? !"), (5, docs[5][1]), (5, docs[5][1]), (None, docs[6][1]),
             (103, "the " * 3000 + items[3][1])]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark):
    docs, items = corpus()
    return (spark.createDataFrame([(a, b, "c") for a, b in docs], "doc_id long, text string, n_hit string").repartition(4),
            spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_contamination_matches_brute_force(frames, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast)
    got = sorted((tuple(r) for r in D.contamination(*frames).collect()), key=str)
    assert got == brute(*corpus())
    assert sum(r[-2] for r in got) > 20 and sum(r[-1] > r[3] for r in got) > 10
    assert {r[0]: r[-1] for r in got if r[0] in (250, 251, 252)} == {250: 1, 251: 0, 252: 0}


def test_oracle_sql(spark):
    docs, items = corpus()
    docs = [d for d in {d[0]: d for d in docs if d[0] is not None}.values()]
    items = [i for i in items if i[0] is not None]
    d, b = arrow([(*x, "c") for x in docs], DOCS), arrow(items, ITEMS)
    mine = D.contamination(spark.createDataFrame(d.to_pandas()), spark.createDataFrame(items, "item_id long, text string"))
    assert same(mine, D.ORACLE, documents=d, benchmark=b)


def test_oracle_on_given_tables(spark):
    mine = D.contamination(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert same(mine, D.ORACLE, documents=f"{SF}/documents.parquet", benchmark=f"{SF}/benchmark.parquet")


def test_empty_tables(frames):
    docs, items = frames
    assert D.contamination(docs.limit(0), items).collect() == []
    rows = D.contamination(docs, items.limit(0)).collect()
    assert len(rows) == docs.count() and not any(r.contaminated for r in rows)


def test_stage_keeps_clean_rows(frames):
    docs, items = frames
    kept = D.keep_uncontaminated(docs, items)
    assert kept.columns == docs.columns
    clean = [r[0] for r in brute(*corpus()) if not r[-2]]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, clean))


def test_proximity(spark):
    docs = [(1, "x alpha beta gap gap gamma delta y"), (2, "alpha beta gamma delta"), (3, "delta far away from alpha and beta and gamma"),
            (4, "alpha beta")]
    items = [(7, "alpha beta gamma delta")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.proximity(d, b, terms=4, slack=2).collect()) == [(1, "7"), (2, "7")]
    assert [r.doc_id for r in D.proximity(d, b, terms=4, slack=0).collect()] == [2]
