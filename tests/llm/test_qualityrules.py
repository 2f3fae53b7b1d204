"""Rule ledger against the oracle SQL and brute force; policies and ablations."""

import random
import re

from packtables.llm import qualityrules as Q
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(w), len(covered)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n)


def texts():
    rng = random.Random(8)
    vocab = ["a", "bb", "c#", "É*", "漢", "|", "Word", "x<y>"]
    out = [rng.choice([" ", "\n", "\t", " \n "]).join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 60, 90]))) for _ in range(150)]
    out += [None, "", " \n\t", "same line\nsame line\n same line\n\n\n", "\x1c \x85 \xa0x", "w " * 30_000, "🙂 " * 60]
    out += [" ".join(f"w{i}" for i in range(120)), "A B C D " * 4 + " ".join(f"v{i}" for i in range(100))]
    return out


def test_measurements_match_brute_force(spark):
    rows = [(i, t, "c") for i, t in enumerate(texts())] + [(3, texts()[3], "c"), (None, "a b c a b c", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3)
    got = sorted((tuple(r)[:7] for r in Q.verdicts(df).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t, _ in rows), key=str)
    assert Q.verdicts(df.limit(0)).collect() == []


def test_oracle_on_given_tables(spark):
    assert same(Q.verdicts(spark.read.parquet(f"{SF}/documents.parquet")), Q.ORACLE, documents=f"{SF}/documents.parquet")


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.verdicts(docs).filter("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / max(1, len(bad)) < 0.3


def test_policies_and_ablations(spark):
    bits = [0, 1, 2, 3, 4, 5, 64, 64, 68]
    df = spark.createDataFrame([(b,) for b in bits], "failed long")
    assert sum(r.kept for r in Q.apply_policy(df, "base").collect()) == sum(not b & 3 for b in bits)
    assert sum(r.kept for r in Q.apply_policy(df, 64).collect()) == sum(not b & 64 for b in bits)
    mask = Q.POLICIES["v1"]
    got = {r.rule: tuple(r)[1:] for r in Q.ablations(df, "v1").collect()}
    for name, bit in Q.BIT.items():
        assert got[name] == (sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits), sum(not b & mask & ~bit for b in bits))


def test_policy_report(spark):
    bits = [0, 1, 2, 3, 4, 5, 64, 64, 68]
    df = spark.createDataFrame([(b,) for b in bits], "failed long")
    rows = Q.policy_report(df).collect()
    for policy, mask in Q.POLICIES.items():
        mine = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in rows if r.policy == policy}
        assert mine == {r.rule: tuple(r)[1:] for r in Q.ablations(df, policy).collect()}
        assert {(r.n_kept, r.n_rows) for r in rows if r.policy == policy} == {(sum(not b & mask for b in bits), len(bits))}
    assert Q.policy_report(df.limit(0)).collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert same(Q.policy_report(Q.ledger(docs)), Q.ABLATIONS_ORACLE, documents=f"{SF}/documents.parquet")


def test_native_plan(spark):
    plan = Q.verdicts(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
