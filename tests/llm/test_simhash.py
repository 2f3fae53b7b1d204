"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from packtables.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 2:
                label[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {k: min([x for x in v if x is not None], default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], f"{fp[i]:016x}", least[root(i)]) for i in range(len(rows))), key=str)


def corpus(n=160):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "ÀB", "ẞx"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = (rows[rng.randrange(len(rows))][1] or "x").split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 40, 200]))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, " a"), (5, rows[5][1]), (None, rows[6][1]), (None, "only null id")]
    return rows


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=str)
    assert got == brute_components(rows)


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_fingerprint():
    text = " ".join(f"t{i % 9973}" for i in range(70_000))
    assert S.fingerprint(text) == brute_fingerprint(text)


def clusters(n, seed=3):
    """Fingerprints with links: random ones, and balls of near ones around some centres."""
    rng = np.random.default_rng(seed)
    x = list(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    for c in x[:20]:
        for _ in range(30):
            y = c
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                y ^= np.uint64(1) << np.uint64(b)
            x.append(y)
    return np.unique(np.array(x, np.uint64))


def brute_roots(x):
    pairs = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)
    return S.forest(np.stack([x[pairs[:, 0]], x[pairs[:, 1]]]))


def same_components(x, links):
    as_sets = lambda f: sorted(map(sorted, _groups(x, f)))
    return as_sets(links) == as_sets(brute_roots(x))


def _groups(x, star):
    up = {int(a): int(b) for a, b in star.T}
    out = {}
    for v in map(int, x):
        out.setdefault(up.get(v, v), []).append(v)
    return out.values()


def test_local_tree_finds_every_link():
    x = clusters(3000)
    assert same_components(x, S.cell_forest(x, x[:0], 2, leaf=32))


@pytest.mark.parametrize("cell", [65_536, 100])
def test_sharded_tree_finds_every_link(spark, monkeypatch, cell):
    """Small shards, boundary copies, and (second case) shards cut into a grid."""
    monkeypatch.setattr(S, "SHARD", 256)
    monkeypatch.setattr(S, "CELL", cell)
    monkeypatch.setattr(S, "SAMPLE", 700)
    x = clusters(2500)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").repartition(4)
    rows = S.fingerprint_links(df).collect()
    links = np.array([(r.a, r.b) for r in rows], np.int64).T.view(np.uint64)
    assert same_components(x, S.forest(links))
    assert len(rows) < 4 * len(x)      # forests, not all pairs


def test_components_of_chains(spark):
    """A path and a star: the labels reach the ends."""
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1040)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 1000 for i in range(1001, 1040)}}


def test_deduplicate_keeps_one_row_of_each_component(spark):
    rows = corpus() + [(2000, "same row"), (2000, "same row"), (None, "nul row"), (None, "nul row")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, text_key string").repartition(3)
    out = S.deduplicate(df)
    assert out.columns == ["doc_id", "text", "text_key"]
    want = sorted({c for _, _, c in brute_components(rows) if c is not None})
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == want
    n_null = len({f for _, f, c in brute_components(rows) if c is None})
    assert got.count(None) == n_null
