"""Target-distribution importance resampling: documents whose word runs look like a target's are drawn without replacement.

* Every run of 1 or 2 words is hashed to one of ``BUCKETS`` numbers (crc32). A document's numbers are kept as an array, in
  a written table, so texts are split once. Corpus and target counts by bucket are partial sums of the exploded arrays.
* A bucket's gain is the logarithm of the ratio of its smoothed shares; a document's weight is the mean of the gains that
  its array points at, and its score adds Gumbel noise from a hash of its id, so the highest scores are a draw without
  replacement by weight.
* The k-th highest composite key (score falling, id, features) is found by distributed quickselect: each round draws a few
  random pivot keys from the rows still in question (by a hash threshold from their exact count), counts the rows on either
  side of each pivot and at it, and narrows to the part that holds the k-th key, until a pivot is that key. A round
  returns two counts for each pivot.
* The winners alone are range-partitioned by the key, sorted and ranked by prefix sums; the others keep a null rank.

Defined results: a null text has no words, and no words mean weight 0; texts of fewer than ``LEAST_WORDS`` words are scored
but never drawn; equal keys (rows that repeat) are drawn as far as the number goes, any of them; null ids come after all
others; an empty target gives gains of the corpus's shares against even ones; an empty table gives an empty table; extra
columns are ignored by ``resample`` and kept by ``drawn``. Texts are taken whole: a row holds two 16-bit numbers for each
word, and its words while they are hashed, so about 50 million words in one text reach Spark's row limit of 2 GiB.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packtables.llm.common import free_name, numbered, written
from packtables.llm.decontaminate import words
from packtables.operators.scan import running_sum

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
PIVOTS = 15             # expected number of pivot keys of a round


def _bucket(feature: Column) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(BUCKETS)).cast("short")


def bucketed(texts: DataFrame) -> DataFrame:
    """``texts`` with ``n_words`` and ``buckets``, one number for each run of 1 or 2 words, in place of ``text``."""
    kept = [c for c in texts.columns if c != "text"]
    w = texts.select(*kept, words(F.col("text")).alias("w"))
    pairs = F.transform(F.slice("w", F.lit(2), F.size("w")), lambda x, i: _bucket(F.concat_ws(" ", F.get("w", i), x)))
    return w.select(*kept, F.size("w").cast("long").alias("n_words"), F.concat(F.transform("w", _bucket), pairs).alias("buckets"))


def counts(rows: DataFrame) -> dict[int, int]:
    """Features of each bucket over all rows: at most ``BUCKETS`` numbers."""
    return {r.b: r.n for r in rows.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int]) -> list[int]:
    """1000 times the logarithm of the ratio of smoothed shares of each bucket, floored."""
    all_s, all_t = sum(corpus.values()), sum(target.values())
    ratio = lambda b: (target.get(b, 0) + 1.0) * (all_s + BUCKETS) / ((corpus.get(b, 0) + 1.0) * (all_t + BUCKETS))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(BUCKETS)]


def scored(rows: DataFrame, by_bucket: list[int], seed: int = SEED) -> DataFrame:
    """``rows`` with ``n_features``, ``weight`` and ``score`` in place of the arrays."""
    table = F.split(F.lit(",".join(map(str, by_bucket))), ",").cast("array<int>")     # folded to one constant of fixed size
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b.cast("int")))
    n = F.size("buckets").cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    r = rows.withColumn("n_features", n).withColumn("total", total).drop("buckets")
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return r.withColumn("weight", mean).withColumn("score", F.col("weight") + noise).drop("total")


def _key() -> Column:
    """The composite key, best first."""
    return F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("n_features").alias("f"))


def _constant(key, kind) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, kind.fields)])


def kth_key(keys: DataFrame, k: int, seed: int = SEED) -> tuple | None:
    """The ``k``-th smallest value of the struct column ``key`` (from 1), or None if there are fewer rows."""
    kind = keys.schema["key"].dataType
    low, high, left, n = None, None, k, keys.count()
    if not 0 < k <= n:
        return None
    sure, turn = 1, 0
    while True:
        part = keys
        if low is not None:
            part = part.filter(F.col("key") > _constant(low, kind))
        if high is not None:
            part = part.filter(F.col("key") < _constant(high, kind))
        # about PIVOTS distinct keys by a threshold on their 63-bit hash; a key that many rows share is one key
        chance = min(1.0, PIVOTS * sure / n)
        picked = part if chance == 1.0 else part.filter(
            F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(turn), "key"), 1) < F.lit(int(chance * (2 ** 63 - 1))))
        found = [tuple(r.key) for r in picked.select("key").distinct().collect()]
        turn += 1
        if not found:
            sure *= 2       # few distinct keys: the threshold rises until one is met
            continue
        sure = 1
        pivots = sorted(found, key=lambda p: (p[0], p[1], p[2] if p[2] is not None else 0, p[3]))
        sums = []
        for i, p in enumerate(pivots):
            at = _constant(p, kind)
            sums += [F.count_if(F.col("key") < at).alias(f"less{i}"), F.count_if(F.col("key") == at).alias(f"same{i}")]
        row = part.agg(*sums).first()
        less_before = 0
        for i, p in enumerate(pivots):
            less, same = row[f"less{i}"], row[f"same{i}"]
            if left <= less:
                high, n = p, less - less_before
                left -= less_before
                break
            if left <= less + same:
                return p
            low, less_before = p, less + same
        else:
            n, left = n - less_before, left - less_before


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, n_features, weight, score, rank`` (null: not drawn), ``n_words`` and the columns ``keep``."""
    rows = written(bucketed(docs.select("doc_id", "text", *keep)), "buckets")
    by_bucket = gains(counts(rows), counts(bucketed(target.select("text"))))
    s = scored(rows, by_bucket, seed).withColumn("row", F.monotonically_increasing_id())
    s = written(s, "scores")
    able = s.filter(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    cut = kth_key(able.select(_key().alias("key")), k, seed)
    out = ["doc_id", "n_features", "weight", "score", "rank", "n_words", *keep]
    if cut is None:
        return s.withColumn("rank", F.lit(None).cast("long")).select(*out)
    last = _constant(cut, able.select(_key().alias("key")).schema["key"].dataType)
    wins = (F.col("n_words") >= least_words) & (_key() <= last)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", F.xxhash64("row"), "row"]
    ranked = running_sum(s.filter(wins).withColumn("_g", F.lit(0)), ["_g"], order, F.lit(1).cast("long"), "place")
    ranked = ranked.withColumn("rank", F.when(F.col("place") <= k, F.col("place")))      # equal keys may go past the k-th
    return ranked.select(*out).unionByName(s.filter(~wins).withColumn("rank", F.lit(None).cast("long")).select(*out))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs``, with ``rank`` (underscores in front if a column has that name)."""
    number, rank = free_name(docs, "row_number"), free_name(docs, "rank")
    stored = numbered(docs, number)
    wins = resample(stored, target, percent, least_words, seed, keep=(number,)).filter("rank is not null")
    return stored.join(wins.select(number, F.col("rank").alias(rank)), number).drop(number)
