"""Quality rules as a bitmask ledger (DataFrame operations only).

``ledger`` evaluates every rule once: each row keeps its measurements and one
long whose bits are the rules it fails. A policy is a versioned set of rules; it
is applied to the bits alone, and ``ablations`` tells from counts of the distinct
bit patterns (bitwise aggregation) what each rule of a policy does.

Repeated 3-word windows are found inside a row: windows are sorted with their
positions and compared with their neighbours, so a long text costs n log n.

Defined results: a null text counts as empty; an empty text has 0 words and
fails ``few_words``; repeated rows are judged one by one; an empty table gives
an empty ledger; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packtables.llm.common import free_name

SPACE = " \t\n\x0b\x0c\r"

#: Name and condition of each rule, over the measurements; the bit is the place in this list.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "2 * word_chars < 5 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("shouting", "100 * n_capitals > 50 * word_chars"),
    ("digits", "100 * n_digits > 30 * word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versioned policies: the rules whose failure drops a document. Published versions never change.
POLICIES = {
    "base": BASE,
    "v1": sum(BIT.values()),
}


def _without(text: Column, pattern: str) -> Column:
    """How many characters of ``text`` match a character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of each text."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    t = t.select("doc_id", "t", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("w"),
                 F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0).alias("lines"))
    windows = F.when(F.size("w") >= 3, F.transform(
        F.slice("w", F.lit(1), F.size("w") - 2),
        lambda x, i: F.struct(F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2)).alias("s"), i.alias("i"))))
    t = t.withColumn("wins", F.sort_array(windows))
    same = lambda x, y: F.coalesce(x["s"] == y["s"], F.lit(False))
    again = F.filter("wins", lambda x, j: same(x, F.get("wins", j - 1)) | same(x, F.get("wins", j + 1)))
    t = t.withColumn("at", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    numbers = F.struct(
        F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _without(F.col("t"), r"[#*$%&|<>]+").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        _without(F.col("t"), r"\p{Lu}+").alias("n_capitals"), _without(F.col("t"), r"[0-9]+").alias("n_digits"))
    # a generator: the optimizer doesn't copy what is below it into each use of a number above it
    return t.select("doc_id", F.inline(F.array(numbers)))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed``, the bits of the rules that each row fails."""
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: str | int) -> DataFrame:
    """``rows`` of a ledger with ``kept`` under a policy (a version or a mask)."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return rows.withColumn(free_name(rows, "kept"), F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablations(rows: DataFrame, policy: str | int) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail it alone, and rows kept without it."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(b).cast("long").alias("bit")) for k, b in BIT.items() if b & mask])
    flat = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    others = F.lit(mask).cast("long").bitwiseXOR(F.col("bit"))
    return flat.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(others) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"))


def policy_report(rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """``ablations`` of several policy versions from one table of bit patterns, with the rows that each policy keeps.

    The ledger is read once; its patterns are at most 2 to the number of rules. An empty ledger gives no rows.
    """
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    cells = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(POLICIES[p]).cast("long").alias("mask"), F.lit(k).alias("rule"),
                               F.lit(b).cast("long").alias("bit")) for p in policies for k, b in BIT.items() if b & POLICIES[p]])
    flat = patterns.select("failed", "n", F.inline(cells))
    bits, bit = F.col("failed").bitwiseAND(F.col("mask")), F.col("bit")
    others = F.col("mask").bitwiseXOR(bit)

    def rows_where(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    return flat.groupBy("policy", "rule").agg(
        rows_where(bits.bitwiseAND(bit) != 0, "n_failed"), rows_where(bits == bit, "n_failed_alone"),
        rows_where(bits.bitwiseAND(others) == 0, "n_kept_without"), rows_where(bits == 0, "n_kept"), F.sum("n").alias("n_rows"))


def verdicts(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger's counts with ``base_failed`` and ``kept``."""
    rows = ledger(docs)
    base = F.col("failed").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return apply_policy(rows, POLICIES[policy] | BASE).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


_LEDGER = r"""
WITH d AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN (
      SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1) USING (doc_id, s))
  GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_capitals,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits
  FROM d LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
           + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
           + CASE WHEN 2 * word_chars < 5 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 14 * n_words THEN 32 ELSE 0 END
           + CASE WHEN 100 * n_capitals > 50 * word_chars THEN 64 ELSE 0 END + CASE WHEN 100 * n_digits > 30 * word_chars THEN 128 ELSE 0 END
           AS BIGINT) AS failed
  FROM m
)
"""

ORACLE = _LEDGER + r"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""

ABLATIONS_ORACLE = _LEDGER + r"""
, p(policy, mask) AS (
  VALUES ('base', 3), ('v1', 255)
), r(rule, bit) AS (
  VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32),
         ('shouting', 64), ('digits', 128)
)
SELECT policy, rule, count(*) FILTER (WHERE failed & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed & mask = bit) AS n_failed_alone,
       count(*) FILTER (WHERE failed & mask & ~bit = 0) AS n_kept_without, count(*) FILTER (WHERE failed & mask = 0) AS n_kept, CAST(count(*) AS BIGINT) AS n_rows
FROM f, p, r WHERE mask & bit <> 0 GROUP BY policy, rule
"""
