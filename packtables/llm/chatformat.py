"""Chat formatting after collapsing cumulative snapshots (DataFrame operations only).

Chat logs often hold a conversation again each time it grows. A rolling hash of
every turn prefix identifies them: the hash of a prefix is the exclusive or of
128-bit hashes of (place, role, text) of its turns, so it is a running
aggregate. A conversation whose whole hash is a proper prefix of another one is
removed by an anti-join; of equal conversations the smallest id stays. Only what
is left is joined with its texts and rendered.

Prefixes are computed in two levels: inside blocks of ``BLOCK`` turn numbers, and
over the blocks of a conversation, so that one very long conversation is spread
over tasks. Only hashes are shuffled until the rendering.

Defined results: turns are ordered by turn, role, text (nulls first); rows with
a null id belong to no conversation that could be told, so each is one of a
single turn; null roles and texts differ from empty ones when
compared and render as empty; repeated rows are repeated turns; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packtables.llm.common import written

BLOCK = 1_024
HEAD, TAIL = "<|", "|>\n"      # around the role
END = "\n"                    # after each turn


def _hashed(turns: DataFrame) -> tuple[Column, Column]:
    """The role and the digest of the text, nulls apart from empty ones."""
    return F.coalesce(F.concat(F.lit("r"), "role"), F.lit("")).alias("role"), F.coalesce(F.md5("text"), F.lit("null")).alias("x")


def _hashes(pos: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), pos, "role", "x").alias("h1"), F.xxhash64(F.lit(2), "x", "role", pos).alias("h2")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``pos``, ``h1``, ``h2`` (hash of the prefix that ends there), ``is_last``."""
    role, x = _hashed(turns)
    alone = turns.filter("conv_id is null").select("conv_id", role, x, F.lit(1).cast("long").alias("pos"))
    alone = alone.select("conv_id", "pos", *_hashes(F.col("pos")), F.lit(True).alias("is_last"))
    turns = turns.filter("conv_id is not null")
    t = turns.select("conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).alias("block"), "turn",
                     role, x, "text")
    order = [F.asc_nulls_first("turn"), F.col("role"), F.asc_nulls_first("text")]
    t = t.select("conv_id", "block", "role", "x",
                 F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)).alias("at"))
    sizes = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    by_block = Window.partitionBy("conv_id").orderBy("block")
    sizes = sizes.select("conv_id", "block", (F.sum("n").over(by_block) - F.col("n")).alias("before"),
                         F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"))
    b = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "before", "n_turns")
    t = t.join(b, t["conv_id"].eqNullSafe(b["c"]) & (t["block"] == b["b"])).withColumn("pos", F.col("before") + F.col("at"))
    t = t.select("conv_id", "block", "pos", "n_turns", *_hashes(F.col("pos")))
    run = Window.partitionBy("conv_id", "block").orderBy("pos")
    t = t.select("conv_id", "block", "pos", "n_turns", F.bit_xor("h1").over(run).alias("h1"), F.bit_xor("h2").over(run).alias("h2"))
    t = written(t, "prefixes")
    whole = t.groupBy("conv_id", "block").agg(F.max_by("h1", "pos").alias("w1"), F.max_by("h2", "pos").alias("w2"))
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                         F.coalesce(F.bit_xor("w1").over(earlier), F.lit(0)).alias("w1"),
                         F.coalesce(F.bit_xor("w2").over(earlier), F.lit(0)).alias("w2"))
    t = t.join(carry, t["conv_id"].eqNullSafe(carry["c"]) & (t["block"] == carry["b"]))
    t = t.select("conv_id", "pos", F.col("h1").bitwiseXOR(F.col("w1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("w2")).alias("h2"),
                 (F.col("pos") == F.col("n_turns")).alias("is_last"))
    return t.unionByName(alone)


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``n_copies``, ``h1``, ``h2`` of the conversations that no longer one begins with."""
    p = written(prefixes(turns), "turn-prefixes")
    ends = p.filter("is_last").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = p.filter(~F.col("is_last")).select("pos", "h1", "h2").distinct()
    return ends.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies", "h1", "h2")


def render(turns: DataFrame, kept: DataFrame, head: str = HEAD, tail: str = TAIL, end: str = END) -> DataFrame:
    """``kept`` with ``rendered``, the turns in order through the template."""
    k = kept.select(F.col("conv_id").alias("k"), "n_turns", "n_copies")
    t = turns.select("conv_id", "turn", "role", "text")
    own = t.join(k, t["conv_id"] == k["k"])
    rows = own.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    line = lambda x: F.concat(F.lit(head), F.coalesce(x["role"], F.lit("")), F.lit(tail), F.coalesce(x["text"], F.lit("")), F.lit(end))
    named = rows.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("t", line), "").alias("rendered"))
    # of turns without an id, one of each kept kind: their hashes are those of the single turn
    role, x = _hashed(turns)
    alone = turns.filter("conv_id is null").select(role, x, F.struct("role", "text").alias("one")).select(*_hashes(F.lit(1).cast("long")), "one")
    alone = alone.groupBy("h1", "h2").agg(F.first("one").alias("one")).join(kept.filter("conv_id is null"), ["h1", "h2"])
    return named.unionByName(alone.select("conv_id", "n_turns", "n_copies", line(F.col("one")).alias("rendered")))


def format_chats(turns: DataFrame) -> DataFrame:
    kept = written(maximal(turns), "maximal")
    return render(turns, kept)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), ''
                    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM (SELECT *, row_number() OVER () AS n FROM conversations) GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN n END
), p AS (
  SELECT DISTINCT list_slice(l, 1, k) AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)
), g AS (
  SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies, min(rendered) AS rendered FROM c GROUP BY l
)
SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns, n_copies, rendered
FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = g.l)
"""
