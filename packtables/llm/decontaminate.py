"""Benchmark decontamination over a distributed positional inverted index (DataFrame operations only).

* ``build_index`` writes the postings (term, document row, position) of every training token whose term occurs in the
  benchmark, in one pass over the documents and without a shuffle: each file holds the lists of its own documents.
  Other tokens cannot take part in a match. A sentinel posting for each row holds its word count.
* ``occurrences`` intersects offset-adjusted lists. For each benchmark window the terms are ordered by their frequency in
  the index. The lists of the ``RARE`` rarest terms, moved back by their offsets in the window, give candidate starts;
  only starts that all of them agree on go on, and are intersected with the lists of the remaining terms, of the
  candidate rows alone.
* With ``misses=1`` a window of full length also nearly matches where one of its words is another one, or stands in no
  document at all (an empty list): one list more is read, and starts that ``RARE`` of them agree on are candidates.
* ``proximity`` uses the same lists with a slack: the rarest terms of an item, each within ``slack`` positions of its place.

A word is a run of ``[0-9a-z]`` and characters beyond ASCII, after A-Z are
lower-cased. A window is ``N`` consecutive words of an item; a shorter item with
any word is one window. A document word inside any occurrence of a window is hit.

Row keys of the index (``uid``) are drawn before it is written, so rows that
share an id, or have none, stay apart. Hot terms are pre-aggregated where they
are counted; lists are joined on (window, row, start) or (row, position, term),
never on a term alone beyond the bounded vocabulary, which is broadcast only
up to ``BROADCAST_ROWS`` counted rows.

Defined results: a null text has no words; null and empty benchmark texts have
no window; a null item id counts as an empty string, repeated item ids as one
item; without any window no document is contaminated; repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packtables.llm.common import free_name, written

N = 10
RARE = 2               # lists intersected before the candidate rows are known
BROADCAST_ROWS = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTINEL = 0           # term number of the posting that holds a row's word count


def words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.length(t)
    low = F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, CAPITALS, SMALL))
    return F.array_remove(F.split(low, NOT_WORD), "")


def hinted(small: DataFrame, n_rows: int) -> DataFrame:
    """``small`` with a broadcast hint if its counted rows allow it; else Spark picks a shuffled join."""
    return F.broadcast(small) if n_rows <= BROADCAST_ROWS else small


def windows(items: DataFrame, n: int = N) -> DataFrame:
    """``item_id``, ``words`` of each window."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w"))
    cut = F.when(F.size("w") > n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))) \
        .otherwise(F.array("w"))
    return w.filter(F.size("w") > 0).select("item_id", F.explode(cut).alias("words"))


def build_vocabulary(wins: DataFrame) -> DataFrame:
    """Each term of the windows with a number from 1 (drawn once, then written)."""
    terms = wins.select(F.explode("words").alias("word")).distinct()
    return written(terms.select("word", (F.monotonically_increasing_id() + 1).alias("term")), "vocabulary")


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings ``uid``, ``pos``, ``term``; the sentinel's ``pos`` is the row's word count, and only it has ``doc_id``
    and ``text_key``."""
    sentinel = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(SENTINEL).cast("long").alias("term"))
    terms = vocabulary.union(sentinel)
    toks = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("text_key"),
                       words(F.col("text")).alias("w"))
    toks = toks.select("uid", "doc_id", "text_key", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    last = F.col("term") == SENTINEL
    found = toks.join(hinted(terms, vocabulary.count()), "word")
    return written(found.select("uid", "pos", "term", F.when(last, F.col("doc_id")).alias("doc_id"),
                                F.when(last, F.col("text_key")).alias("text_key")), "index")


def ranked(wins: DataFrame, vocabulary: DataFrame, index: DataFrame, misses: int = 0, n: int = N) -> DataFrame:
    """Distinct windows ``win``, ``size`` and ``terms``: (frequency, offset, term), rarest first, and ``misses``, how many
    words may still be missed. Terms that no document has are misses; windows with more of them are left out."""
    df = index.filter(F.col("term") != SENTINEL).groupBy("term").agg(F.count("*").alias("df"))
    counted = vocabulary.join(df, "term")
    distinct = wins.select("words").distinct().select(F.array_join("words", " ").alias("win"), F.size("words").alias("size"), "words")
    flat = distinct.select("win", "size", F.posexplode("words").alias("off", "word")).join(counted, "word")
    out = flat.groupBy("win", "size").agg(F.sort_array(F.collect_list(F.struct("df", "off", "term"))).alias("terms"))
    allowed = F.when(F.col("size") >= max(n, RARE + misses), F.lit(misses)).otherwise(0)
    out = out.withColumn("misses", allowed - (F.col("size") - F.size("terms"))).filter("misses >= 0")
    return written(out.select(F.monotonically_increasing_id().alias("win_id"), "win", "size", "misses", "terms"), "windows")


def lists(index: DataFrame, wins: DataFrame, n_windows: int, rank: int) -> DataFrame:
    """Postings of each window's term of that rank, moved to the window's start."""
    one = wins.filter(F.size("terms") > rank).select(
        "win_id", F.col("terms")[rank]["term"].alias("term"), F.col("terms")[rank]["off"].alias("off"))
    return index.select("uid", "pos", "term").join(hinted(one, n_windows), "term") \
        .select("win_id", "uid", (F.col("pos") - F.col("off")).alias("start"))


def occurrences(index: DataFrame, wins: DataFrame, misses: int = 0) -> DataFrame:
    """``win_id``, ``uid``, ``start``, ``size``, ``n`` of every place where all words of a window but those that it may
    miss stand in a row; ``n`` of them do. The place of a missed word at either end lies inside the row as well."""
    n_windows = wins.count()
    tagged = None
    for r in range(RARE + misses):
        part = lists(index, wins.filter(F.col("misses") + RARE > r), n_windows, r).filter("start >= 0")
        tagged = part if tagged is None else tagged.union(part)
    agreed = tagged.groupBy("win_id", "uid", "start").agg(F.count("*").cast("int").alias("n"))
    known = wins.select("win_id", "size", "misses", "terms")
    cand = agreed.join(hinted(known, n_windows), "win_id").filter(F.col("n") >= F.least(F.col("size"), F.lit(RARE)))
    rest = F.expr(f"slice(terms, {RARE + 1} + misses, 100000)")
    cand = written(cand.select("win_id", "uid", "start", "size", "n", (F.size("terms") - F.col("misses")).alias("least"),
                               rest.alias("rest")), "candidates")
    place = ["win_id", "uid", "start"]
    need = cand.select(*place, F.explode("rest").alias("t")) \
        .select(*place, (F.col("start") + F.col("t.off")).alias("pos"), F.col("t.term").alias("term"))
    rows = cand.select("uid").distinct()
    own = index.select("uid", "pos", "term").join(hinted(rows, rows.count()), "uid", "left_semi")
    met = need.join(own, ["uid", "pos", "term"]).groupBy(*place).agg(F.count("*").cast("int").alias("more"))
    total = F.col("n") + F.coalesce(F.col("more"), F.lit(0))
    out = cand.join(met, place, "left").withColumn("n", total).filter(F.col("n") >= F.col("least"))
    if misses:
        lengths = index.filter(F.col("term") == SENTINEL).select("uid", F.col("pos").alias("_words"))
        out = out.join(lengths, "uid").filter(F.col("start") + F.col("size") <= F.col("_words"))
    return out.select(*place, "size", "n")


def judged(docs: DataFrame, items: DataFrame, n: int = N, misses: int = 0) -> DataFrame:
    """One row for each row of ``docs``: its id, a hash of its text, word and hit counts, items; ``n_near`` counts the
    items with a window that stands there with up to ``misses`` words changed (exact ones too)."""
    wins = written(windows(items, n), "item-windows")
    vocabulary = build_vocabulary(wins)
    index = build_index(docs, vocabulary)
    ranks = ranked(wins, vocabulary, index, misses, n)
    near = written(occurrences(index, ranks, misses), "occurrences")
    occ = near.filter("n = size")

    end = F.col("start") + F.col("size")
    spans = occ.groupBy("uid", "start").agg(F.max("size").alias("size")).select("uid", "start", end.alias("end"))
    before = Window.partitionBy("uid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = spans.select("uid", F.greatest(F.col("end") - reach, F.lit(0)).alias("fresh")) \
        .groupBy("uid").agg(F.sum("fresh").alias("n_hit"))

    names = wins.select(F.array_join("words", " ").alias("win"), "item_id").distinct()
    known = ranks.join(names, "win").select("win_id", "item_id")
    met = near.groupBy("uid", "win_id").agg(F.max(F.col("n") == F.col("size")).alias("exact")).join(known, "win_id") \
        .groupBy("uid", "item_id").agg(F.max("exact").alias("exact"))
    found = met.groupBy("uid").agg(                                                        # at most the benchmark's items
        F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item_id")))).alias("items"), F.count("*").alias("n_near"))

    rows = index.filter(F.col("term") == SENTINEL).select("uid", "doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))
    return rows.join(found.join(hit, "uid", "left"), "uid", "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def contamination(docs: DataFrame, items: DataFrame, n: int = N, misses: int = 1) -> DataFrame:
    return judged(docs, items, n, misses).drop("text_key")


def proximity(docs: DataFrame, items: DataFrame, terms: int = 4, slack: int = 3, n: int = N) -> DataFrame:
    """``doc_id``, ``item_id``: a row holds the ``terms`` rarest terms of a window of the item, each at most ``slack``
    positions away from its place in the window, counted from the rarest term."""
    wins = written(windows(items, n), "item-windows")
    vocabulary = build_vocabulary(wins)
    index = build_index(docs, vocabulary)
    ranks = ranked(wins, vocabulary, index)
    n_windows = ranks.count()
    near = lists(index, ranks, n_windows, 0).select("win_id", "uid", F.col("start").alias("at"))
    for r in range(1, terms):
        # a start in a cell of width slack + 1 meets only its own and the two cells beside it
        other = lists(index, ranks, n_windows, r)
        cell = F.floor(F.col("start") / (slack + 1))
        other = other.select("win_id", "uid", "start", cell.alias("cell")).distinct()
        own = near.select("*", F.floor(F.col("at") / (slack + 1)).alias("c")) \
            .select("win_id", "uid", "at", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("cell"))
        met = own.join(other, ["win_id", "uid", "cell"]).filter(F.abs(F.col("at") - F.col("start")) <= slack) \
            .select("win_id", "uid", "at").distinct()
        done = near.join(ranks.filter(F.size("terms") <= r).select("win_id"), "win_id", "left_semi")
        near = met.union(done)
    names = wins.select(F.array_join("words", " ").alias("win"), "item_id").distinct()
    rows = index.filter(F.col("term") == SENTINEL).select("uid", "doc_id")
    return near.select("win_id", "uid").distinct().join(ranks.select("win_id", "win"), "win_id").join(names, "win") \
        .join(rows, "uid").select("uid", "doc_id", "item_id").distinct().drop("uid")


def keep_uncontaminated(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """The rows of ``docs`` (all columns) without a hit; a verdict depends on the text alone, so it is brought back by
    id and text hash."""
    key = free_name(docs, "text_key")
    bad = written(judged(docs, items, n).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct(),
                  "contaminated")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    on = keyed["doc_id"].eqNullSafe(bad["bad_id"]) & (keyed[key] == bad["bad_key"])
    return keyed.join(hinted(bad, bad.count()), on, "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, CAST(least(len(w), 10) AS BIGINT) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM wins
), grams AS (
  SELECT doc_id, i, size, list_slice(w, i, i + size - 1) AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), occ AS (
  SELECT doc_id, i, size, item_id FROM grams JOIN wins USING (size, win)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY doc_id
), close AS (
  SELECT doc_id, item_id FROM (
    SELECT doc_id, item_id, g.win AS a, w.win AS b FROM grams g JOIN wins w ON g.size = w.size AND g.win[1:5] = w.win[1:5] WHERE w.size = 10
    UNION ALL
    SELECT doc_id, item_id, g.win, w.win FROM grams g JOIN wins w ON g.size = w.size AND g.win[6:10] = w.win[6:10] WHERE w.size = 10)
  WHERE len(list_filter(range(1, 11), lambda i: a[i] <> b[i])) <= 1
  UNION ALL
  SELECT doc_id, item_id FROM occ
), near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close GROUP BY doc_id
), found AS (
  SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM occ GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
"""
