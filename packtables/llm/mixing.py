"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: its weight's share of all words, but no more than ``max_repeats`` times what
it holds (``targets``; the excess goes to the others by weight until none is above). A document's expected copies are its
source's target over the source's size, or, with an ``importance``, in proportion to it. Whole copies are certain. What
is left is an inclusion probability p, and the documents of a source are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)); the sample is those of the smallest ranks, as many as fill the words that the certain
copies leave open (the document that crosses the border is taken if that comes nearer). The random number is a hash of
the seed, the id, the source and the text, so reruns agree.

Nothing is gathered by source: sizes are partial sums, and the running words of the ranking are prefix sums over range
partitions of (source, rank), so a source of any size spreads over many tasks. All sums that decide are of whole
numbers unless an importance is given.

Defined results: a null or blank text has size 0 and takes no words; a null source is a source, the last one; rows that
share an id, or have none, are drawn one by one, and of equal rows as many as the border allows; a source without words
has target 0; an empty table gives an empty table; extra columns are ignored by ``allocation`` and kept by ``mixture``.
A null, negative or non-finite importance counts as 0; a source with words and no importance takes none.
Texts are counted whole; a row must fit Spark's row limit of 2 GiB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packtables.llm.common import free_name, numbered, written
from packtables.operators.joins import null_safe_join
from packtables.operators.scan import running_sum

WEIGHTS = (1, 2, 3)             # of the sources in code point order, repeating
MAX_REPEATS = 3
SEED = 11
BROADCAST_SOURCES = 100_000     # rows of the table of sources that may be broadcast; beyond, the join is shuffled


def n_words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def random_unit(*columns: Column) -> Column:
    """A number strictly between 0 and 1 from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 12) + F.lit(0.5)) / F.lit(2.0 ** 52)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: words by weight, at most ``max_repeats`` times the size.

    With the share of a unit of weight at some level, the sources above their cap give the excess back and the level
    rises; it is raised until no further source is above. Each round is one aggregate of the table.
    """
    placed = running_sum(sources.withColumn("_g", F.lit(0)), ["_g"], [F.col("source").asc_nulls_last()], F.lit(1), "_pos")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("_pos") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = written(placed.select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    cap = F.col("source_size") * F.lit(max_repeats)
    total, all_weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, over = (total / all_weights if all_weights else 0.0), 0
    while True:
        above = F.lit(level) * F.col("weight") > cap
        n, capped, free = s.agg(F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == over or not free:
            break
        over, level = n, (total - capped) / free
    return s.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap.cast("double")))


def _levels(rows: DataFrame, max_repeats: int) -> DataFrame:
    """Copies per unit of importance of each source: what fills its target when no document has more than its cap."""
    d = rows.filter("importance > 0 and size > 0")
    first = d.groupBy("source").agg((F.max("target") / F.sum(F.col("importance") * F.col("size"))).alias("level"), F.lit(0).cast("long").alias("over"))
    levels, before = written(first, "levels"), -1
    while True:
        n = levels.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
        if n == before:
            return levels.select("source", "level")
        before = n
        above = F.col("level") * F.col("importance") >= F.lit(max_repeats)
        left = F.max("target") - F.coalesce(F.sum(F.when(above, F.col("size") * max_repeats)), F.lit(0))
        free = F.sum(F.when(~above, F.col("importance") * F.col("size")))
        risen = null_safe_join(d, levels, ["source"]).groupBy("source").agg(
            F.coalesce(F.greatest(left / free, F.max("level")), F.max("level")).alias("level"), F.count_if(above).alias("over"))
        levels = written(risen, "levels")


def _allocated(rows: DataFrame, weights: tuple[int, ...], max_repeats: int, weighted: bool) -> DataFrame:
    """``rows(row, doc_id, source, size, u, importance)`` with ``source_size``, ``target`` and ``copies``."""
    sizes = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    sizes = written(sizes.select("source", "source_size", "target"), "targets")
    small = sizes.count() <= BROADCAST_SOURCES
    r = null_safe_join(rows, sizes, ["source"], broadcast=small)
    if weighted:
        r = null_safe_join(r, _levels(r, max_repeats), ["source"], "left", broadcast=small)
        wanted = F.least(F.coalesce(F.col("level") * F.col("importance"), F.lit(0.0)), F.lit(float(max_repeats)))
    else:
        wanted = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    r = r.withColumn("whole", F.floor(wanted)).withColumn("p", wanted - F.floor(wanted))
    # exact without an importance; with one, what the documents' caps leave unfilled is not asked of the others
    left = F.sum(F.col("p") * F.col("size")) if weighted else F.max("target") - F.sum(F.col("whole") * F.col("size"))
    open_words = r.groupBy("source").agg(left.alias("open"))
    r = null_safe_join(r, written(open_words, "open"), ["source"], broadcast=small)
    odds = F.col("u") / (1 - F.col("u"))
    chance = F.when((F.col("p") > 0) & (F.col("size") > 0), odds * (1 - F.col("p")) / F.col("p"))
    r = written(r.withColumn("rank", chance), "ranked")
    rest = r.filter("rank is null").withColumn("extra", F.lit(0))
    # rows that are equal in all else have the same rank; their numbers part them, so they spread over tasks as well
    order = ["rank", F.xxhash64("row"), "row"]
    run = running_sum(r.filter("rank is not null"), ["source"], order, "size", "words")
    drawn = run.withColumn("extra", (F.col("words") - F.col("size") / 2 <= F.col("open")).cast("int")).drop("words")
    return drawn.unionByName(rest).withColumn("copies", F.col("whole") + F.col("extra"))


def _rows(docs: DataFrame, row: str, importance: Column | None, seed: int) -> DataFrame:
    m = F.lit(1.0) if importance is None else F.when(F.abs(importance.cast("double")) < float("inf"), F.greatest(importance.cast("double"), F.lit(0.0)))
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col(row).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"),
                       random_unit(F.lit(seed), F.col("doc_id"), F.col("source"), text).alias("u"), F.coalesce(m, F.lit(0.0)).alias("importance"))


def allocation(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
               importance: Column | None = None, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and ``source, copies``."""
    kept = docs.select("doc_id", "source", "text", *([] if importance is None else [importance.alias("importance")]))
    rows = written(_rows(kept.withColumn("row", F.monotonically_increasing_id()), "row",
                         None if importance is None else F.col("importance"), seed), "sizes")
    out = _allocated(rows, weights, max_repeats, importance is not None)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
            importance: Column | None = None, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    row = free_name(docs, "row_number")
    stored = numbered(docs, row)
    rows = written(_rows(stored, row, importance, seed), "sizes")
    copies = _allocated(rows, weights, max_repeats, importance is not None).filter("copies > 0").select(F.col("row").alias(row), "copies")
    name = free_name(stored, "copies")
    joined = stored.join(copies.withColumnRenamed("copies", name), row)
    again = free_name(joined, "again")
    return joined.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(name)))).select(*docs.columns)
