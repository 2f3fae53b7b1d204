"""Substring lookups (J2, J4, J5) as equi-joins.

"First name / path containing the text" is a theta join. Instead of a nested
loop over every (needle, candidate) pair, both sides are cut into n-grams:
each needle keeps its rarest n-gram (frequencies are one partial
aggregation), is equi-joined with the candidates holding that n-gram, and
the short candidate list is checked with ``contains``. The result is exact:
a candidate containing the needle holds every n-gram of it. A needle is cut into
n-grams of the largest of a few lengths that it holds (1 to ``q``, then doubling), so a long needle has a rare
one however many candidates there are, and a needle shorter than ``q`` is its own gram.
Candidates are cut into the lengths that the needles need; their n-grams are streamed past the needles' and not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 24                    # characters of an n-gram
SMALL = 32 * 2 ** 20            # bytes of needles up to which they are sent to the candidates, not both to a shuffle


def _grams(col: Column, q: Column | int) -> Column:
    """Distinct substrings of ``q`` characters (a shorter text: itself)."""
    n = F.length(col)
    size = F.lit(q) if isinstance(q, int) else q
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))),
                                        lambda i: F.substring(col, i, size)))


def gram_lengths(q: int) -> list[int]:
    """1 to ``q``, then doubling up to ``LONGEST``."""
    out = list(range(1, q + 1))
    while out[-1] * 2 <= LONGEST:
        out.append(out[-1] * 2)
    return out


class GramIndex:
    """The candidates of a lookup; ``grams`` has a row ``keys..., value, extra..., _g`` for each n-gram of some lengths."""

    def __init__(self, haystack: DataFrame, value: str, keys: tuple[str, ...] = ("repo_id",), q: int = 3,
                 materialize: bool = False):
        from packtables.session import cut_lineage

        self.haystack = cut_lineage(haystack) if materialize else haystack
        self.value, self.keys, self.q = value, list(keys), q

    def grams(self, lengths: list[int]) -> DataFrame:
        cut = F.array_distinct(F.flatten(F.array(*[_grams(F.col(self.value), k) for k in lengths])))
        rest = [c for c in self.haystack.columns if c not in self.keys]
        return self.haystack.select(*self.keys, *rest, F.explode(cut).alias("_g"))


def containing(needles: DataFrame, haystack: DataFrame | None = None, *, needle: str, value: str,
               keys: tuple[str, ...] = ("repo_id",), q: int = 3, index: GramIndex | None = None) -> DataFrame:
    """All ``(keys, needle, value)`` with ``contains(value, needle)``.

    ``needles(keys..., needle)`` and ``haystack(keys..., value, ...)``; extra
    haystack columns are carried through. A prebuilt ``index`` replaces the
    haystack.
    """
    from packtables.session import cut_lineage

    if index is None:
        index = GramIndex(haystack, value, keys, q)
    keys, n = list(index.keys), F.length(needle)
    size = F.greatest(*[F.when(n >= k, F.lit(k)) for k in gram_lengths(index.q)])
    nd = cut_lineage(needles.select(*keys, needle).distinct().filter(n > 0).withColumn("_q", size))
    row = 48 + F.col("_q")                     # bytes of a row besides its needle
    lengths, cut, whole = nd.agg(F.sort_array(F.collect_set("_q")), F.sum((n - F.col("_q") + 1) * row), F.sum(n + row)).first()
    sent = lambda df, size: F.broadcast(df) if (size or 0) <= SMALL else df
    hg = index.grams(lengths or [1])
    ng = nd.select(*keys, needle, F.explode(_grams(F.col(needle), F.col("_q"))).alias("_g"))
    wanted = ng.select(*keys, "_g").distinct()
    freq = hg.select(*keys, "_g").join(sent(wanted, cut), keys + ["_g"], "left_semi").groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_f"))
    ng = ng.join(freq, keys + ["_g"], "left").fillna(0, ["_f"])
    # a needle with an n-gram no candidate holds has no match at all
    best = (ng.groupBy(*keys, needle)
            .agg(F.min("_f").alias("_minf"), F.min_by("_g", F.struct("_f", "_g")).alias("_g"))
            .filter(F.col("_minf") > 0).drop("_minf"))
    best = cut_lineage(best)
    return sent(best, whole).join(hg, keys + ["_g"]).filter(F.col(value).contains(F.col(needle))).drop("_g")


def first_containing(needles: DataFrame, haystack: DataFrame | None = None, *, needle: str, value: str,
                     order: Column | str, keys: tuple[str, ...] = ("repo_id",), q: int = 3, out: str = "match",
                     index: GramIndex | None = None) -> DataFrame:
    """``(keys, needle, out)``: the first candidate (by ``order``) containing each needle."""
    hit = containing(needles, haystack, needle=needle, value=value, keys=keys, q=q, index=index)
    o = F.col(order) if isinstance(order, str) else order
    return (hit.groupBy(*keys, needle).agg(F.min_by(F.col(value), o).alias(out)))
