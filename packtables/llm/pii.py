r"""Personal data by bootstrapped contextual extraction (DataFrame operations only).

1. Seeds: base spans of four kinds by fixed patterns. The patterns below find
   the same spans as the plain ones (quoted beside them), but start only where
   a leftmost match can start and never backtrack into a run, so they are linear
   and need no stack on long runs. Places come from the texts between matches.
2. Each seed induces lexical patterns: the two words before it, and the word
   before with the word after. The same contexts are taken of *candidates* that
   overlap no base span: tokens and groups of digits (joined by a space, hyphen, dot
   or brackets) of 6 characters or more with three digits or more, and mail
   addresses of any host, with ``@`` or ``at`` and ``dot`` spelled out.
3. Until a round accepts nothing new, the graph of patterns and instances is
   scored: a pattern's confidence for a kind is the share of its distinct known
   instances that are of that kind, damped for few; instances of no known kind
   weigh lightly, by the logarithm of their number (``UNSEEN`` for each doubling).
   Patterns with ``SUPPORT`` known instances and ``TRUST`` confidence vote; a candidate
   whose votes, joined as independent evidence, reach ``ACCEPT`` becomes known, stays
   so, and counts in the next round.
4. Known candidates add spans ``found_<kind>``, of those that overlap the one that
   begins first, or else is longest; base spans stay as they are.

Patterns and instances are counted over all documents. Edges are reduced to
distinct (pattern, instance) pairs before any scoring, so a value copied into
many documents counts once, and accepted patterns meet edges by equi-joins.

Defined results: a null text counts as empty and has no spans; repeated rows
are judged one by one (row keys are drawn once and written); an empty table
gives an empty table; extra columns are ignored. Offsets are code points, end
exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packtables.llm.common import written

KINDS = ["email", "ip", "card", "phone"]
FOUND = [f"found_{k}" for k in KINDS]
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+, here of 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = {
    "token": r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+@-]*+[0-9])[A-Za-z0-9._%+@-]{6,}+",
    # digits joined by a space, dot, hyphen or brackets; starts only where such a run starts
    "group": r"(?<![A-Za-z0-9_%+@.(-])(?<![0-9)][\x20])(?<![0-9)]\x20-\x20)[+]?\(?[0-9]++(?:(?:\x20-\x20|\x20?\(|\)[\x20-]?|[\x20.-])[0-9]++)++"
             r"(?![A-Za-z_%+@]|[.-][A-Za-z0-9@])",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)*+"
            r"|\x20?[(\[](?i:at)[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)*+"
            r"|\x20(?i:at)\x20[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++)",
}
AROUND = 64            # characters looked at on either side for context
UNSEEN = 0.25          # weight against a pattern of each doubling of its instances of no known kind
SUPPORT = 3            # known instances of a pattern that votes
TRUST = 0.6
ACCEPT = 0.9


def raw_matches(docs: DataFrame) -> DataFrame:
    """``uid``, ``doc_id`` and ``occ``: (kind, i, gap, match, before, after) of each pattern's matches, no text."""
    t = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id",
                    F.when(F.col("text").rlike(r"[0-9@]|(?i)[\x20(\[]at[\x20)\]]"), F.col("text")).alias("t"))
    every = PATTERNS | CANDIDATES
    t = t.select("uid", "doc_id", "t", *[F.regexp_extract_all("t", F.lit(p), 0).alias(f"m_{k}") for k, p in every.items()])
    t = t.select("uid", "doc_id", *[f"m_{k}" for k in every],
                 *[F.when(F.size(f"m_{k}") > 0, F.split("t", p, -1)).alias(f"p_{k}") for k, p in every.items()])

    def occ(k: str) -> Column:
        return F.coalesce(F.transform(f"m_{k}", lambda m, i: F.struct(
            F.lit(k).alias("kind"), i.cast("long").alias("i"), F.length(F.get(f"p_{k}", i)).cast("long").alias("gap"), m.alias("match"),
            F.right(F.get(f"p_{k}", i), F.lit(AROUND)).alias("before"), F.left(F.get(f"p_{k}", i + 1), F.lit(AROUND)).alias("after"))),
            F.array())
    return written(t.select("uid", "doc_id", F.concat(*[occ(k) for k in every]).alias("occ")), "matches")


def _valid(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    parts = F.split(m, r"\.")
    byte = F.forall(parts, lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.substring(x, -3, 3).try_cast("int") <= 255))
    n = F.length(digits)
    figure = F.transform(F.split(F.reverse(digits), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    doubled = F.transform(figure, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    luhn = F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0
    return (F.when(F.col("kind") == "ip", byte).when(F.col("kind") == "card", n.between(12, 19) & luhn)
            .when(F.col("kind") == "phone", n.between(9, 15)).when(F.col("kind") == "token", n >= 3)
            .when(F.col("kind") == "group", (n >= 3) & (F.length(m) >= 6)).otherwise(True))


def _contexts() -> Column:
    """The lexical patterns of an occurrence, digits made alike."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    before = F.filter(F.split(plain(F.col("before")), r"\s+"), lambda x: x != "")
    after = F.filter(F.split(plain(F.col("after")), r"\s+"), lambda x: x != "")
    one, two, nxt = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2)), F.try_element_at(after, F.lit(1))
    return F.filter(F.array(F.concat(two, F.lit(" "), one, F.lit(" _")), F.concat(one, F.lit(" _ "), nxt)), lambda x: x.isNotNull())


def located(raw: DataFrame) -> DataFrame:
    """``uid``, ``kind``, ``start``, ``end``, ``value``, ``contexts`` of the valid matches (kind ``token``: candidates)."""
    flat = raw.select("uid", F.inline("occ"))
    size = F.length("match").cast("long")
    so_far = Window.partitionBy("uid", "kind").orderBy("i")
    flat = flat.withColumn("end", F.sum(F.col("gap") + size).over(so_far)).withColumn("start", F.col("end") - size)
    flat = flat.filter(_valid(F.col("match")))
    edge = F.regexp_extract("match", r"^[._%+@-]*", 0)
    core = F.regexp_replace("match", r"^[._%+@-]+|[._%+@-]+$", "")
    token = F.col("kind").isin("token", "mail")
    start = F.when(token, F.col("start") + F.length(edge)).otherwise(F.col("start"))
    kind = F.when(F.col("kind").isin(*CANDIDATES), F.lit("token")).otherwise(F.col("kind"))
    return flat.select("uid", kind.alias("kind"), start.alias("start"), F.when(token, start + F.length(core)).otherwise(F.col("end")).alias("end"),
                       F.when(token, core).otherwise(F.col("match")).alias("value"), _contexts().alias("contexts"))


def clear_candidates(spans: DataFrame) -> DataFrame:
    """Candidates that overlap no base span: by the furthest end before them and the nearest start after them."""
    base = F.col("kind") != "token"
    ahead = Window.partitionBy("uid").orderBy(F.col("start"), base.desc(), F.col("end")).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("uid").orderBy(F.col("start").desc(), base.desc(), F.col("end")).rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.select("*", F.max(F.when(base, F.col("end"))).over(ahead).alias("reach"),
                          F.min(F.when(base, F.col("start"))).over(behind).alias("next"))
    return marked.filter((F.col("kind") == "token") & F.coalesce(F.col("reach") <= F.col("start"), F.lit(True))
                         & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))).drop("reach", "next")


def bootstrap(base: DataFrame, candidates: DataFrame, rounds: int | None = None) -> DataFrame:
    """``value``, ``kind``, ``score`` of the candidates accepted in ``rounds``, or until a round accepts nothing new."""
    seeds = base.select("kind", "value", F.explode("contexts").alias("pattern")).distinct()
    edges = written(candidates.select("value", F.explode("contexts").alias("pattern")).distinct(), "edges")
    seeds = written(seeds, "seeds")
    known = None
    while rounds is None or rounds > 0:
        labelled = edges.select(F.lit(None).cast("string").alias("kind"), "value", "pattern") if known is None else \
            edges.join(known.select("value", "kind"), "value", "left").select("kind", "value", "pattern")
        both = seeds.select("kind", "value", "pattern").union(labelled)
        sums = both.groupBy("pattern").agg(F.count("kind").alias("n"), F.count(F.when(F.col("kind").isNull(), 1)).alias("unseen"),
                                           *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS])
        weight = F.col("n") + 1 + UNSEEN * F.log2(F.col("unseen") + 1)
        votes = sums.select("pattern", F.explode(F.array(*[F.struct(
            F.lit(k).alias("kind"), F.col(k).alias("n_known"), (F.col(k) / weight).alias("trust")) for k in KINDS])).alias("v")) \
            .select("pattern", "v.*").filter((F.col("n_known") >= SUPPORT) & (F.col("trust") >= TRUST))
        fresh = edges if known is None else edges.join(known, "value", "left_anti")
        scored = fresh.join(votes, "pattern").groupBy("value", "kind") \
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        best = scored.filter(F.col("score") >= ACCEPT).groupBy("value") \
            .agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score")
        new = written(best, "known")
        known = new if known is None else known.union(new)
        rounds = rounds and rounds - 1
        if new.isEmpty():
            break
    return known


def apart(found: DataFrame) -> DataFrame:
    """``found`` without spans that overlap one that begins before them, or there and is longer."""
    order = Window.partitionBy("uid").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("reach", F.max("end").over(order)).filter(F.coalesce(F.col("reach") <= F.col("start"), F.lit(True))).drop("reach")


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    names = F.array(*[F.lit(k) for k in KINDS + FOUND])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat(
        F.element_at(names, s["k"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def extract(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, digest of the base spans, all spans, and ``n_found``."""
    raw = raw_matches(docs)
    spans = written(located(raw), "located")
    base = spans.filter(F.col("kind") != "token")
    clear = written(clear_candidates(spans), "clear")
    known = bootstrap(base, clear)
    found = apart(clear.join(known.select("value", F.col("kind").alias("of")), "value")
                  .select("uid", F.concat(F.lit("found_"), "of").alias("kind"), "start", "end"))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS + FOUND]), F.col("kind")).cast("int")
    every = base.select("uid", "kind", "start", "end").union(found).withColumn("k", place)
    span = F.struct("start", "k", "end")
    sums = every.groupBy("uid").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        F.count(F.when(F.col("k") > len(KINDS), 1)).alias("n_found"),
        _joined(F.collect_list(F.when(F.col("k") <= len(KINDS), span))).alias("base"), _joined(F.collect_list(span)).alias("spans"))
    return raw.select("uid", "doc_id").join(sums, "uid", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"))
