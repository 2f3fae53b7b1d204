"""Retrieval strategies (R1-R8) and pack-entry dedup rules.

Each strategy maps a table of request signals and the index tables to
``pack_entries`` rows. All requests move through a stage together:
``{symbol, file_expand, semantic, convention}`` are independent; blast radius
reads the paths the first two produced; git context reads the paths after
blast radius. Position columns (``pos``) reproduce the reference's insertion
order, so "first wins" rules are ``row_number() = 1`` on that order.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packtables.functions.text import head_summary, truncate_lines
from packtables.operators import graph, vectors
from packtables.operators.history import of_paths
from packtables.operators.lookup import first_containing
from packtables.options import PackOptions
from packtables.plans.index import CodeIndex
from packtables.plans.xml import SECTIONS

# Which strategy runs for which task type, in stage order.
ROUTING = (
    ("symbol", 0, "has_symbols"),
    ("file_expand", 0, "has_files"),
    ("semantic", 0, "always"),
    ("blast_radius", 1, "refactor"),
    ("convention", 0, "add_feature"),
    ("git_ctx", 2, "debug|refactor"),
)

POS_TYPE = "struct<stage:int,k1:long,k2:string,k3:long,k4:long,k5:string>"
SITE_TYPE = "array<struct<path:string,line:int>>"
COMMIT_TYPE = "array<struct<hash:string,message:string,author:string,date:string>>"

ENTRY_COLUMNS = (
    ("request_id", "long"), ("repo_id", "string"), ("section", "string"), ("sec_rank", "int"), ("pos", POS_TYPE),
    ("path", "string"), ("name", "string"), ("line", "int"), ("signature", "string"), ("body", "string"),
    ("sites", SITE_TYPE), ("content", "string"), ("score", "double"), ("commits", COMMIT_TYPE),
    ("seed", "string"), ("hops", "int"),
)


def pos(stage=0, k1=0, k2="", k3=0, k4=0, k5="") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(stage).cast("int").alias("stage"), lit(k1).cast("long").alias("k1"),
                    lit(k2).cast("string").alias("k2"), lit(k3).cast("long").alias("k3"),
                    lit(k4).cast("long").alias("k4"), lit(k5).cast("string").alias("k5"))


def entries(df: DataFrame, section: str, **cols: Column) -> DataFrame:
    """Project ``df`` to the pack_entries schema (missing columns typed null)."""
    cols = dict(cols)
    cols["section"] = F.lit(section)
    cols["sec_rank"] = F.lit(SECTIONS.index(section))
    out = []
    for name, typ in ENTRY_COLUMNS:
        c = cols.get(name, F.col(name) if name in df.columns and name not in cols else None)
        out.append((c if c is not None else F.lit(None)).cast(typ).alias(name))
    return df.select(*out)


def gate(strategy: str) -> Column:
    t = F.col("task_type")
    return {
        "symbol": F.size("symbols") > 0,
        "file_expand": F.size("file_mentions") > 0,
        "semantic": F.lit(True),
        "blast_radius": t == "refactor",
        "convention": t == "add_feature",
        "git_ctx": t.isin("debug", "refactor"),
    }[strategy]


def routes(signals: DataFrame) -> DataFrame:
    """``(request_id, strategy, stage)`` for every strategy a request runs."""
    arr = F.array(*[F.when(gate(name), F.struct(F.lit(name).alias("strategy"), F.lit(stage).alias("stage")))
                    for name, stage, _ in ROUTING])
    return (signals.select("request_id", F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("r"))
            .select("request_id", "r.strategy", "r.stage"))


# ---------------------------------------------------------------------------
# R1 symbol


def _last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def call_sites(calls: DataFrame, names: DataFrame, max_sites: int, match: str = "exact") -> DataFrame:
    """First ``max_sites`` call sites per ``(repo_id, name)`` in file order.

    ``match="exact"`` joins on the callee text as written (the reference);
    ``match="last_segment"`` joins ``obj.save`` with ``Cls.save`` (Q6). The
    top-k is taken per callee key before names are joined, so a key shared by
    many definitions never pairs every call with every definition; the
    top-k window plans a partial limit before the shuffle.
    """
    key = (lambda c: c) if match == "exact" else _last_segment
    n = names.select("repo_id", "name").distinct().withColumn("_key", key(F.col("name")))
    c = calls.withColumn("_key", key(F.col("symbol_name")))
    c = c.join(n.select("repo_id", "_key").distinct(), ["repo_id", "_key"], "left_semi")
    w = Window.partitionBy("repo_id", "_key").orderBy("path", "line", "col")
    top = c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_sites)
    per_key = (top.groupBy("repo_id", "_key")
               .agg(F.array_sort(F.collect_list(F.struct("_r", "path", "line"))).alias("_s")))
    return (n.join(per_key, ["repo_id", "_key"])
            .select("repo_id", "name", F.transform("_s", lambda s: F.struct(s["path"].alias("path"),
                                                                            s["line"].alias("line"))).alias("sites")))


def symbol_strategy(signals: DataFrame, idx: CodeIndex, opts: PackOptions) -> DataFrame:
    m = (signals.filter(gate("symbol"))
         .select("request_id", "repo_id", F.posexplode("symbols").alias("m_pos", "mention")))
    defs = idx.symbols
    names = idx.names
    exact = m.join(names.select("repo_id", F.col("name").alias("mention")), ["repo_id", "mention"], "left_semi")
    miss = m.join(names.select("repo_id", F.col("name").alias("mention")), ["repo_id", "mention"], "left_anti")
    # First name (in definition order) that contains the mention
    partial = first_containing(miss.select("repo_id", "mention"), needle="mention", value="name",
                               order="first", out="name", index=idx.name_grams)
    hits = (exact.withColumn("name", F.col("mention"))
            .unionByName(miss.join(partial, ["repo_id", "mention"])))
    # One entry per (name, path), the first in insertion order; keys only, the texts come last
    keys = defs.select("repo_id", "name", "path", "start_line", "col")
    found = (hits.join(keys, ["repo_id", "name"]).groupBy("request_id", "repo_id", "name", "path")
             .agg(F.min(F.struct("m_pos", "start_line", "col")).alias("_f"))
             .select("request_id", "repo_id", "name", "path", "_f.*"))
    sites = call_sites(idx.calls, found.select("repo_id", "name"), opts.max_call_sites, opts.call_match)
    found = found.join(sites, ["repo_id", "name"], "left")
    found = found.join(defs, ["repo_id", "name", "path", "start_line", "col"])
    return entries(found, "symbols",
                   pos=pos(0, F.col("m_pos"), F.col("path"), F.col("start_line"), F.col("col")),
                   line=F.col("start_line"),
                   body=truncate_lines("body", opts.symbol_max_body_lines),
                   sites=F.coalesce(F.col("sites"), F.array().cast(SITE_TYPE)))


# ---------------------------------------------------------------------------
# R2 file_expand


def find_file(mentions: DataFrame, idx: CodeIndex, mention: str = "mention", match: str = "contains") -> DataFrame:
    """``(repo_id, mention, resolved)``: the first path (path order) containing the mention.

    ``match="suffix"`` instead equi-joins the mention with the path suffixes
    that start at a ``/`` (cheaper; it can pick another file than the first
    one containing the text).
    """
    if match == "suffix":
        parts = F.split(F.col("path"), "/")
        sufs = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
        s = idx.files.select("repo_id", "path", F.explode(sufs).alias(mention))
        return (mentions.select("repo_id", mention).distinct().join(s, ["repo_id", mention])
                .groupBy("repo_id", mention).agg(F.min("path").alias("resolved")))
    return first_containing(mentions.select("repo_id", mention), needle=mention, value="path", order="path",
                            out="resolved", index=idx.path_grams)


def find_files(mentions: DataFrame, idx: CodeIndex, mention: str = "mention") -> DataFrame:
    """Every path containing the mention."""
    from packtables.operators.lookup import containing

    return containing(mentions.select("repo_id", mention), needle=mention, value="path", index=idx.path_grams)


def file_expand_strategy(signals: DataFrame, idx: CodeIndex, opts: PackOptions) -> DataFrame:
    m = (signals.filter(gate("file_expand"))
         .select("request_id", "repo_id", F.posexplode("file_mentions").alias("m_pos", "mention")))
    res = m.join(find_file(m, idx, match=opts.file_match), ["repo_id", "mention"])
    own = res.select("request_id", "repo_id", "m_pos", F.col("resolved").alias("path"),
                     F.lit(-1).cast("long").alias("k3"), F.lit(0).cast("long").alias("k4"))
    deps = (res.join(idx.edges.select("repo_id", F.col("src").alias("resolved"), "dst", "line", "col"),
                     ["repo_id", "resolved"])
            .select("request_id", "repo_id", "m_pos", F.col("dst").alias("path"),
                    F.col("line").cast("long").alias("k3"), F.col("col").cast("long").alias("k4")))
    cand = own.unionByName(deps)
    # Only files with content; D3 / J10: first entry per path wins; keys only, the texts come last
    full = idx.files.filter(F.col("content") != "")
    cand = (cand.join(full.select("repo_id", "path"), ["repo_id", "path"], "left_semi").groupBy("request_id", "repo_id", "path")
            .agg(F.min(F.struct("m_pos", "k3", "k4")).alias("_f")).select("request_id", "repo_id", "path", "_f.*"))
    cand = cand.join(full.select("repo_id", "path", "content"), ["repo_id", "path"])
    return entries(cand, "files", pos=pos(0, F.col("m_pos"), "", F.col("k3"), F.col("k4")))


# ---------------------------------------------------------------------------
# R3 semantic and R5 convention


def semantic_hits(signals: DataFrame, query_vectors: DataFrame, chunks: DataFrame, opts: PackOptions) -> DataFrame:
    """J12 once per request with k = semantic_k; conventions take ranks <= convention_k (Q16)."""
    q = (signals.filter(gate("semantic")).select("request_id", "repo_id")
         .join(query_vectors, "request_id")
         .select("repo_id", F.col("request_id").alias("query_id"), F.col("embedding").alias("vec")))
    c = chunks.select("repo_id", "chunk_id", F.col("embedding").alias("vec"))
    hits = vectors.search(q, c, k=max(opts.semantic_k, opts.convention_k), threshold=opts.semantic_threshold,
                          group="repo_id", query_block_rows=opts.knn_query_block_rows,
                          chunk_block_rows=opts.knn_chunk_block_rows)
    return (hits.withColumnRenamed("query_id", "request_id")
            .join(chunks.select("repo_id", "chunk_id", "path", "text"), ["repo_id", "chunk_id"]))


def semantic_strategy(hits: DataFrame, opts: PackOptions) -> DataFrame:
    h = hits.filter(F.col("rank") <= opts.semantic_k)
    # One chunk per (path, first 100 characters); the best-ranked wins
    w = Window.partitionBy("request_id", "path", F.substring("text", 1, 100)).orderBy("rank")
    h = h.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    return entries(h, "semantic_matches", pos=pos(0, F.col("rank")), content=F.col("text"))


def convention_strategy(hits: DataFrame, signals: DataFrame, opts: PackOptions) -> DataFrame:
    ok = signals.filter(gate("convention")).select("request_id")
    h = hits.filter(F.col("rank") <= opts.convention_k).join(ok, "request_id", "left_semi")
    return entries(h, "conventions", pos=pos(0, F.col("rank")), content=F.col("text"))


# ---------------------------------------------------------------------------
# R4 blast radius and R6 git context


def pack_paths(*parts: DataFrame) -> DataFrame:
    """Distinct file paths of symbol and file entries per request."""
    u = None
    for p in parts:
        s = p.filter(F.col("section").isin("symbols", "files")).select("request_id", "repo_id", "path")
        u = s if u is None else u.unionByName(s)
    return u.distinct()


def blast_radius_strategy(signals: DataFrame, idx: CodeIndex, sym: DataFrame, files: DataFrame,
                          opts: PackOptions) -> DataFrame:
    req = signals.filter(gate("blast_radius")).select("request_id")
    from packtables.session import cut_lineage

    seeds = cut_lineage(pack_paths(sym, files).join(req, "request_id", "left_semi"))
    # each distinct seed is expanded once, whatever the number of requests that hold it
    dep = graph.dependents(seeds.select("repo_id", "path").distinct(), idx.edges, max_hops=opts.blast_hops)
    dep = dep.withColumnRenamed("dependent", "path").join(
        seeds.withColumnRenamed("path", "seed"), ["repo_id", "seed"]).select("request_id", "repo_id", "seed", "path")
    # Skip files already in the pack; J9: only files with content
    dep = dep.join(files.select("request_id", "path"), ["request_id", "path"], "left_anti")
    full = idx.files.filter(F.col("content") != "")
    dep = dep.join(full.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    # the first seed (path order) that reaches a file names it; the texts come last
    dep = dep.groupBy("request_id", "repo_id", "path").agg(F.min("seed").alias("seed"))
    dep = dep.join(full.select("repo_id", "path", "content"), ["repo_id", "path"])
    return entries(dep, "files", pos=pos(1, 0, F.col("seed"), 0, 0, F.col("path")),
                   content=head_summary("content", "seed"))


def git_strategy(signals: DataFrame, commits_of: Callable[[DataFrame], DataFrame], *parts: DataFrame,
                 opts: PackOptions) -> DataFrame:
    """Up to ``pack_commits`` recent commits for every pack path (after blast radius).

    ``commits_of(paths)`` gives the rows of the commit summary for some ``paths(repo_id, path)`` (``StrategyInputs.commits_of``).
    """
    from packtables.session import cut_lineage

    req = signals.filter(gate("git_ctx")).select("request_id")
    paths = cut_lineage(pack_paths(*parts).join(req, "request_id", "left_semi"))
    recent = commits_of(paths.select("repo_id", "path")).filter(F.col("rank") <= opts.pack_commits)
    j = paths.join(recent, ["repo_id", "path"])
    g = (j.groupBy("request_id", "repo_id", "path")
         .agg(F.array_sort(F.collect_list(F.struct("rank", "hash", "message", "author", "date"))).alias("_c")))
    commits = F.transform("_c", lambda c: F.struct(c["hash"].alias("hash"), c["message"].alias("message"),
                                                   c["author"].alias("author"), c["date"].alias("date")))
    return entries(g, "git_context", pos=pos(0, 0, F.col("path")), commits=commits)


@dataclass
class StrategyInputs:
    signals: DataFrame          # request_id, repo_id, task_type, symbols, file_mentions, ...
    index: CodeIndex
    chunks: DataFrame           # repo_id, chunk_id, path, text, embedding
    query_vectors: DataFrame    # request_id, embedding
    commit_summary: DataFrame   # repo_id, path, rank, hash, message, author, date

    def commits_of(self, paths: DataFrame) -> DataFrame:
        """The rows of ``commit_summary`` for ``paths(repo_id, path)``."""
        return of_paths(self.commit_summary, paths)


@dataclass
class Strategy:
    """U4: a user strategy. ``fn(signals, inputs, opts)`` returns rows for
    ``entries(df, section, ...)``; it runs for requests where ``gate`` holds,
    after the built-in strategies."""
    name: str
    gate: Column
    fn: object


#: What building a frame raises for a missing table or column, or a bad option; Spark jobs raise none of these.
PLANNING = (AnalysisException, AttributeError, KeyError, TypeError, ValueError)


def run_strategies(inp: StrategyInputs, opts: PackOptions = PackOptions(),
                   extra: list[Strategy] | tuple = (), materialize: bool = False, errors: list | None = None) -> DataFrame:
    """R1-R7 staged: returns all pack entries before budgeting.

    R8: a built-in strategy that cannot be planned (missing input table, bad
    option) contributes nothing; the others still run. The failure is logged
    and, if ``errors`` is given, appended to it as (strategy, error);
    ``strategy_errors`` makes a table of it. A Spark job of a built-in strategy
    that fails raises. A user strategy that fails, when planned or while its
    result is written, is listed in the same way. With ``materialize`` the
    stage-0 results that later stages read again (symbol and file entries,
    vector hits) are written once to the shared checkpoint folder, and so are
    user strategies, so that one that fails at run time fails alone.
    """
    from packtables.session import cut_lineage

    keep = cut_lineage if materialize else (lambda df: df)

    def safe(name, fn, caught=PLANNING):
        try:
            return fn()
        except caught as e:
            logging.getLogger(__name__).warning("strategy %s failed: %s", name, e)
            if errors is not None:
                errors.append((name, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
            return None

    sig = inp.signals
    def kept(name, fn):
        df = safe(name, fn)
        return keep(df) if df is not None else None     # a failing job raises

    sym = kept("symbol", lambda: symbol_strategy(sig, inp.index, opts))
    fil = kept("file_expand", lambda: file_expand_strategy(sig, inp.index, opts))
    hits = kept("semantic", lambda: semantic_hits(sig, inp.query_vectors, inp.chunks, opts))
    sem = safe("semantic", lambda: semantic_strategy(hits, opts)) if hits is not None else None
    conv = safe("convention", lambda: convention_strategy(hits, sig, opts)) if hits is not None else None
    empty = entries(sig.limit(0), "files")
    sym_ = sym if sym is not None else empty
    fil_ = fil if fil is not None else empty
    blast = safe("blast_radius", lambda: blast_radius_strategy(sig, inp.index, sym_, fil_, opts))
    blast_ = blast if blast is not None else empty
    git = safe("git_ctx", lambda: git_strategy(sig, inp.commits_of, sym_, fil_, blast_, opts=opts))
    custom = [safe(st.name, lambda st=st: keep(st.fn(sig.filter(st.gate), inp, opts)), Exception) for st in extra]
    out = None
    for part in (sym, fil, sem, blast, conv, git, *custom):
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out if out is not None else empty


def strategy_errors(spark, errors: list) -> DataFrame:
    """``strategy, error`` of the strategies that failed."""
    return spark.createDataFrame(errors, "strategy string, error string")
