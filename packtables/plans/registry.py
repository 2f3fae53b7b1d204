"""

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole driver
tables (or tables Spark derives from them). Arrays are rendered as
blank-joined strings and floats rounded to 6 places so that the DuckDB
oracle can be compared value by value.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packtables.functions import signals as sig
from packtables.functions import text as tx
from packtables.functions.tokens import count_tokens
from packtables.operators import vectors
from packtables.operators.docpacks import budget_documents
from packtables.options import PackOptions
from packtables.plans.strategies import StrategyInputs
from packtables.session import cut_lineage, read_table

OPTS = PackOptions()


def q_signals(spark: SparkSession, sf: str) -> DataFrame:
    """P1-P7 over every conversation (user turns only)."""
    prompts = sig.prompts_from_turns(read_table(spark, sf, "conversations"))
    s = sig.with_signals(prompts)
    return s.select("request_id", "task_type",
                    F.array_join("symbols", " ").alias("symbols"),
                    F.array_join("file_mentions", " ").alias("file_mentions"),
                    F.length("raw_prompt").alias("prompt_chars"),
                    (F.col("scope_hint") == F.col("raw_prompt")).cast("int").alias("scope_is_prompt"),
                    "fingerprint")


def q_vector_knn(spark: SparkSession, sf: str) -> DataFrame:
    """J12 + W1 + P12: every vector's 8 nearest other vectors, threshold after k."""
    emb = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    hits = vectors.search(emb.withColumnRenamed("id", "query_id"), emb.withColumnRenamed("id", "chunk_id"),
                          k=OPTS.semantic_k, threshold=OPTS.semantic_threshold, exclude_self=True)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def q_vector_approx(spark: SparkSession, sf: str) -> DataFrame:
    """The same search by keys of random projections, so some neighbours are missing; no SQL gives its rows."""
    emb = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    hits = vectors.search(emb.withColumnRenamed("id", "query_id"), emb.withColumnRenamed("id", "chunk_id"),
                          k=OPTS.semantic_k, threshold=OPTS.semantic_threshold, exclude_self=True, approximate=True)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def q_budget_documents(spark: SparkSession, sf: str) -> DataFrame:
    """B1/B2/W4/W5 + P16: each source is a pack of file entries trimmed to 6000 tokens."""
    b = budget_documents(read_table(spark, sf, "documents"), OPTS.max_pack_tokens)
    return b.select("source", "doc_id", "tokens", "remaining", F.col("applied").cast("int").alias("dropped"),
                    "final_tokens")


def q_text_helpers(spark: SparkSession, sf: str) -> DataFrame:
    """P9, P10, P11, P15, P16 on every document."""
    d = read_table(spark, sf, "documents")
    seed = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"))
    return d.select(
        "doc_id",
        count_tokens("text").alias("tokens"),
        F.md5(tx.truncate_lines("text", OPTS.symbol_max_body_lines)).alias("truncated_md5"),
        F.md5(tx.head_summary("text", seed)).alias("summary_md5"),
        F.md5(tx.chunk_text("text", OPTS.chunk_chars)).alias("chunk_md5"),
        F.md5(tx.xml_escape("text")).alias("escaped_md5"),
        F.md5(tx.cdata("text")).alias("cdata_md5"))


QUERIES = {
    "signals": q_signals,
    "vector_knn": q_vector_knn,
    "vector_approx": q_vector_approx,
    "budget_documents": q_budget_documents,
    "text_helpers": q_text_helpers,
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Compiled, budgeted context packs (one row per request)."""
    return q_packs(spark, sf)


# ---------------------------------------------------------------------------
# Index tables over FX-files

_FIXTURES: dict = {}


def fixture(spark: SparkSession, sf: str):
    """One derived-input bundle per (session, folder) in this process; its index is built by the first query that reads it."""
    from packtables.session import measured
    from packtables.sources.fixtures import Fixture

    key = (spark.sparkContext.applicationId, sf)
    if key not in _FIXTURES:
        _FIXTURES[key] = Fixture(measured(spark), sf, OPTS)
    return _FIXTURES[key]


def q_code_symbols(spark, sf):
    s = fixture(spark, sf).index.symbols
    return s.select("path", "name", "kind", "start_line", "end_line", "signature", F.md5("body").alias("body_md5"))


def q_code_imports(spark, sf):
    i = fixture(spark, sf).index.imports
    return i.select("path", "source", F.array_join("names", " ").alias("names"), "line")


def q_code_calls(spark, sf):
    return fixture(spark, sf).index.calls.select("path", "symbol_name", "line")


def q_path_keys(spark, sf):
    return fixture(spark, sf).index.keys.select("key", "path")


def q_dep_edges(spark, sf):
    return fixture(spark, sf).index.edges.select("src", "dst")


def q_dependents(spark, sf):
    from packtables.operators.graph import dependents

    idx = fixture(spark, sf).index
    d = dependents(idx.files.select("repo_id", "path"), idx.edges, max_hops=OPTS.blast_hops)
    return d.select("seed", "dependent", "hops")


def q_dependencies(spark, sf):
    from packtables.operators.graph import dependencies

    idx = fixture(spark, sf).index
    return dependencies(idx.files.select("repo_id", "path"), idx.edges).select("path", "dependency")


def q_index_stats(spark, sf):
    from packtables.operators.graph import graph_size
    from packtables.plans.index import index_status

    idx = fixture(spark, sf).index
    st = index_status(idx, F.lit(AS_OF).cast("timestamp")).withColumn("last_indexed", F.date_format("last_indexed", "yyyy-MM-dd HH:mm:ss"))
    return st.join(graph_size(idx.files, idx.edges), "repo_id")


def q_chunks_per_file(spark, sf):
    from packtables.plans.index import chunks_per_file

    return chunks_per_file(fixture(spark, sf).index.chunks).select("path", "n_chunks", "total_chunks", "total_files")


def q_definitions_by_name(spark, sf):
    from packtables.operators.code import definitions_by_name

    return definitions_by_name(fixture(spark, sf).index.symbols).select(
        "name", "n_definitions", "first_path", "first_line")


def q_path_filters(spark, sf):
    from packtables.sources.files import excluded, watched
    from packtables.sources.fixtures import paths_from_parts

    p = paths_from_parts(read_table(spark, sf, "part"))
    return p.select("path", excluded("path", OPTS.exclude).cast("int").alias("excluded"),
                    watched("path").cast("int").alias("watched"))


QUERIES.update({
    "code_symbols": q_code_symbols,
    "code_imports": q_code_imports,
    "code_calls": q_code_calls,
    "path_keys": q_path_keys,
    "dep_edges": q_dep_edges,
    "dependents": q_dependents,
    "dependencies": q_dependencies,
    "index_stats": q_index_stats,
    "chunks_per_file": q_chunks_per_file,
    "definitions_by_name": q_definitions_by_name,
    "path_filters": q_path_filters,
})


# ---------------------------------------------------------------------------
# Retrieval, budgeting and packs over FX-requests (R1-R8, J1-J5, J9-J13,
# D1-D6, P13, P14, B1-B9, A3)

AS_OF = "2001-09-01 00:00:00"


class FixtureInputs(StrategyInputs):
    """``StrategyInputs`` of a fixture; a table that is not given is made, and written once, by the first query that reads it."""

    def __init__(self, fx=None, **given):
        self._fx = fx
        self.__dict__.update(given)

    @cached_property
    def signals(self):
        return cut_lineage(sig.with_signals(self._fx.requests, word_boundaries=OPTS.word_boundaries,
                                            symbol_stop_words=OPTS.symbol_stop_words,
                                            trim_file_dots=OPTS.trim_file_dots))

    @cached_property
    def index(self):
        return self._fx.index

    @cached_property
    def chunks(self):
        return self._fx.chunks

    @cached_property
    def query_vectors(self):
        return self._fx.query_vectors

    @cached_property
    def commit_summary(self):
        from packtables.operators.history import commit_summary, recent_commits

        recent = recent_commits(self._fx.commits, self._fx.commit_files, OPTS.default_commits)
        return cut_lineage(commit_summary(recent, F.lit(AS_OF).cast("timestamp")))

    def commits_of(self, paths):
        from packtables.operators.history import commit_summary, recent_commits

        if "commit_summary" in self.__dict__:           # given, or written for the query of all paths
            return super().commits_of(paths)
        recent = recent_commits(self._fx.commits, self._fx.commit_files_of(paths), OPTS.default_commits)
        return commit_summary(recent, F.lit(AS_OF).cast("timestamp"))


def strategy_inputs(spark: SparkSession, sf: str):
    fx = fixture(spark, sf)
    if not hasattr(fx, "inputs"):
        fx.inputs = FixtureInputs(fx)
    return fx.inputs


def _sites_text(c):
    return F.array_join(F.transform(c, lambda s: F.concat(s["path"], F.lit(":"), s["line"].cast("string"))), ",")


def q_routing(spark, sf):
    from packtables.plans.strategies import routes

    return routes(strategy_inputs(spark, sf).signals)


def q_symbol_strategy(spark, sf):
    from packtables.plans.strategies import symbol_strategy

    inp = strategy_inputs(spark, sf)
    e = symbol_strategy(inp.signals, inp.index, OPTS)
    return e.select("request_id", "name", "path", "line", "signature", F.md5("body").alias("body_md5"),
                    _sites_text(F.col("sites")).alias("sites"), F.col("pos.k1").alias("mention_rank"))


def q_find_file(spark, sf):
    from packtables.plans.strategies import find_file

    inp = strategy_inputs(spark, sf)
    m = inp.signals.select("repo_id", F.explode("file_mentions").alias("mention")).distinct()
    return find_file(m, inp.index).select("mention", "resolved")


def q_file_expand(spark, sf):
    from packtables.plans.strategies import file_expand_strategy

    inp = strategy_inputs(spark, sf)
    e = file_expand_strategy(inp.signals, inp.index, OPTS)
    return e.select("request_id", "path", F.md5("content").alias("content_md5"),
                    F.col("pos.k1").alias("mention_rank"), F.col("pos.k3").alias("import_line"))


def q_semantic(spark, sf):
    from packtables.plans.strategies import semantic_hits, semantic_strategy

    inp = strategy_inputs(spark, sf)
    hits = semantic_hits(inp.signals, inp.query_vectors, inp.chunks, OPTS)
    e = semantic_strategy(hits, OPTS)
    return e.select("request_id", "path", F.col("pos.k1").alias("rank"), F.round("score", 6).alias("score"),
                    F.md5("content").alias("text_md5"))


def q_convention(spark, sf):
    from packtables.plans.strategies import convention_strategy, semantic_hits

    inp = strategy_inputs(spark, sf)
    hits = semantic_hits(inp.signals, inp.query_vectors, inp.chunks, OPTS)
    e = convention_strategy(hits, inp.signals, OPTS)
    return e.select("request_id", "path", F.col("pos.k1").alias("rank"), F.md5("content").alias("text_md5"))


def _stage0(inp):
    """Symbol and file entries, written once (as ``compile_packs`` does) for the later stages."""
    from packtables.plans.strategies import file_expand_strategy, symbol_strategy

    if not hasattr(inp, "stage0"):
        inp.stage0 = (cut_lineage(symbol_strategy(inp.signals, inp.index, OPTS)),
                      cut_lineage(file_expand_strategy(inp.signals, inp.index, OPTS)))
    return inp.stage0


def q_blast_radius(spark, sf):
    from packtables.plans.strategies import blast_radius_strategy

    inp = strategy_inputs(spark, sf)
    sym, fil = _stage0(inp)
    e = blast_radius_strategy(inp.signals, inp.index, sym, fil, OPTS)
    return e.select("request_id", "path", F.col("pos.k2").alias("seed"), F.md5("content").alias("content_md5"))


def q_recent_commits(spark, sf):
    s = strategy_inputs(spark, sf).commit_summary
    return s.select("path", "rank", "hash", "message", "author", "date")


def q_git_context(spark, sf):
    from packtables.plans.strategies import blast_radius_strategy, git_strategy

    inp = strategy_inputs(spark, sf)
    sym, fil = _stage0(inp)
    blast = blast_radius_strategy(inp.signals, inp.index, sym, fil, OPTS)
    e = git_strategy(inp.signals, inp.commits_of, sym, fil, blast, opts=OPTS)
    commits = F.array_join(F.transform("commits", lambda c: F.concat_ws("|", c["hash"], c["message"], c["author"],
                                                                        c["date"])), ";")
    return e.select("request_id", "path", commits.alias("commits"))


def compiled_packs(spark, sf):
    from packtables.plans.packs import compile_packs

    fx = fixture(spark, sf)
    if not hasattr(fx, "packs"):
        errors = []
        packs = compile_packs(strategy_inputs(spark, sf), OPTS, errors=errors)
        if errors:      # no smaller packs without a word
            raise RuntimeError(f"strategies failed: {errors}")
        fx.packs = packs
    return fx.packs


def q_packs(spark, sf):
    p = compiled_packs(spark, sf)
    return p.select("request_id", "task_id", "token_count", "n_symbols", "n_files", "n_semantic_chunks",
                    "n_conventions", "n_git_entries", F.md5("xml").alias("xml_md5"))


def q_enriched(spark, sf):
    from packtables.plans.packs import enrich_turns

    e = enrich_turns(fixture(spark, sf).table("conversations"), compiled_packs(spark, sf))
    return e.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def q_preview(spark, sf):
    from packtables.plans.packs import preview

    return preview(strategy_inputs(spark, sf).signals, compiled_packs(spark, sf))


QUERIES.update({
    "routing": q_routing,
    "symbol_strategy": q_symbol_strategy,
    "find_file": q_find_file,
    "file_expand": q_file_expand,
    "semantic": q_semantic,
    "convention": q_convention,
    "blast_radius": q_blast_radius,
    "recent_commits": q_recent_commits,
    "git_context": q_git_context,
    "packs": q_packs,
    "enriched": q_enriched,
    "preview": q_preview,
})


def q_call_sites(spark, sf):
    """First five call sites of every defined name, in file order."""
    from packtables.plans.strategies import call_sites

    idx = fixture(spark, sf).index
    names = idx.symbols.select("repo_id", "name").distinct()
    sites = call_sites(idx.calls, names, OPTS.max_call_sites)
    return names.join(sites, ["repo_id", "name"], "left").select(
        "name", F.coalesce(_sites_text(F.col("sites")), F.lit("")).alias("sites"))


QUERIES["call_sites"] = q_call_sites


# ---------------------------------------------------------------------------
# Change feed, request stream and persistence (batch twins of T1-T5, S7, A4)

CHANGE_GAP_SECONDS = 600          # tests use 10 minutes (events are minutes apart)
SNAPSHOT_CUTOFF = "2024-01-15 00:00:00"


def q_debounce_sessions(spark, sf):
    from packtables.streaming.changes import sessions

    ch = fixture(spark, sf).changes
    return sessions(ch, f"{CHANGE_GAP_SECONDS} seconds").select("repo_id", "session_start", "last_ts", "n_changes")


def q_debounce_flush(spark, sf):
    from packtables.streaming.changes import flush_rows

    ch = fixture(spark, sf).changes
    return flush_rows(ch, CHANGE_GAP_SECONDS).select("repo_id", "session_start", "path", "change_type", "seq")


def _incremental_index(spark, sf):
    """Initial build from the changes before a cutoff, then one flush with the rest."""
    from packtables.operators import code
    from packtables.streaming.changes import apply_flush, last_state

    fx = fixture(spark, sf)
    if not hasattr(fx, "incremental"):
        ch = fx.changes
        cut = F.lit(SNAPSHOT_CUTOFF).cast("timestamp")
        files0 = cut_lineage(last_state(ch.filter(F.col("ts") < cut)))
        tagged0 = cut_lineage(code.extract(files0))
        out = apply_flush(files0, tagged0, ch.filter(F.col("ts") >= cut))
        fx.incremental = (cut_lineage(out.files), cut_lineage(out.tagged), out.edges)
    return fx.incremental


PARTIAL_REPO = "1"                # the second flush touches this repository alone


def _partial_index(spark, sf):
    """Initial build from the changes before a cutoff, then a flush of one repository; tables of all repositories."""
    from packtables.operators import code, graph
    from packtables.operators.imports import extract_imports
    from packtables.operators.vectors import embed_column
    from packtables.plans.index import chunks_of
    from packtables.streaming.changes import apply_flush, last_state

    fx = fixture(spark, sf)
    if not hasattr(fx, "partial"):
        ch = fx.changes
        cut = F.lit(SNAPSHOT_CUTOFF).cast("timestamp")
        files0 = cut_lineage(last_state(ch.filter(F.col("ts") < cut)))
        tagged0 = cut_lineage(code.extract(files0))
        edges0 = cut_lineage(graph.build_edges(extract_imports(files0), files0))
        chunks0 = cut_lineage(embed_column(chunks_of(code.symbols_of(tagged0)), "text", "embedding", dim=8))
        fx.partial = apply_flush(files0, tagged0, ch.filter((F.col("ts") >= cut) & (F.col("repo_id") == PARTIAL_REPO)),
                                 edges=edges0, chunks=chunks0, dim=8)
    return fx.partial


def q_flush_one_repo(spark, sf):
    """T3 + T4: files, edges and chunks (with vectors) of all repositories after a flush that touches one of them."""
    out = _partial_index(spark, sf)
    files = out.files.select("repo_id", F.lit("file").alias("kind"), F.col("path").alias("a"), F.md5("content").alias("b"))
    edges = out.edges.select("repo_id", F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    full = F.when(F.size("embedding") == 8, F.md5("text"))
    chunks = out.chunks.select("repo_id", F.lit("chunk").alias("kind"), F.col("path").alias("a"), full.alias("b"))
    return files.unionByName(edges).unionByName(chunks)


def q_store_history(spark, sf):
    """S7 + S8 + T7: three builds of a store, a flush of all later changes, a compaction; files and edges as stored then.

    Repository 1 has no name (null) here. The first build is out of date and is replaced by the second.
    """
    import uuid

    from packtables.operators import code, graph
    from packtables.operators.imports import extract_imports
    from packtables.session import ensure_checkpoint_dir
    from packtables.sources.store import compact, read_index, write_index
    from packtables.streaming.changes import flush_store, last_state

    fx = fixture(spark, sf)
    spark = fx.spark
    ch = fx.changes.withColumn("repo_id", F.when(F.col("repo_id") != PARTIAL_REPO, F.col("repo_id")))
    cut = F.lit(SNAPSHOT_CUTOFF).cast("timestamp")
    files = cut_lineage(last_state(ch.filter(F.col("ts") < cut)))
    imports = cut_lineage(extract_imports(files))
    built = {"files": files, "tagged": cut_lineage(code.extract(files)), "imports": imports, "edges": cut_lineage(graph.build_edges(imports, files))}
    odd = F.coalesce(F.pmod(F.crc32("repo_id"), F.lit(2)) == 1, F.lit(True))
    store = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    write_index({"files": files.filter(odd).withColumn("content", F.lit("")), "edges": built["edges"].filter(odd)}, store)
    write_index({t: df.filter(odd) for t, df in built.items()}, store)
    write_index({t: df.filter(~odd) for t, df in built.items()}, store)
    flush_store(spark, store, ch.filter(F.col("ts") >= cut), "query", 0, dim=8)
    compact(spark, store, ratio=0.5)
    now = read_index(spark, store)
    stored = now["files"].select("repo_id", F.lit("file").alias("kind"), F.col("path").alias("a"), F.md5("content").alias("b"))
    return stored.unionByName(now["edges"].select("repo_id", F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


def q_find_files(spark, sf):
    """Every path that contains a mention."""
    from packtables.plans.strategies import find_files

    inp = strategy_inputs(spark, sf)
    m = inp.signals.select("repo_id", F.explode("file_mentions").alias("mention")).distinct()
    return find_files(m, inp.index).select("mention", "path")


def q_definitions(spark, sf):
    """A5: the definitions of every name in file order."""
    from packtables.operators.code import definitions

    return definitions(fixture(spark, sf).index.symbols).select(
        "name", F.col("rank").cast("int").alias("rank"), "path", "start_line", "kind")


def q_changes_final_symbols(spark, sf):
    from packtables.operators import code

    _, tagged, _ = _incremental_index(spark, sf)
    return code.symbols_of(tagged).select("repo_id", "path", "name", "kind", "start_line", "end_line")


def q_changes_final_edges(spark, sf):
    _, _, edges = _incremental_index(spark, sf)
    return edges.select("repo_id", "src", "dst")


def q_ttl_cache(spark, sf):
    from packtables.streaming.requests import ttl_compiles

    ev = read_table(spark, sf, "events").select("event_id", F.col("user_id").alias("fingerprint"), "ts",
                                                F.col("event_id").alias("seq"))
    t = ttl_compiles(ev, key="fingerprint", ts="ts", order="seq", ttl_seconds=OPTS.cache_ttl_seconds)
    return t.select("event_id", F.col("compiled").cast("int").alias("compiled"))


def q_request_log(spark, sf):
    from packtables.streaming.requests import log_from_events, request_log

    return request_log(log_from_events(read_table(spark, sf, "events")))


def q_vector_reuse(spark, sf):
    """Vectors already stored (earlier build: the English documents) are
    reused by (repo, content hash); only unseen content goes through the embedder
    (here one that returns the length and the number of words)."""
    from packtables.sources.store import reuse_or_embed

    docs = read_table(spark, sf, "documents").select(
        F.col("source").alias("repo_id"), F.col("doc_id").alias("chunk_id"), "text", "lang")
    stored = docs.filter(F.col("lang") == "en")
    stored = stored.select("repo_id", F.md5("text").alias("content_hash"),
                           F.array(F.length("text").cast("float")).alias("embedding"))
    out = reuse_or_embed(docs.drop("lang"), stored, "text", embedder=_size_embedder)
    return out.select("chunk_id", F.col("reused").cast("int").alias("reused"),
                      F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), " ").alias("vector"))


def _size_embedder():
    return lambda texts: [[len(t), t.count(" ")] for t in texts]


QUERIES.update({
    "debounce_sessions": q_debounce_sessions,
    "debounce_flush": q_debounce_flush,
    "changes_final_symbols": q_changes_final_symbols,
    "changes_final_edges": q_changes_final_edges,
    "flush_one_repo": q_flush_one_repo,
    "store_history": q_store_history,
    "find_files": q_find_files,
    "definitions": q_definitions,
    "ttl_cache": q_ttl_cache,
    "request_log": q_request_log,
    "vector_reuse": q_vector_reuse,
})


def q_chat_bodies(spark, sf):
    """S3 + P1 (wide form): conversations as JSON chat bodies, read back
    through VARIANT, prompt assembled from the user messages."""
    from packtables.sources.store import requests_from_bodies

    conv = read_table(spark, sf, "conversations")
    msgs = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
                       lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    bodies = conv.groupBy(F.col("conv_id").alias("request_id")).agg(
        F.to_json(F.struct(msgs.alias("messages"), F.lit(False).alias("stream"))).alias("body"))
    r = requests_from_bodies(bodies)
    return r.select("request_id", F.md5(sig.prompt_from_messages("messages")).alias("prompt_md5"),
                    F.size("messages").alias("n_messages"))


QUERIES["chat_bodies"] = q_chat_bodies
