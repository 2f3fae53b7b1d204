"""Index build (L1): files -> symbols / imports / calls / edges / chunks (+ stats).

``build_index`` parses each file once: the tagged extraction rows are
checkpointed in the shared checkpoint folder and every index table is a
projection of them; with ``path`` all tables become a new version of a store.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packtables.functions.text import chunk_text
from packtables.operators import code, graph
from packtables.operators.imports import extract_imports
from packtables.options import PackOptions
from packtables.session import cut_lineage


@dataclass
class CodeIndex:
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    calls: DataFrame
    errors: DataFrame
    keys: DataFrame
    edges: DataFrame
    materialize: bool = True
    vectors: DataFrame | None = None        # stored chunks with vectors, if the index was loaded

    @property
    def chunks(self) -> DataFrame:
        return chunks_of(self.symbols)

    @cached_property
    def names(self) -> DataFrame:
        """Distinct symbol names with their first definition (insertion order of the reference)."""
        n = self.symbols.groupBy("repo_id", "name").agg(F.min(F.struct("path", "start_line", "col")).alias("first"))
        return cut_lineage(n) if self.materialize else n

    @cached_property
    def name_grams(self):
        """Trigram index of symbol names (J2 partial matches)."""
        from packtables.operators.lookup import GramIndex

        return GramIndex(self.names, "name", q=3, materialize=self.materialize)

    @cached_property
    def path_grams(self):
        """Trigram index of file paths."""
        from packtables.operators.lookup import GramIndex

        return GramIndex(self.files.select("repo_id", "path"), "path", q=3, materialize=self.materialize)


def chunks_of(symbols: DataFrame, max_chars: int = 2000) -> DataFrame:
    """Function and method bodies, cut at ``max_chars``; classes and empty bodies excluded."""
    s = symbols.filter(F.col("kind").isin("function", "method") & (F.col("body") != ""))
    return s.select("repo_id", F.xxhash64("repo_id", "path", "start_line", "col", "name").alias("chunk_id"),
                    "path", "start_line", "end_line", chunk_text("body", max_chars).alias("text"))


def _index_of(files: DataFrame, tagged: DataFrame, imports: DataFrame, edges: DataFrame, materialize: bool,
              vectors: DataFrame | None = None) -> CodeIndex:
    return CodeIndex(files=files, symbols=code.symbols_of(tagged), imports=imports, calls=code.calls_of(tagged),
                     errors=code.errors_of(tagged), keys=graph.path_keys(files), edges=edges, materialize=materialize,
                     vectors=vectors)


def build_index(files: DataFrame, opts: PackOptions = PackOptions(), path: str | None = None,
                materialize: bool = True, num_partitions: int | None = None, scanners: dict | None = None,
                repos: DataFrame | None = None, embedder=None, dim: int = 64) -> CodeIndex:
    """The index of ``files``; with ``path`` it becomes a new version of that store.

    The stored version holds files, extraction rows, imports, edges, chunks with their
    vectors (S7: vectors of equal text are taken from the version before), and the chunks whose batch the
    embedder failed on, with its error (they are embedded anew by the next build). It
    covers the repositories of ``files`` and those of ``repos``: a covered
    repository that has no files any more is empty afterwards.
    """
    tagged = code.extract(files, num_partitions, scanners)
    if path or materialize:
        tagged = cut_lineage(tagged)
    imports = extract_imports(files)
    if path or materialize:
        imports = cut_lineage(imports)
    edges = graph.build_edges(imports, files)
    if path:
        from packtables.sources.store import read_index, write_index

        spark = files.sparkSession
        idx = _index_of(files, tagged, imports, edges, materialize)
        stored = read_index(spark, path).get("chunks")
        if stored is not None:
            stored = stored.select("repo_id", F.md5("text").alias("content_hash"), "embedding")
        chunks = cut_lineage(embed_chunks(idx, stored, embedder, dim, checked=True))
        failed = chunks.filter("embedding is null").select("repo_id", "path", "chunk_id", F.col("embedding_error").alias("error"))
        chunks = chunks.filter("embedding is not null").select("repo_id", "chunk_id", "path", "start_line", "end_line", "text", "embedding")
        covered = files.select("repo_id")
        if repos is not None:
            covered = covered.union(repos.select("repo_id"))
        write_index({"files": files, "tagged": tagged, "imports": imports, "edges": edges, "chunks": chunks, "embed_errors": failed}, path, repos=covered)
        return load_index(spark, path)
    if materialize:
        edges = cut_lineage(edges)      # read by file expansion, blast radius and stats
    return _index_of(files, tagged, imports, edges, materialize)


def load_index(spark, path: str, repos: list[str] | None = None) -> CodeIndex:
    """The newest stored index, without parsing or embedding anything."""
    from packtables.sources.store import read_index

    t = read_index(spark, path, repos)
    idx = _index_of(t["files"], t["tagged"], t["imports"], t["edges"], materialize=True, vectors=t["chunks"])
    if "embed_errors" in t:
        idx.errors = idx.errors.unionByName(t["embed_errors"].select("repo_id", "path", "error"))
    return idx


def index_status(idx: CodeIndex, as_of=None) -> DataFrame:
    """A1: per repo file, symbol and chunk counts and ``last_indexed``, the time of the snapshot.

    ``as_of`` is that time: a literal, a column of ``idx.files`` (its latest value per repo), or None (not known).
    """
    at = F.lit(as_of).cast("timestamp") if as_of is None or isinstance(as_of, str) and as_of not in idx.files.columns \
        else F.max(F.col(as_of)) if isinstance(as_of, str) else F.lit(as_of)
    f = idx.files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("file_count"), at.alias("last_indexed"))
    s = idx.symbols.groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbol_count"))
    c = idx.chunks.groupBy("repo_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return f.join(s, "repo_id", "left").join(c, "repo_id", "left").fillna(0, ["symbol_count", "chunk_count"])


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    """A2: chunk count per file, plus per-repo totals of chunks and files."""
    per = chunks.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("n_chunks"))
    tot = per.groupBy("repo_id").agg(F.sum("n_chunks").alias("total_chunks"), F.count(F.lit(1)).alias("total_files"))
    return per.join(tot, "repo_id")


def embed_chunks(idx: CodeIndex, stored: DataFrame | None = None, embedder=None, dim: int = 64, checked: bool = False) -> DataFrame:
    """Chunks with vectors (U1 + S7): stored vectors are reused by (repo, content hash),
    only new chunk text goes through the embedder. ``checked`` keeps the rows that it failed on, with ``embedding_error``."""
    from packtables.operators.vectors import embed_checked, embed_column
    from packtables.sources.store import reuse_or_embed

    chunks = idx.chunks
    if stored is None:
        return (embed_checked if checked else embed_column)(chunks, "text", "embedding", embedder=embedder, dim=dim)
    return reuse_or_embed(chunks, stored, "text", embedder=embedder, dim=dim, checked=checked)


def embed_queries(signals: DataFrame, embedder=None, dim: int = 64) -> DataFrame:
    """Query vectors from each request's scope hint (the text the reference embeds)."""
    from packtables.operators.vectors import embed_column

    return embed_column(signals.select("request_id", "scope_hint"), "scope_hint", "embedding",
                        embedder=embedder, dim=dim).select("request_id", "embedding")
