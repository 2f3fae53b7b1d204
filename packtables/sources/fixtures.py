"""Index inputs derived from the driver tables (FIXTURES.md).

Each builder reads a driver table and derives, with Spark column functions,
the table the library works on: source files from ``part``, requests from
``conversations``, commits from ``orders``/``lineitem``, a change feed from
``events`` and chunk vectors from ``embeddings``. ``DUCKDB_VIEWS`` holds the
same derivations as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packtables.functions.signals import prompts_from_turns
from packtables.operators.code import language_of
from packtables.operators.history import of_paths
from packtables.operators.joins import sent
from packtables.options import PackOptions
from packtables.session import cut_lineage, read_table

REPO = "fx"


def _nl() -> Column:
    return F.lit("\n")


def _s(c: Column) -> Column:
    return c.cast("string")


def _ext(i: Column) -> Column:
    m = i % 5
    return (F.when(m == 0, ".py").when(m == 1, ".ts").when(m == 2, ".js").when(m == 3, ".go").otherwise(".tsx"))


def files_from_parts(part: DataFrame, repo_id: str = REPO) -> DataFrame:
    """FX-files: one generated source file per part.

    ``files(repo_id, file_id, path, ext, lang, content)``; ``path`` is
    repo-relative and orders files (the walk order of the reference).
    """
    n = part.select(F.count(F.lit(1))).scalar()
    i = F.col("p_partkey")
    a, b = (i * 7 + 1) % n, (i * 13 + 5) % n
    ext = _ext(i)
    py = F.concat(F.lit("from pkg"), _s(a % 20), F.lit(".mod_"), _s(a), F.lit(" import fn_"), _s(a), _nl(),
                  F.lit("import pkg"), _s(b % 20), F.lit(".mod_"), _s(b), _nl(), _nl(),
                  F.lit("class Cls"), _s(i), F.lit(":"), _nl(),
                  F.lit("    def run(self):"), _nl(),
                  F.lit("        return fn_"), _s(a), F.lit("(self)"), _nl(), _nl(),
                  F.lit("def fn_"), _s(i), F.lit("(x):"), _nl(),
                  F.lit("    return fn_"), _s(b), F.lit("(x)"), _nl())
    go = F.concat(F.lit("package pkg"), _s(i % 20), _nl(), _nl(),
                  F.lit("import ("), _nl(),
                  F.lit('  "pkg'), _s(a % 20), F.lit("/mod_"), _s(a), F.lit('"'), _nl(),
                  F.lit('  "pkg'), _s(b % 20), F.lit("/mod_"), _s(b), F.lit('"'), _nl(), F.lit(")"), _nl(), _nl(),
                  F.lit("type Cls"), _s(i), F.lit(" struct{}"), _nl(), _nl(),
                  F.lit("func (c *Cls"), _s(i), F.lit(") Run() int { return fn_"), _s(a), F.lit("(c) }"), _nl(), _nl(),
                  F.lit("func fn_"), _s(i), F.lit("(x int) int { return fn_"), _s(b), F.lit("(x) }"), _nl())
    js = F.concat(F.lit("import { fn_"), _s(a), F.lit(' } from "../pkg'), _s(a % 20), F.lit("/mod_"), _s(a),
                  F.lit('";'), _nl(),
                  F.lit('import * as m from "../pkg'), _s(b % 20), F.lit("/mod_"), _s(b), F.lit('";'), _nl(), _nl(),
                  F.lit("class Cls"), _s(i), F.lit(" {"), _nl(),
                  F.lit("  run() { return fn_"), _s(a), F.lit("(this); }"), _nl(), F.lit("}"), _nl(), _nl(),
                  F.lit("function fn_"), _s(i), F.lit("(x) {"), _nl(),
                  F.lit("  return m.fn_"), _s(b), F.lit("(x);"), _nl(), F.lit("}"), _nl())
    path = F.concat(F.lit("pkg"), _s(i % 20), F.lit("/mod_"), _s(i), ext)
    return part.select(
        F.lit(repo_id).alias("repo_id"), i.alias("file_id"), path.alias("path"), ext.alias("ext"),
        language_of(path).alias("lang"),
        F.when(ext == ".py", py).when(ext == ".go", go).otherwise(js).alias("content"))


def paths_from_parts(part: DataFrame) -> DataFrame:
    """FX-paths: paths for the exclude and watch filters."""
    k = F.col("p_partkey")
    head = (F.when(k % 5 == 0, "src").when(k % 5 == 1, "dist").when(k % 5 == 2, "node_modules/x")
            .when(k % 5 == 3, "lib/.next").otherwise("pkg/build"))
    tail = F.when(k % 4 == 0, ".py").when(k % 4 == 1, ".min.js").when(k % 4 == 2, ".ts").otherwise(".log")
    return part.select(F.concat(head, F.lit("/f"), _s(k), tail).alias("path"))


_TASK_WORDS = ("refactor", "fix", "add", "explain", "test", "ponder")


def requests_from_conversations(conversations: DataFrame, part: DataFrame, repo_id: str = REPO) -> DataFrame:
    """FX-requests: one request per conversation with a user turn.

    ``requests(request_id, repo_id, prompt)``; the prompt names a class, a
    partial symbol, an unknown symbol and a file of the FX-files repo, then the
    user turns.
    """
    n = part.select(F.count(F.lit(1))).scalar()
    users = conversations.filter(F.col("role") == "user")
    body = prompts_from_turns(users, out_col="conv_id").withColumnRenamed("prompt", "body")
    k = F.col("conv_id") % n
    word = F.lit(None).cast("string")
    m = F.col("conv_id") % 6
    word = F.when(m == 0, "refactor")
    for idx, w in enumerate(_TASK_WORDS[1:], start=1):
        word = word.when(m == idx, w)
    prompt = F.concat(word, F.lit(" Cls"), _s(k), F.lit(" and Cls"), _s(k), F.lit(".ru plus fnOne in pkg"),
                      _s(k % 20), F.lit("/mod_"), _s(k), _ext(k), _nl(), F.col("body"))
    return body.select(F.col("conv_id").alias("request_id"), F.lit(repo_id).alias("repo_id"), prompt.alias("prompt"))


def commits_from_orders(orders: DataFrame, repo_id: str = REPO) -> DataFrame:
    """FX-commits: ``commits(repo_id, hash, message, author, committed_at)``."""
    return orders.select(
        F.lit(repo_id).alias("repo_id"),
        F.md5(_s(F.col("o_orderkey"))).alias("hash"),
        F.concat(F.col("o_orderpriority"), F.lit(" order "), _s(F.col("o_orderkey")), _nl(), F.lit("status "),
                 F.col("o_orderstatus")).alias("message"),
        F.concat(F.lit("author"), _s(F.col("o_custkey"))).alias("author"),
        F.col("o_orderdate").alias("committed_at"))


def commit_files_from_lineitem(lineitem: DataFrame, files: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """FX-commits: ``commit_files(repo_id, hash, path)`` (a commit touches a part's file).

    ``ids(file_id)``, if given, holds the id of each of ``files``, for a join before the pairs are made distinct.
    """
    # orders are told apart by their numbers, a quarter as long as the hashes
    pairs = lineitem.select("l_orderkey", F.col("l_partkey").alias("file_id"))
    if ids is not None:
        pairs = pairs.join(ids, "file_id", "left_semi")
    return pairs.distinct().join(files.select("repo_id", "file_id", "path"), "file_id").select(
        "repo_id", F.md5(_s(F.col("l_orderkey"))).alias("hash"), "path")


def changes_from_events(events: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """FX-changes: ``changes(repo_id, path, change_type, ts, seq[, content])``.

    A non-deleted change to ``mod_{u}`` carries the FX-files content of file u.
    """
    ch = events.select(
        _s(F.col("event_id") % 3).alias("repo_id"),
        F.concat(F.lit("mod_"), _s(F.col("user_id"))).alias("path"),
        F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted")
        .otherwise("modified").alias("change_type"),
        F.col("ts"), F.col("event_id").alias("seq"), F.col("user_id"))
    if files is not None:
        ch = ch.join(files.select(F.col("file_id").alias("user_id"), "content", "lang"), "user_id", "left")
        ch = (ch.withColumn("content", F.when(F.col("change_type") != "deleted", F.col("content")))
              .withColumn("lang", F.when(F.col("change_type") != "deleted", F.col("lang"))))
    return ch.drop("user_id")


def chunks_from_embeddings(embeddings: DataFrame, files: DataFrame) -> DataFrame:
    """Chunk vectors: ``chunks(repo_id, chunk_id, path, start_line, end_line, text, embedding)``.

    The driver's vectors stand for function chunks; ``label`` names the file
    (``file_id``). The text is the file's ``fn_`` function with a part number,
    so chunks of one file can share their first 100 characters (D4).
    """
    f = files.select("repo_id", F.col("file_id").alias("label"), "path", "content")
    return (embeddings.join(f, "label")
            .select("repo_id", F.col("vec_id").alias("chunk_id"), "path",
                    F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
                    F.concat(F.lit("// part "), _s(F.col("vec_id") % 3), _nl(), F.col("content")).alias("text"),
                    F.col("embedding")))


def query_vectors(requests: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Request query vectors: request ``r`` uses vector ``(r * 37) % n``.

    Stands in for embedding the scope hint (``vectors.embed_column`` does that
    for real prompts).
    """
    n = embeddings.select(F.count(F.lit(1))).scalar()
    q = requests.select("request_id", ((F.col("request_id") * 37) % n).alias("vec_id"))
    return q.join(embeddings.select("vec_id", "embedding"), "vec_id").select("request_id", "embedding")


class Fixture:
    """All derived inputs for one scale-factor folder and the index of their files, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str, opts: PackOptions = PackOptions()):
        self.spark, self.sf_dir, self.opts = spark, sf_dir, opts
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]

    def _get(self, key, fn):
        if key not in self._cache:
            self._cache[key] = fn()
        return self._cache[key]

    @property
    def files(self) -> DataFrame:
        # materialised once: every index table and request joins back to it
        return self._get("files", lambda: cut_lineage(files_from_parts(self.table("part"))))

    @property
    def index(self):
        from packtables.plans.index import build_index

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self._get("index", lambda: build_index(self.files, self.opts, num_partitions=n))

    @property
    def requests(self) -> DataFrame:
        return self._get("requests", lambda: cut_lineage(requests_from_conversations(
            self.table("conversations"), self.table("part"))))

    @property
    def commits(self) -> DataFrame:
        return self._get("commits", lambda: commits_from_orders(self.table("orders")))

    @property
    def commit_files(self) -> DataFrame:
        return self._get("commit_files", lambda: commit_files_from_lineitem(self.table("lineitem"), self.files))

    def commit_files_of(self, paths: DataFrame) -> DataFrame:
        """The rows of ``commit_files`` for some paths; line items of other files are left out before they are dealt out."""
        files = cut_lineage(of_paths(self.files.select("repo_id", "file_id", "path"), paths))
        return commit_files_from_lineitem(self.table("lineitem"), files, sent(files.select("file_id").distinct()))

    @property
    def chunks(self) -> DataFrame:
        return self._get("chunks", lambda: cut_lineage(chunks_from_embeddings(self.table("embeddings"), self.files)))

    @property
    def query_vectors(self) -> DataFrame:
        return self._get("qvec", lambda: cut_lineage(query_vectors(self.requests, self.table("embeddings"))))

    @property
    def changes(self) -> DataFrame:
        return self._get("changes", lambda: changes_from_events(self.table("events"), self.files))


# ---------------------------------------------------------------------------
# The same derivations as DuckDB SQL (oracle side). Names end in _sql.

FILES_SQL = """
with t as (select p_partkey as i, (select count(*) from part) as n from part),
u as (
  select i, (i*7+1) % n as a, (i*13+5) % n as b,
         case i % 5 when 0 then '.py' when 1 then '.ts' when 2 then '.js' when 3 then '.go' else '.tsx' end as ext
  from t)
select 'fx' as repo_id, i as file_id, concat('pkg', i % 20, '/mod_', i, ext) as path, ext, a, b,
  case when ext = '.py' then concat(
    'from pkg', a % 20, '.mod_', a, ' import fn_', a, chr(10),
    'import pkg', b % 20, '.mod_', b, chr(10), chr(10),
    'class Cls', i, ':', chr(10),
    '    def run(self):', chr(10),
    '        return fn_', a, '(self)', chr(10), chr(10),
    'def fn_', i, '(x):', chr(10),
    '    return fn_', b, '(x)', chr(10))
  when ext = '.go' then concat(
    'package pkg', i % 20, chr(10), chr(10),
    'import (', chr(10),
    '  "pkg', a % 20, '/mod_', a, '"', chr(10),
    '  "pkg', b % 20, '/mod_', b, '"', chr(10), ')', chr(10), chr(10),
    'type Cls', i, ' struct{}', chr(10), chr(10),
    'func (c *Cls', i, ') Run() int { return fn_', a, '(c) }', chr(10), chr(10),
    'func fn_', i, '(x int) int { return fn_', b, '(x) }', chr(10))
  else concat(
    'import { fn_', a, ' } from "../pkg', a % 20, '/mod_', a, '";', chr(10),
    'import * as m from "../pkg', b % 20, '/mod_', b, '";', chr(10), chr(10),
    'class Cls', i, ' {', chr(10),
    '  run() { return fn_', a, '(this); }', chr(10), '}', chr(10), chr(10),
    'function fn_', i, '(x) {', chr(10),
    '  return m.fn_', b, '(x);', chr(10), '}', chr(10))
  end as content
from u
"""

PATHS_SQL = """
select concat(case p_partkey % 5 when 0 then 'src' when 1 then 'dist' when 2 then 'node_modules/x'
                                 when 3 then 'lib/.next' else 'pkg/build' end,
              '/f', p_partkey,
              case p_partkey % 4 when 0 then '.py' when 1 then '.min.js' when 2 then '.ts' else '.log' end) as path
from part
"""

REQUESTS_SQL = """
with c as (
  select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn) as body
  from conversations where role = 'user' group by conv_id),
k as (select conv_id, body, conv_id % (select count(*) from part) as k from c)
select conv_id as request_id, 'fx' as repo_id,
       concat(case conv_id % 6 when 0 then 'refactor' when 1 then 'fix' when 2 then 'add'
                               when 3 then 'explain' when 4 then 'test' else 'ponder' end,
              ' Cls', k, ' and Cls', k, '.ru plus fnOne in pkg', k % 20, '/mod_', k,
              case k % 5 when 0 then '.py' when 1 then '.ts' when 2 then '.js' when 3 then '.go' else '.tsx' end,
              chr(10), body) as prompt
from k
"""

COMMITS_SQL = """
select 'fx' as repo_id, md5(cast(o_orderkey as varchar)) as hash,
       concat(o_orderpriority, ' order ', o_orderkey, chr(10), 'status ', o_orderstatus) as message,
       concat('author', o_custkey) as author, o_orderdate as committed_at
from orders
"""

COMMIT_FILES_SQL = """
select distinct 'fx' as repo_id, md5(cast(l_orderkey as varchar)) as hash,
       concat('pkg', l_partkey % 20, '/mod_', l_partkey,
              case l_partkey % 5 when 0 then '.py' when 1 then '.ts' when 2 then '.js' when 3 then '.go' else '.tsx' end) as path
from lineitem where l_partkey in (select p_partkey from part)
"""

CHANGES_SQL = """
select cast(event_id % 3 as varchar) as repo_id, concat('mod_', user_id) as path,
       case event_type when 'signup' then 'added' when 'error' then 'deleted' else 'modified' end as change_type,
       ts, event_id as seq, user_id
from events
"""

CHUNKS_SQL = """
select f.repo_id, e.vec_id as chunk_id, f.path, concat('// part ', e.vec_id % 3, chr(10), f.content) as text,
       e.embedding
from embeddings e join fx_files f on e.label = f.file_id
"""

QVEC_SQL = """
select r.request_id, e.embedding
from fx_requests r join embeddings e on e.vec_id = (r.request_id * 37) % (select count(*) from embeddings)
"""

DUCKDB_VIEWS = (
    ("fx_files", FILES_SQL), ("fx_paths", PATHS_SQL), ("fx_requests", REQUESTS_SQL),
    ("fx_commits", COMMITS_SQL), ("fx_commit_files", COMMIT_FILES_SQL), ("fx_changes", CHANGES_SQL),
    ("fx_chunks", CHUNKS_SQL), ("fx_qvec", QVEC_SQL),
)


def with_views(sql: str, names: tuple[str, ...]) -> str:
    """Prefix ``sql`` with the named fixture views as CTEs (dependencies first)."""
    deps = {"fx_chunks": ("fx_files",), "fx_qvec": ("fx_requests",)}
    order: list[str] = []

    def add(n):
        for d in deps.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    views = dict(DUCKDB_VIEWS)
    ctes = ",\n".join(f"{n} as ({views[n]})" for n in order)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
