"""DuckDB SQL for every registered query with an exact oracle.

Patterns and literals are the fixed values of the library, written out for
RE2. Differences between the engines are bridged here, not in the library:
RE2's ``\\b`` is ASCII-only, so non-ASCII letters are masked to ``_`` before
the word-boundary patterns run (Java's ``\\b`` with ``(?U)`` and Python's
treat them as word characters).
"""

from __future__ import annotations

from packtables.sources.fixtures import COMMIT_FILES_SQL, COMMITS_SQL, with_views

# Fixed values, written out here again so that a wrong one in the library shows.
TASK_KEYWORDS = (
    ("refactor", ("refactor", "rename", "extract", "move", "reorganize")),
    ("debug", ("bug", "error", "fix", "broken", "failing", "crash", "exception", "traceback")),
    ("add_feature", ("add", "implement", "create", "build", "new feature")),
    ("explain", ("explain", "how does", "what does", "walk me through")),
    ("test", ("test", "spec", "coverage", "unit test")),
)
SYMBOL_PATTERN = r"\b([A-Z][a-zA-Z0-9]*(?:\.[a-zA-Z][a-zA-Z0-9]*)*)\b"
CAMEL_PATTERN = r"\b([a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*)\b"
FILE_PATTERN = (r"(?:^|\s)([a-zA-Z0-9_./-]+(?:/[a-zA-Z0-9_./-]+)+)"
                r"|(?:^|\s)([a-zA-Z0-9_.-]+\.(?:ts|tsx|js|jsx|py|go|rs|java|rb|css|scss|html|json|yaml|yml|toml|md))\b")
TOKEN_PATTERN = r"[A-Za-z]{1,4}|[0-9]{1,3}|[^A-Za-z0-9 \t\n\r]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens_sql(expr: str) -> str:
    return f"coalesce(len(regexp_extract_all({expr}, {q(TOKEN_PATTERN)})), 0)"


def task_type_sql(low: str) -> str:
    parts = []
    for name, words in TASK_KEYWORDS:
        cond = " or ".join(f"contains({low}, {q(w)})" for w in words)
        parts.append(f"when {cond} then {q(name)}")
    return "case " + " ".join(parts) + " else 'other' end"


MASK = r"regexp_replace({x}, '[^\x00-\x7F\P{{L}}]', '_', 'g')"


def symbols_sql(text: str) -> str:
    m = MASK.format(x=text)
    return (f"list_sort(list_distinct(list_concat("
            f"list_filter(regexp_extract_all({m}, {q(SYMBOL_PATTERN)}, 1), lambda x: length(x) > 1 and x <> upper(x)), "
            f"regexp_extract_all({m}, {q(CAMEL_PATTERN)}, 1))))")


def files_sql(text: str) -> str:
    m = MASK.format(x=text)
    return (f"list_sort(list_distinct(list_filter(list_concat("
            f"regexp_extract_all({m}, {q(FILE_PATTERN)}, 1), regexp_extract_all({m}, {q(FILE_PATTERN)}, 2)), "
            f"lambda x: x <> '')))")


def signals_sql(source: str) -> str:
    """Signals over ``source(request_id, raw_prompt)``."""
    return f"""
s as (
  select request_id, raw_prompt,
         case when raw_prompt = '' then 'other' else {task_type_sql('lower(raw_prompt)')} end as task_type,
         {symbols_sql('raw_prompt')} as symbols,
         {files_sql('raw_prompt')} as files
  from {source}),
sig as (
  select *, md5(concat_ws('|', raw_prompt, task_type, array_to_string(symbols, ','), array_to_string(files, ',')))
            as fingerprint
  from s)"""


SIGNALS = f"""
with p as (
  select conv_id as request_id,
         coalesce(string_agg(case when role = 'user' then coalesce(text, '') end, chr(10) order by turn), '')
           as raw_prompt
  from conversations group by conv_id),
{signals_sql('p')}
select request_id, task_type, array_to_string(symbols, ' ') as symbols, array_to_string(files, ' ') as file_mentions,
       length(raw_prompt)::INTEGER as prompt_chars, 1 as scope_is_prompt, fingerprint
from sig
"""

VECTOR_KNN = """
with d as (
  select a.vec_id as query_id, b.vec_id as chunk_id,
         list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) as distance
  from embeddings a join embeddings b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from d)
select query_id, chunk_id, rank::INTEGER as rank, round(1.0 / (1.0 + distance), 6) as score
from r where rank <= 8 and 1.0 / (1.0 + distance) >= 0.40
"""

_CDATA = "'<![CDATA[' || replace(coalesce({x}, ''), ']]>', ']]]]><![CDATA[>') || ']]>'"


def cdata_sql(x: str) -> str:
    return _CDATA.format(x=x)


def escape_sql(x: str) -> str:
    return (f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;')")


BUDGET_DOCUMENTS = f"""
with e as (
  select source, doc_id, length(coalesce(text, '')) as chars,
         {tokens_sql("'    <file path=\"' || " + escape_sql("source || '/doc_' || doc_id") + " || '\">' || "
                     + cdata_sql('text') + " || '</file>'")} as tokens,
         {tokens_sql("'<context_pack task_id=\"' || substr(md5(source), 1, 8) || '\" tokens=\"\">'")}
           + {tokens_sql("'</context_pack>'")} as base
  from documents),
s as (
  select *, tokens + case when row_number() over (partition by source order by chars asc, doc_id desc) = 1
                          then {tokens_sql("'  <files>'")} + {tokens_sql("'  </files>'")} else 0 end as delta
  from e),
r as (
  select *, base + sum(delta) over (partition by source order by chars desc, doc_id asc
                                    rows between current row and unbounded following) as remaining
  from s),
f as (
  select *, min(remaining) over (partition by source order by chars desc, doc_id asc
                                 rows between unbounded preceding and current row) > 6000 as applied
  from r)
select source, doc_id, tokens::INTEGER as tokens, remaining::BIGINT as remaining, applied::int as dropped,
       (base + sum(case when applied then 0 else delta end) over (partition by source))::BIGINT as final_tokens
from f
"""

TEXT_HELPERS = f"""
with d as (select *, string_split(text, chr(10)) as ls, source || '/doc_' || doc_id as seed from documents)
select doc_id,
  ({tokens_sql('text')})::INTEGER as tokens,
  md5(case when text is null or text = '' then text
           when len(ls) > 60 then array_to_string(ls[1:60], chr(10)) || chr(10) || '  // ... truncated'
           else text end) as truncated_md5,
  md5('// [blast radius - imports ' || seed || ']' || chr(10) || array_to_string(ls[1:3], chr(10)) || chr(10)
      || '// ...') as summary_md5,
  md5(substring(text, 1, 2000)) as chunk_md5,
  md5({escape_sql('text')}) as escaped_md5,
  md5({cdata_sql('text')}) as cdata_md5
from d
"""

ORACLE = {
    "signals": SIGNALS,
    "vector_knn": VECTOR_KNN,
    "budget_documents": BUDGET_DOCUMENTS,
    "text_helpers": TEXT_HELPERS,
}

__all__ = ["ORACLE", "with_views", "q", "tokens_sql", "signals_sql", "cdata_sql", "escape_sql"]


# ---------------------------------------------------------------------------
# Index tables, stated from the FX-files key arithmetic (no parsing).

SYMBOLS_BY_CONSTRUCTION = """
select file_id, path, 'Cls' || file_id as name, 'class' as kind,
       case when ext = '.go' then 8 else 4 end as start_line, case when ext = '.go' then 8 else 6 end as end_line,
       '' as signature, '' as body
from fx_files
union all
select file_id, path, 'Cls' || file_id || case when ext = '.go' then '.Run' else '.run' end, 'method',
       case when ext = '.go' then 10 else 5 end, case ext when '.go' then 10 when '.py' then 6 else 5 end,
       case ext when '.py' then 'def run(self):'
                when '.go' then 'func (c *Cls' || file_id || ') Run() int { return fn_' || a || '(c) }'
                else 'run() { return fn_' || a || '(this); }' end,
       case ext when '.py' then 'def run(self):' || chr(10) || '        return fn_' || a || '(self)'
                when '.go' then 'func (c *Cls' || file_id || ') Run() int { return fn_' || a || '(c) }'
                else 'run() { return fn_' || a || '(this); }' end
from fx_files
union all
select file_id, path, 'fn_' || file_id, 'function',
       case when ext = '.go' then 12 else 8 end, case ext when '.py' then 9 when '.go' then 12 else 10 end,
       case ext when '.py' then 'def fn_' || file_id || '(x):'
                when '.go' then 'func fn_' || file_id || '(x int) int { return fn_' || b || '(x) }'
                else 'function fn_' || file_id || '(x) {' end,
       case ext when '.py' then 'def fn_' || file_id || '(x):' || chr(10) || '    return fn_' || b || '(x)'
                when '.go' then 'func fn_' || file_id || '(x int) int { return fn_' || b || '(x) }'
                else 'function fn_' || file_id || '(x) {' || chr(10) || '  return m.fn_' || b || '(x);'
                     || chr(10) || '}' end
from fx_files
"""

CODE_SYMBOLS = with_views(f"""
with s as ({SYMBOLS_BY_CONSTRUCTION})
select path, name, kind, start_line, end_line, signature, md5(body) as body_md5 from s
""", ("fx_files",))

CODE_IMPORTS = with_views("""
select path, case ext when '.py' then 'pkg' || a % 20 || '.mod_' || a when '.go' then 'pkg' || a % 20 || '/mod_' || a
                      else '../pkg' || a % 20 || '/mod_' || a end as source,
       case when ext = '.go' then '' else 'fn_' || a end as names,
       case when ext = '.go' then 4 else 1 end as line
from fx_files
union all
select path, case ext when '.py' then 'pkg' || b % 20 || '.mod_' || b when '.go' then 'pkg' || b % 20 || '/mod_' || b
                      else '../pkg' || b % 20 || '/mod_' || b end,
       '', case when ext = '.go' then 5 else 2 end
from fx_files
""", ("fx_files",))

CODE_CALLS = with_views("""
select path, 'fn_' || a as symbol_name, case ext when '.py' then 6 when '.go' then 10 else 5 end as line from fx_files
union all
select path, case when ext in ('.py', '.go') then 'fn_' || b else 'm.fn_' || b end,
       case ext when '.py' then 9 when '.go' then 12 else 9 end
from fx_files
""", ("fx_files",))

PATH_KEYS = with_views(r"""
with k as (
  select path, regexp_replace(path, '\.[^./]+$', '') as no_ext from fx_files)
select key, max(path) as path
from (select path, unnest([no_ext, path, regexp_extract(no_ext, '([^/]*)$', 1), replace(no_ext, '/', '.')]) as key
      from k)
group by key
""", ("fx_files",))

EDGES_BY_CONSTRUCTION = """
select distinct f.path as src, g.path as dst
from fx_files f join fx_files g on g.file_id = f.a or g.file_id = f.b
where g.file_id <> f.file_id
"""

DEP_EDGES = with_views(f"select src, dst from ({EDGES_BY_CONSTRUCTION})", ("fx_files",))

DEPENDENTS = with_views(f"""
with e as ({EDGES_BY_CONSTRUCTION}),
h1 as (select dst as seed, src as dependent from e),
h2 as (select h1.seed, e.src as dependent from h1 join e on e.dst = h1.dependent),
u as (select seed, dependent, 1 as hops from h1 where dependent <> seed
      union all select seed, dependent, 2 from h2 where dependent <> seed)
select seed, dependent, min(hops) as hops from u group by seed, dependent
""", ("fx_files",))

DEPENDENCIES = with_views(f"select src as path, dst as dependency from ({EDGES_BY_CONSTRUCTION})", ("fx_files",))

INDEX_STATS = with_views(f"""
select 'fx' as repo_id, count(*) as file_count, 3 * count(*) as symbol_count, 2 * count(*) as chunk_count,
       '2001-09-01 00:00:00' as last_indexed,
       count(*) as n_nodes, (select count(*) from ({EDGES_BY_CONSTRUCTION})) as n_edges
from fx_files
""", ("fx_files",))

CHUNKS_PER_FILE = with_views("""
select path, 2::BIGINT as n_chunks, 2 * (select count(*) from fx_files) as total_chunks,
       (select count(*) from fx_files) as total_files
from fx_files
""", ("fx_files",))

DEFINITIONS_BY_NAME = with_views(f"""
with s as ({SYMBOLS_BY_CONSTRUCTION})
select name, count(*) as n_definitions, min(path) as first_path, min(start_line) as first_line from s group by name
""", ("fx_files",))

_EXCLUDE_RX = r"node_modules|\.git|dist|__pycache__|.*\.min\.js|\.next|build"
PATH_FILTERS = with_views(rf"""
with p as (
  select path, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.*[^.](\.[^.]*)$', 1) as suffix from fx_paths)
select path,
  (len(list_filter(string_split(path, '/'), lambda c: regexp_full_match(c, '{_EXCLUDE_RX}'))) > 0
   or regexp_full_match(path, '{_EXCLUDE_RX}'))::int as excluded,
  (suffix not in ('.log', '.tmp', '.cache') and suffix in ('.ts', '.tsx', '.js', '.jsx', '.py', '.go')
   and not list_has_any(string_split(path, '/'),
       ['.next', 'node_modules', '.git', 'dist', 'build', '__pycache__', '.vscode', 'coverage']))::int as watched
from p
""", ("fx_paths",))

ORACLE.update({
    "code_symbols": CODE_SYMBOLS,
    "code_imports": CODE_IMPORTS,
    "code_calls": CODE_CALLS,
    "path_keys": PATH_KEYS,
    "dep_edges": DEP_EDGES,
    "dependents": DEPENDENTS,
    "dependencies": DEPENDENCIES,
    "index_stats": INDEX_STATS,
    "chunks_per_file": CHUNKS_PER_FILE,
    "definitions_by_name": DEFINITIONS_BY_NAME,
    "path_filters": PATH_FILTERS,
})


# ---------------------------------------------------------------------------
# Retrieval over FX-requests.

CALLS_BY_CONSTRUCTION = """
select path, 'fn_' || a as symbol_name, case ext when '.py' then 6 when '.go' then 10 else 5 end as line from fx_files
union all
select path, case when ext in ('.py', '.go') then 'fn_' || b else 'm.fn_' || b end,
       case ext when '.py' then 9 when '.go' then 12 else 9 end
from fx_files
"""

EDGE_LINES = """
select f.path as src, g.path as dst,
       min(case when g.file_id = f.a then (case when f.ext = '.go' then 4 else 1 end)
                else (case when f.ext = '.go' then 5 else 2 end) end) as line
from fx_files f join fx_files g on g.file_id = f.a or g.file_id = f.b
where g.file_id <> f.file_id group by 1, 2
"""

CALL_SITES = with_views(f"""
with sym as ({SYMBOLS_BY_CONSTRUCTION}),
c as ({CALLS_BY_CONSTRUCTION}),
n as (select distinct name from sym),
r as (select n.name, c.path, c.line, row_number() over (partition by n.name order by c.path, c.line) as rn
      from n join c on c.symbol_name = n.name)
select n.name, coalesce(string_agg(r.path || ':' || r.line, ',' order by r.rn), '') as sites
from n left join r on r.name = n.name and r.rn <= 5
group by n.name
""", ("fx_files",))

# Signals of the FX requests, then the staged strategies. Each CTE mirrors one strategy.
RETRIEVAL_CTES = f"""
p as (select request_id, prompt as raw_prompt from fx_requests),
{signals_sql('p')},
sym as ({SYMBOLS_BY_CONSTRUCTION}),
calls as ({CALLS_BY_CONSTRUCTION}),
edges as ({EDGE_LINES}),
m as (
  select request_id, symbols[i] as mention, i - 1 as m_pos
  from (select request_id, symbols, unnest(generate_series(1, len(symbols))) as i from sig where len(symbols) > 0)),
names as (select name, min(path) as path, min(start_line) as start_line from sym group by name),
exact as (select m.* , m.mention as name from m where m.mention in (select name from names)),
miss as (select * from m where m.mention not in (select name from names)),
partial_hits as (
  select miss.*, n.name,
         row_number() over (partition by miss.request_id, miss.mention order by n.path, n.start_line) as rn
  from miss join names n on contains(n.name, miss.mention)),
hits as (select request_id, mention, m_pos, name from exact
         union all select request_id, mention, m_pos, name from partial_hits where rn = 1),
found as (
  select h.request_id, h.m_pos, s.*,
         row_number() over (partition by h.request_id, s.name, s.path order by h.m_pos, s.start_line) as rn2
  from hits h join sym s on s.name = h.name),
site_rank as (
  select c.symbol_name, c.path, c.line, row_number() over (partition by c.symbol_name order by c.path, c.line) as rn
  from calls c where c.symbol_name in (select name from found)),
sites as (select symbol_name, string_agg(path || ':' || line, ',' order by rn) as sites
          from site_rank where rn <= 5 group by symbol_name),
r1 as (
  select f.request_id, f.m_pos, f.name, f.path, f.start_line as line, f.signature, f.body,
         coalesce(s.sites, '') as sites
  from found f left join sites s on s.symbol_name = f.name where rn2 = 1),
fm as (
  select request_id, files[i] as mention, i - 1 as m_pos
  from (select request_id, files, unnest(generate_series(1, len(files))) as i from sig where len(files) > 0)),
res as (
  select fm.*, (select min(path) from fx_files f where contains(f.path, fm.mention)) as resolved from fm),
cand as (
  select request_id, m_pos, resolved as path, -1 as k3 from res where resolved is not null
  union all
  select res.request_id, res.m_pos, e.dst, e.line from res join edges e on e.src = res.resolved),
r2 as (
  select * from (
    select c.*, f.content, row_number() over (partition by c.request_id, c.path order by c.m_pos, c.k3) as rn
    from cand c join fx_files f on f.path = c.path where f.content <> '')
  where rn = 1),
d as (
  select r.request_id, c.chunk_id, c.path, c.text,
         list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) as distance
  from fx_requests r join fx_qvec q using (request_id) join fx_chunks c on c.repo_id = r.repo_id),
ranked as (select *, row_number() over (partition by request_id order by distance, chunk_id) as rank from d),
knn as (select *, 1.0 / (1.0 + distance) as score from ranked where rank <= 8 and 1.0 / (1.0 + distance) >= 0.40),
r3 as (
  select * from (
    select *, row_number() over (partition by request_id, path, substring(text, 1, 100) order by rank) as rn
    from knn) where rn = 1),
r5 as (
  select knn.* from knn join sig using (request_id) where sig.task_type = 'add_feature' and knn.rank <= 3),
seeds as (
  select distinct request_id, path from (select request_id, path from r1 union all select request_id, path from r2)
  where request_id in (select request_id from sig where task_type = 'refactor')),
h1 as (select s.request_id, s.path as seed, e.src as dependent from seeds s join edges e on e.dst = s.path),
h2 as (select h1.request_id, h1.seed, e.src as dependent from h1 join edges e on e.dst = h1.dependent),
dep as (
  select distinct request_id, seed, dependent from (select * from h1 union all select * from h2)
  where dependent <> seed),
r4 as (
  select * from (
    select dep.request_id, dep.seed, dep.dependent as path, f.content,
           row_number() over (partition by dep.request_id, dep.dependent order by dep.seed) as rn
    from dep join fx_files f on f.path = dep.dependent
    where f.content <> ''
      and not exists (select 1 from r2 where r2.request_id = dep.request_id and r2.path = dep.dependent))
  where rn = 1),
cf as ({COMMIT_FILES_SQL}),
cm as ({COMMITS_SQL}),
recent as (
  select cf.path, cm.hash, cm.message, cm.author, cm.committed_at,
         row_number() over (partition by cf.path order by cm.committed_at desc, cm.hash) as rank
  from cf join cm on cm.hash = cf.hash),
summary as (
  select path, rank, committed_at, substring(hash, 1, 7) as hash,
         substring(split_part(regexp_replace(message, '^\\s+|\\s+$', '', 'g'), chr(10), 1), 1, 80) as message,
         author,
         greatest(floor(epoch(timestamp '2001-09-01 00:00:00') - epoch(committed_at)), 0)::bigint as secs
  from recent where rank <= 5),
summary2 as (
  select *, case when secs // 86400 > 0 then (secs // 86400) || ' days ago'
                 when secs % 86400 > 3600 then ((secs % 86400) // 3600) || ' hours ago'
                 else ((secs % 86400) // 60) || ' minutes ago' end as date
  from summary),
gpaths as (
  select distinct request_id, path from (
    select request_id, path from r1 union all select request_id, path from r2
    union all select request_id, path from r4)
  where request_id in (select request_id from sig where task_type in ('debug', 'refactor'))),
r6 as (
  select g.request_id, g.path,
         string_agg(s.hash || '|' || s.message || '|' || s.author || '|' || s.date, ';' order by s.rank) as commits
  from gpaths g join summary2 s on s.path = g.path and s.rank <= 3
  group by g.request_id, g.path)
"""

_RETRIEVAL_VIEWS = ("fx_files", "fx_requests", "fx_chunks", "fx_qvec")


def retrieval(select: str) -> str:
    return with_views(f"with {RETRIEVAL_CTES}\n{select}", _RETRIEVAL_VIEWS)


ROUTING = retrieval("""
select request_id, strategy, stage from (
  select request_id, 'symbol' as strategy, 0 as stage from sig where len(symbols) > 0
  union all select request_id, 'file_expand', 0 from sig where len(files) > 0
  union all select request_id, 'semantic', 0 from sig
  union all select request_id, 'blast_radius', 1 from sig where task_type = 'refactor'
  union all select request_id, 'convention', 0 from sig where task_type = 'add_feature'
  union all select request_id, 'git_ctx', 2 from sig where task_type in ('debug', 'refactor'))
""")

SYMBOL_STRATEGY = retrieval("""
select request_id, name, path, line, signature, md5(body) as body_md5, sites, m_pos as mention_rank from r1
""")

FIND_FILE = retrieval("select distinct mention, resolved from res where resolved is not null")

FILE_EXPAND = retrieval("""
select request_id, path, md5(content) as content_md5, m_pos as mention_rank, k3::BIGINT as import_line from r2
""")

SEMANTIC = retrieval("select request_id, path, rank, round(score, 6) as score, md5(text) as text_md5 from r3")

CONVENTION = retrieval("select request_id, path, rank, md5(text) as text_md5 from r5")

BLAST_RADIUS = retrieval("""
select request_id, path, seed,
       md5('// [blast radius - imports ' || seed || ']' || chr(10)
           || array_to_string(string_split(content, chr(10))[1:3], chr(10)) || chr(10) || '// ...') as content_md5
from r4
""")

RECENT_COMMITS = retrieval("select path, rank::INTEGER as rank, hash, message, author, date from summary2")

GIT_CONTEXT = retrieval("select request_id, path, commits from r6")

ORACLE.update({
    "call_sites": CALL_SITES,
    "routing": ROUTING,
    "symbol_strategy": SYMBOL_STRATEGY,
    "find_file": FIND_FILE,
    "file_expand": FILE_EXPAND,
    "semantic": SEMANTIC,
    "convention": CONVENTION,
    "blast_radius": BLAST_RADIUS,
    "recent_commits": RECENT_COMMITS,
    "git_context": GIT_CONTEXT,
})


# ---------------------------------------------------------------------------
# Budgeted packs (B1-B5, B7, A3) and enrichment.


def _attr(name: str, x: str) -> str:
    return f"' {name}=\"' || {escape_sql(x)} || '\"'"


PACK_CTES = f"""
site_x as (
  select symbol_name,
         string_agg(chr(10) || '        <site' || {_attr('file', 'path')} || {_attr('line', 'line::varchar')} || '/>',
                    '' order by rn) as sx
  from site_rank where rn <= 5 group by symbol_name),
e_sym as (
  select r1.request_id, r1.m_pos, r1.path, r1.line, r1.body,
         '    <symbol' || {_attr('name', 'r1.name')} || {_attr('file', 'r1.path')} || {_attr('line', 'r1.line::varchar')}
           || '>' || case when r1.signature <> '' then chr(10) || '      <signature>' || {escape_sql('r1.signature')}
                          || '</signature>' else '' end as head,
         case when sx.sx is null then '' else chr(10) || '      <call_sites>' || sx.sx || chr(10)
              || '      </call_sites>' end as sites_block,
         string_split(r1.body, chr(10)) as ls
  from r1 left join site_x sx on sx.symbol_name = r1.name),
e_sym2 as (
  select *, len(ls) as nl,
         case when body is null or body = '' then 0
              else (select count(*) from generate_series(1, 31) g(t) where (len(ls) >> (t - 1)) > 5) end as nt
  from e_sym),
versions as (
  select e.request_id, e.m_pos, e.path, e.line, t,
         case when t = 0 then e.body
              else array_to_string(e.ls[1:(e.nl >> t)], chr(10)) || chr(10) || '  // ... trimmed' end as v
  from e_sym2 e, (select unnest(generate_series(0, 31)) as t) tt where tt.t <= e.nt),
vtok as (
  select *, case when coalesce(v, '') = '' then 0
                 else {tokens_sql("chr(10) || '      <body>' || " + cdata_sql('v') + " || '</body>'")} end as vt
  from versions),
e_oth as (
  select request_id, 'files' as section, 3 as phase, 0 as p0, m_pos as p1, '' as p2, k3 as p3, 0 as p4, '' as p5,
         length(content) as chars, null::double as score,
         '    <file' || {_attr('path', 'path')} || '>' || {cdata_sql('content')} || '</file>' as xml
  from r2
  union all
  select request_id, 'files', 3, 1, 0, seed, 0, 0, path,
         length(hs), null,
         '    <file' || {_attr('path', 'path')} || '>' || {cdata_sql('hs')} || '</file>'
  from (select *, '// [blast radius - imports ' || seed || ']' || chr(10)
                  || array_to_string(string_split(content, chr(10))[1:3], chr(10)) || chr(10) || '// ...' as hs from r4)
  union all
  select request_id, 'semantic_matches', 2, 0, rank, '', 0, 0, '', length(text), score,
         '    <match' || {_attr('file', 'path')} || ' score="' || printf('%.2f', score) || '">' || {cdata_sql('text')}
         || '</match>'
  from r3
  union all
  select request_id, 'conventions', 1, 0, rank, '', 0, 0, '', length(text), null,
         '    <example' || {_attr('file', 'path')} || '>' || {cdata_sql('text')} || '</example>'
  from r5
  union all
  select g.request_id, 'git_context', 0, 0, 0, g.path, 0, 0, '', 0, null,
         '    <file' || {_attr('path', 'g.path')} || '>'
         || string_agg(chr(10) || '      <commit' || {_attr('hash', 's.hash')} || {_attr('message', 's.message')}
                       || {_attr('author', 's.author')} || {_attr('date', 's.date')} || '/>', '' order by s.rank)
         || chr(10) || '    </file>'
  from gpaths g join summary2 s on s.path = g.path and s.rank <= 3
  group by g.request_id, g.path),
steps as (
  select request_id, section, phase, 0 as step, p0, p1, p2, p3, p4, p5, chars, score,
         {tokens_sql('xml')} as delta0, xml from e_oth
  union all
  select request_id, 'symbols', 4, 0, 0, m_pos, path, line, 0, '', 0, null, {tokens_sql('sites_block')}, null
  from e_sym2
  union all
  select a.request_id, 'symbols', 5, a.t, 0, a.m_pos, a.path, a.line, 0, '', 0, null, b.vt - a.vt, null
  from vtok a join vtok b on a.request_id = b.request_id and a.m_pos = b.m_pos and a.path = b.path
                         and a.line = b.line and b.t = a.t - 1
  union all
  select e.request_id, 'symbols', 6, 0, 0, e.m_pos, e.path, e.line, 0, '', 0, null,
         {tokens_sql('e.head')} + {tokens_sql(chr(39) + chr(10) + "    </symbol>" + chr(39))} + v.vt, null
  from e_sym2 e join vtok v on v.request_id = e.request_id and v.m_pos = e.m_pos and v.path = e.path
                            and v.line = e.line and v.t = e.nt),
ordered as (
  select *,
    {tokens_sql(chr(39) + '<context_pack task_id="' + chr(39) + " || substr(md5(request_id::varchar), 1, 8) || "
                + chr(39) + '" tokens="">' + chr(39))} + {tokens_sql(chr(39) + '</context_pack>' + chr(39))} as base,
    case section when 'symbols' then {tokens_sql(chr(39) + '  <symbols>' + chr(39))} + {tokens_sql(chr(39) + '  </symbols>' + chr(39))}
                 when 'files' then {tokens_sql(chr(39) + '  <files>' + chr(39))} + {tokens_sql(chr(39) + '  </files>' + chr(39))}
                 when 'semantic_matches' then {tokens_sql(chr(39) + '  <semantic_matches>' + chr(39))} + {tokens_sql(chr(39) + '  </semantic_matches>' + chr(39))}
                 when 'conventions' then {tokens_sql(chr(39) + '  <conventions>' + chr(39))} + {tokens_sql(chr(39) + '  </conventions>' + chr(39))}
                 else {tokens_sql(chr(39) + '  <git_context>' + chr(39))} + {tokens_sql(chr(39) + '  </git_context>' + chr(39))} end as wrap
  from steps),
w1 as (
  select *, delta0 + case when phase not in (4, 5)
                               and coalesce(lead(section) over o, '') <> section then wrap else 0 end as delta
  from ordered
  window o as (partition by request_id order by phase,
               case when phase = 2 then score end asc nulls last,
               case when phase = 3 then chars end desc nulls last,
               case when phase in (0, 1, 2, 6) then p0 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p1 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p2 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p3 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p4 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p5 end desc nulls last,
               case when phase in (3, 4, 5) then p0 end asc nulls last,
               case when phase in (3, 4, 5) then p1 end asc nulls last,
               case when phase in (3, 4, 5) then p2 end asc nulls last,
               case when phase in (3, 4, 5) then p3 end asc nulls last,
               case when phase in (3, 4, 5) then p4 end asc nulls last,
               case when phase in (3, 4, 5) then p5 end asc nulls last,
               step)),
w2 as (
  select *, base + sum(delta) over (o rows between current row and unbounded following) as remaining
  from w1
  window o as (partition by request_id order by phase,
               case when phase = 2 then score end asc nulls last,
               case when phase = 3 then chars end desc nulls last,
               case when phase in (0, 1, 2, 6) then p0 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p1 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p2 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p3 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p4 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p5 end desc nulls last,
               case when phase in (3, 4, 5) then p0 end asc nulls last,
               case when phase in (3, 4, 5) then p1 end asc nulls last,
               case when phase in (3, 4, 5) then p2 end asc nulls last,
               case when phase in (3, 4, 5) then p3 end asc nulls last,
               case when phase in (3, 4, 5) then p4 end asc nulls last,
               case when phase in (3, 4, 5) then p5 end asc nulls last,
               step)),
w3 as (
  select *, min(remaining) over (o rows between unbounded preceding and current row) > 6000 as applied
  from w2
  window o as (partition by request_id order by phase,
               case when phase = 2 then score end asc nulls last,
               case when phase = 3 then chars end desc nulls last,
               case when phase in (0, 1, 2, 6) then p0 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p1 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p2 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p3 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p4 end desc nulls last,
               case when phase in (0, 1, 2, 6) then p5 end desc nulls last,
               case when phase in (3, 4, 5) then p0 end asc nulls last,
               case when phase in (3, 4, 5) then p1 end asc nulls last,
               case when phase in (3, 4, 5) then p2 end asc nulls last,
               case when phase in (3, 4, 5) then p3 end asc nulls last,
               case when phase in (3, 4, 5) then p4 end asc nulls last,
               case when phase in (3, 4, 5) then p5 end asc nulls last,
               step)),
w4 as (
  select *, base + sum(case when applied then 0 else delta end) over (partition by request_id) as final_tokens,
         max(case when phase not in (4, 5) then applied::int end)
           over (partition by request_id, section, p0, p1, p2, p3, p4, p5) as dropped,
         max(case when phase = 4 then applied::int end)
           over (partition by request_id, section, p0, p1, p2, p3, p4, p5) as cleared,
         coalesce(max(case when phase = 5 and applied then step end)
           over (partition by request_id, section, p0, p1, p2, p3, p4, p5), 0) as halved
  from w3),
w5 as (
  select *, max(case when phase = 2 and applied then 1 else 0 end) over (partition by request_id) as sem_sorted,
            max(case when phase = 3 and applied then 1 else 0 end) over (partition by request_id) as files_sorted
  from w4),
kept as (
  select w.request_id, w.section, w.p0, w.p1, w.p2, w.p3, w.p4, w.p5, w.final_tokens,
         case when w.section = 'semantic_matches' and w.sem_sorted = 1 then -w.score
              when w.section = 'files' and w.files_sorted = 1 then -w.chars else 0 end as okey,
         case when w.section = 'symbols' then
           e.head || case when coalesce(v.v, '') <> '' then chr(10) || '      <body>' || {cdata_sql('v.v')} || '</body>'
                          else '' end
                  || case when w.cleared = 1 then '' else e.sites_block end || chr(10) || '    </symbol>'
         else w.xml end as xml,
         case w.section when 'symbols' then 0 when 'files' then 1 when 'semantic_matches' then 2
                        when 'conventions' then 3 else 4 end as sec_rank
  from w5 w
  left join e_sym2 e on w.section = 'symbols' and e.request_id = w.request_id and e.m_pos = w.p1
                      and e.path = w.p2 and e.line = w.p3
  left join vtok v on w.section = 'symbols' and v.request_id = w.request_id and v.m_pos = w.p1
                    and v.path = w.p2 and v.line = w.p3 and v.t = w.halved
  where w.phase not in (4, 5) and w.dropped = 0),
blocks as (
  select request_id, sec_rank, section,
         '  <' || section || '>' || chr(10) || string_agg(xml, chr(10) order by okey, p0, p1, p2, p3, p4, p5) || chr(10)
         || '  </' || section || '>' as block,
         count(*) as n, max(final_tokens) as final_tokens
  from kept group by request_id, sec_rank, section),
packs as (
  select sig.request_id, substr(md5(sig.request_id::varchar), 1, 8) as task_id,
         coalesce(max(b.final_tokens),
                  {tokens_sql(chr(39) + '<context_pack task_id="' + chr(39) + " || substr(md5(sig.request_id::varchar), 1, 8) || "
                              + chr(39) + '" tokens="">' + chr(39))} + {tokens_sql(chr(39) + '</context_pack>' + chr(39))})
           as token_count,
         coalesce(sum(case when b.section = 'symbols' then b.n end), 0) as n_symbols,
         coalesce(sum(case when b.section = 'files' then b.n end), 0) as n_files,
         coalesce(sum(case when b.section = 'semantic_matches' then b.n end), 0) as n_semantic_chunks,
         coalesce(sum(case when b.section = 'conventions' then b.n end), 0) as n_conventions,
         coalesce(sum(case when b.section = 'git_context' then b.n end), 0) as n_git_entries,
         string_agg(b.block, chr(10) order by b.sec_rank) as body
  from sig left join blocks b on b.request_id = sig.request_id
  group by sig.request_id),
packs2 as (
  select *, '<context_pack task_id="' || task_id || '" tokens="' || token_count || '">' || chr(10)
            || case when body is null then '' else body || chr(10) end || '</context_pack>' as xml,
         n_symbols + n_files + n_semantic_chunks + n_conventions + n_git_entries as n_entries
  from packs)
"""


def packs_sql(select: str) -> str:
    return with_views(f"with {RETRIEVAL_CTES},\n{PACK_CTES}\n{select}", _RETRIEVAL_VIEWS)


PACKS = packs_sql("""
select request_id, task_id, token_count::BIGINT as token_count, n_symbols::BIGINT as n_symbols,
       n_files::BIGINT as n_files, n_semantic_chunks::BIGINT as n_semantic_chunks,
       n_conventions::BIGINT as n_conventions, n_git_entries::BIGINT as n_git_entries, md5(xml) as xml_md5
from packs2
""")

ENRICHED = packs_sql("""
, fs as (select conv_id, min(turn) as sys_turn from conversations where role = 'system' group by conv_id),
pk as (select request_id as conv_id, xml from packs2 where n_entries > 0)
select c.conv_id, c.turn, c.role,
       md5(case when pk.xml is not null and c.turn = fs.sys_turn then pk.xml || chr(10) || chr(10) || coalesce(c.text, '')
                else c.text end) as text_md5
from conversations c left join fs using (conv_id) left join pk using (conv_id)
union all
select pk.conv_id, -1, 'system', md5(pk.xml)
from pk where pk.conv_id not in (select conv_id from fs) and pk.conv_id in (select conv_id from conversations)
""")

ORACLE.update({"packs": PACKS, "enriched": ENRICHED})


# ---------------------------------------------------------------------------
# Change feed, request log, cache and vector reuse (batch twins).

_SESSIONS = """
c as (select * from fx_changes),
l as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 600 second then 1 else 0 end as new
      from c window w as (partition by repo_id order by ts, seq)),
s as (select *, sum(new) over (partition by repo_id order by ts, seq
                              rows between unbounded preceding and current row) as sid from l),
ss as (select *, min(ts) over (partition by repo_id, sid) as session_start from s)"""

DEBOUNCE_SESSIONS = with_views(f"""
with {_SESSIONS}
select repo_id, min(ts) as session_start, max(ts) as last_ts, count(*) as n_changes from ss group by repo_id, sid
""", ("fx_changes",))

DEBOUNCE_FLUSH = with_views(f"""
with {_SESSIONS}
select repo_id, session_start, path, arg_max(change_type, seq) as change_type, max(seq) as seq
from ss group by repo_id, session_start, path
""", ("fx_changes",))

_FINAL = f"""
sym as ({SYMBOLS_BY_CONSTRUCTION}),
last as (select repo_id, path, arg_max(change_type, seq) as ct, arg_max(user_id, seq) as u
         from fx_changes group by repo_id, path),
fin as (select l.repo_id, l.path, l.u, f.a, f.b from last l join fx_files f on f.file_id = l.u where l.ct <> 'deleted')"""

CHANGES_FINAL_SYMBOLS = with_views(f"""
with {_FINAL}
select fin.repo_id, fin.path, s.name, s.kind, s.start_line, s.end_line from fin join sym s on s.file_id = fin.u
""", ("fx_changes", "fx_files"))

CHANGES_FINAL_EDGES = with_views(f"""
with {_FINAL}
select distinct x.repo_id, x.path as src, y.path as dst
from fin x join fin y on x.repo_id = y.repo_id and (y.u = x.a or y.u = x.b) and y.u <> x.u
""", ("fx_changes", "fx_files"))

TTL_CACHE = """
with recursive e as (select event_id, user_id as k, ts from events),
chain(k, t0) as (
  select k, min(ts) from e group by k
  union all
  select c.k, n.t
  from chain c, lateral (select min(e.ts) as t from e where e.k = c.k and e.ts > c.t0 + interval 300 second) n
  where n.t is not null),
first_at as (select c.k, min(e.event_id) as event_id from chain c join e on e.k = c.k and e.ts = c.t0 group by c.k, c.t0)
select e.event_id, case when f.event_id is null then 0 else 1 end as compiled
from e left join first_at f on f.event_id = e.event_id
"""

REQUEST_LOG = """
select time_bucket(interval '1 hour', ts) as window_start, event_type as task_type,
       case when event_type = 'error' then '502 ERR' else '200 OK' end as status,
       count(*) as requests, sum(round(value * 100)::bigint)::BIGINT as tokens
from events group by all
"""

VECTOR_REUSE = """
with d as (select source as repo_id, doc_id as chunk_id, md5(text) as h, text from documents),
s as (select distinct source as repo_id, md5(text) as h from documents where lang = 'en'),
r as (select d.*, exists (select 1 from s where s.repo_id = d.repo_id and s.h = d.h) as hit from d)
select chunk_id, hit::INTEGER as reused,
       case when hit then length(text)::VARCHAR else concat(length(text), ' ', length(text) - length(replace(text, ' ', ''))) end as vector
from r
"""

ORACLE.update({
    "debounce_sessions": DEBOUNCE_SESSIONS,
    "debounce_flush": DEBOUNCE_FLUSH,
    "changes_final_symbols": CHANGES_FINAL_SYMBOLS,
    "changes_final_edges": CHANGES_FINAL_EDGES,
    "ttl_cache": TTL_CACHE,
    "request_log": REQUEST_LOG,
    "vector_reuse": VECTOR_REUSE,
})

ORACLE["flush_one_repo"] = with_views(f"""
with sym as ({SYMBOLS_BY_CONSTRUCTION}),
last as (select repo_id, path, arg_max(change_type, seq) as ct, arg_max(user_id, seq) as u
         from fx_changes where ts < timestamp '2024-01-15 00:00:00' or repo_id = '1' group by repo_id, path),
fin as (select l.repo_id, l.path, l.u, f.a, f.b, f.content from last l join fx_files f on f.file_id = l.u where l.ct <> 'deleted')
select repo_id, 'file' as kind, path as a, md5(content) as b from fin
union all
select * from (select distinct x.repo_id, 'edge', x.path, y.path
               from fin x join fin y on x.repo_id = y.repo_id and (y.u = x.a or y.u = x.b) and y.u <> x.u)
union all
select fin.repo_id, 'chunk', fin.path, md5(s.body) from fin join sym s on s.file_id = fin.u where s.kind <> 'class'
""", ("fx_changes", "fx_files"))

ORACLE["store_history"] = with_views("""
with last as (select repo_id, path, arg_max(change_type, seq) as ct, arg_max(user_id, seq) as u from fx_changes group by repo_id, path),
fin as (select nullif(l.repo_id, '1') as repo_id, l.path, l.u, f.a, f.b, f.content from last l join fx_files f on f.file_id = l.u where l.ct <> 'deleted')
select repo_id, 'file' as kind, path as a, md5(content) as b from fin
union all
select * from (select distinct x.repo_id, 'edge', x.path, y.path
               from fin x join fin y on x.repo_id is not distinct from y.repo_id and (y.u = x.a or y.u = x.b) and y.u <> x.u)
""", ("fx_changes", "fx_files"))

ORACLE["find_files"] = retrieval("""
select distinct m.mention, f.path from (select distinct unnest(files) as mention from sig) m
join fx_files f on contains(f.path, m.mention)
""")

ORACLE["definitions"] = with_views(f"""
with s as ({SYMBOLS_BY_CONSTRUCTION})
select name, row_number() over (partition by name order by path, start_line)::INTEGER as rank, path,
       start_line, kind from s
""", ("fx_files",))

ORACLE["chat_bodies"] = """
select conv_id as request_id,
       md5(coalesce(string_agg(case when role = 'user' then text end, chr(10) order by turn), '')) as prompt_md5,
       count(*)::INTEGER as n_messages
from conversations group by conv_id
"""

ORACLE["preview"] = packs_sql("""
select p.request_id,
       to_json({'signals': {'task_type': s.task_type, 'symbols': s.symbols, 'file_mentions': s.files,
                            'scope_hint': s.raw_prompt},
                'pack_xml': p.xml, 'pack_tokens': p.token_count,
                'summary': {'n_symbols': p.n_symbols, 'n_files': p.n_files,
                            'n_semantic_chunks': p.n_semantic_chunks, 'n_conventions': p.n_conventions,
                            'n_git_entries': p.n_git_entries, 'token_count': p.token_count}})::VARCHAR as preview
from packs2 p join sig s using (request_id)
""")
