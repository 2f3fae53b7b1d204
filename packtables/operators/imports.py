"""Import statements (X4-X6) with column functions alone.

One tokenising pattern per language consumes comments, strings and import
statements from left to right, so an import inside a comment or a string is not
seen. A match's line comes from the line feeds in the texts before it: the
pieces between matches and the matches themselves. Repeated groups are
possessive, so long strings and comments need no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_C_COMMENTS = r"//[^\n]*|(?s:/\*.*?(?:\*/|\z))"
_QUOTED = r""""(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'"""
_TEMPLATE = r"`(?:[^`\\]++|(?s:\\.))*+`"
_RAW = r"`[^`]*+`"
_PY_STRINGS = (r'"""(?:[^"\\]++|(?s:\\.)|"(?!""))*+"""' + r"|'''(?:[^'\\]++|(?s:\\.)|'(?!''))*+'''|"
               + r'"(?:[^"\\\n]++|(?s:\\.))*+"' + r"|'(?:[^'\\\n]++|(?s:\\.))*+'")

#: A statement is a match that begins (after blanks, ``;`` or ``:``) with import or from.
_PY_STATEMENT = (r"(?m:(?:^|(?<=[;:]))[ \t]*+(?:from[ \t]*+[.\w]+(?:[ \t]*+\.[ \t]*+\w+)*+[ \t]+import\b[ \t]*+"
                 r"(?:\((?:#[^\n]*+|[^)#])*+\)|(?:\\\n|[^\n;#])*+)|import[ \t]+(?:\\\n|[^\n;#])*+))")
_JS_STATEMENT = r"""(?m:^[ \t]*+import\s+(?:type\s+)?(?:[^'";]*?\s*from\s*)?['"][^'"\n]+['"])"""
_GO_STATEMENT = r"(?m:^import[ \t]*+(?:\((?:" + _C_COMMENTS + "|" + _QUOTED + "|" + _RAW + r"|[^)\"'`/])*+\)|[^\n]*+))"

PATTERNS = {
    "python": f"{_PY_STATEMENT}|{_PY_STRINGS}|#[^\\n]*",
    "js": f"{_C_COMMENTS}|{_JS_STATEMENT}|{_TEMPLATE}|{_QUOTED}",
    "go": f"{_C_COMMENTS}|{_GO_STATEMENT}|{_RAW}|{_QUOTED}",
}
_GO_PATHS = f"{_C_COMMENTS}|{_RAW}|{_QUOTED}"


def _feeds(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _pieces(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Adds ``m`` (matches), ``p`` (texts between) and ``nl`` (line feeds of each text and the match after it)."""
    df = df.withColumn("m", F.regexp_extract_all(text, F.lit(pattern), 0))
    df = df.withColumn("p", F.split(text, pattern, -1))
    return df.withColumn("nl", F.transform("m", lambda m, i: _feeds(F.get("p", i)) + _feeds(m)))


def _rows(df: DataFrame, keep, keys: list[str], first_line: Column) -> DataFrame:
    """One row per kept match: ``s`` (its text without leading blanks), ``line``, ``col`` (places before it in its line).

    A match becomes a row of its own with its number of line feeds; only kept ones carry texts. The lines before it are a running sum over
    the matches of its file, so the work grows with their number.
    """
    hits = F.transform("m", lambda m, i: F.struct(i.alias("i"), F.get("nl", i).alias("nl"), F.when(keep(m), m).alias("t"), F.when(keep(m), F.get("p", i)).alias("b")))
    earlier = Window.partitionBy(*keys).orderBy("h.i").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(*keys, F.explode(hits).alias("h")).withColumn("n", F.coalesce(F.sum("h.nl").over(earlier), F.lit(0))).filter("h.t is not null")
    s = F.regexp_replace(F.col("h.t"), r"^\s+", "")
    lead = F.substring(F.col("h.t"), F.lit(1), F.length("h.t") - F.length(s))
    ahead = F.concat("h.b", lead)
    col = F.length(F.regexp_extract(ahead, r"([^\n]*)\z", 1))
    return rows.select(*keys, s.alias("s"), (first_line + F.col("n") + _feeds(ahead)).cast("int").alias("line"), col.cast("int").alias("col"))


def _is_import(m: Column) -> Column:
    return m.rlike(r"^\s*(?:import|from)\b")


def _names(clause: Column) -> Column:
    """Imported names of a comma list: ``a as b`` gives a; ``type a`` gives a."""
    parts = F.split(clause, ",")
    clean = F.transform(parts, lambda x: F.regexp_replace(F.btrim(F.regexp_replace(x, r"\s+", " ")), r"^type | as .*$", ""))
    return F.filter(F.transform(clean, lambda x: F.btrim(x)), lambda x: x != "")


def _python(files: DataFrame) -> DataFrame:
    rows = _rows(_pieces(files, "content", PATTERNS["python"]), _is_import, ["repo_id", "path"], F.lit(1))
    s = F.regexp_replace(F.regexp_replace("s", r"\\\n", " "), r"#[^\n]*", "")
    rows = rows.withColumn("s", s)
    is_from = F.col("s").startswith("from")
    source = F.when(is_from, F.regexp_replace(F.regexp_extract("s", r"^from\s*([.\w \t]+?)\s+import\b", 1), r"\s", "")) \
        .otherwise(F.regexp_extract("s", r"^import\s+([\w.]+)", 1))
    clause = F.regexp_replace(F.regexp_extract("s", r"(?s)^from\s*[.\w \t]+?\s+import\b(.*)$", 1), r"[()]", " ")
    names = F.when(is_from, _names(clause)).otherwise(F.array().cast("array<string>"))
    return rows.select("repo_id", "path", source.alias("source"), names.alias("names"), "line", "col") \
        .filter((F.col("source") != "") & (F.col("source") != "__future__"))


def _js(files: DataFrame) -> DataFrame:
    rows = _rows(_pieces(files, "content", PATTERNS["js"]), _is_import, ["repo_id", "path"], F.lit(1))
    source = F.regexp_extract("s", r"""['"]([^'"]+)['"]$""", 1)
    clause = F.regexp_extract("s", r"(?s)^import\s+(?:type\s+)?([^'\";]*?)\s*from\s*['\"]", 1)
    inner = F.regexp_extract(clause, r"\{([^}]*)\}", 1)
    head = F.filter(_names(F.regexp_replace(clause, r"(?s)\{.*", "")), lambda x: x.rlike(r"^[A-Za-z_$][\w$]*$"))
    names = F.concat(head, _names(inner))
    return rows.select("repo_id", "path", source.alias("source"), names.alias("names"), "line", F.lit(0).alias("col"))


def _go(files: DataFrame) -> DataFrame:
    rows = _rows(_pieces(files, "content", PATTERNS["go"]), _is_import, ["repo_id", "path"], F.lit(1))
    rows = rows.withColumnRenamed("line", "at").drop("col")
    paths = _rows(_pieces(rows, "s", _GO_PATHS), lambda m: m.rlike('^["`]'), ["repo_id", "path", "at"], F.col("at"))
    return paths.select("repo_id", "path", F.regexp_replace("s", '^["`]|["`]$', "").alias("source"),
                        F.array().cast("array<string>").alias("names"), "line", F.lit(0).alias("col"))


def extract_imports(files: DataFrame) -> DataFrame:
    """``imports(repo_id, path, source, names, line, col)`` of ``files(repo_id, path, lang, content)``."""
    f = files.select("repo_id", "path", "lang", F.coalesce("content", F.lit("")).alias("content"))
    own = lambda *langs: f.filter(F.col("lang").isin(*langs))
    return _python(own("python")).unionByName(_js(own("typescript", "tsx", "javascript"))).unionByName(_go(own("go")))
