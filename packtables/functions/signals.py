"""Request signals (P1-P7) as Column expressions.

Everything here is JVM-side (regex, arrays, md5); no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# They must equal the reference's for equal results.
# Task keywords, checked class by class in this order; the first hit wins.
TASK_KEYWORDS = (
    ("refactor", ("refactor", "rename", "extract", "move", "reorganize")),
    ("debug", ("bug", "error", "fix", "broken", "failing", "crash", "exception", "traceback")),
    ("add_feature", ("add", "implement", "create", "build", "new feature")),
    ("explain", ("explain", "how does", "what does", "walk me through")),
    ("test", ("test", "spec", "coverage", "unit test")),
)
# Symbol mentions: capitalised dotted names, and lowerCamel names.
SYMBOL_PATTERN = r"\b([A-Z][a-zA-Z0-9]*(?:\.[a-zA-Z][a-zA-Z0-9]*)*)\b"
CAMEL_PATTERN = r"\b([a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*)\b"
# File mentions: whitespace-led tokens with a slash, or names with one of these extensions.
FILE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "rb", "css", "scss", "html",
                   "json", "yaml", "yml", "toml", "md")
FILE_PATTERN = (r"(?:^|\s)([a-zA-Z0-9_./-]+(?:/[a-zA-Z0-9_./-]+)+)"
                r"|(?:^|\s)([a-zA-Z0-9_.-]+\.(?:" + "|".join(FILE_EXTENSIONS) + r"))\b")
# ---------------------------------------------------------------------------

# Java's \b and \s follow Unicode with (?U), as Python's str patterns do.
_U = "(?U)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def task_type(prompt, word_boundaries: bool = False) -> Column:
    """First keyword class that occurs in the case-folded prompt."""
    low = F.lower(_col(prompt))
    expr = None
    for name, words in TASK_KEYWORDS:
        if word_boundaries:
            cond = low.rlike(_U + r"\b(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")\b")
        else:
            cond = None
            for w in words:
                c = low.contains(w)
                cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("other"))


def symbol_mentions(prompt) -> Column:
    """Sorted distinct symbol mentions."""
    p = F.coalesce(_col(prompt), F.lit(""))
    caps = F.regexp_extract_all(p, F.lit(_U + SYMBOL_PATTERN), 1)
    caps = F.filter(caps, lambda s: (F.length(s) > 1) & (s != F.upper(s)))
    camel = F.regexp_extract_all(p, F.lit(_U + CAMEL_PATTERN), 1)
    return F.array_sort(F.array_distinct(F.concat(caps, camel)))


def file_mentions(prompt) -> Column:
    """Sorted distinct file mentions (either alternative of the pattern)."""
    p = F.coalesce(_col(prompt), F.lit(""))
    pat = F.lit(_U + FILE_PATTERN)
    both = F.concat(F.regexp_extract_all(p, pat, 1), F.regexp_extract_all(p, pat, 2))
    both = F.transform(both, lambda s: F.trim(s))
    return F.array_sort(F.array_distinct(F.filter(both, lambda s: s != F.lit(""))))


def fingerprint(raw_prompt, ttype, symbols, files) -> Column:
    """md5 of prompt|type|symbols|files (lists sorted, comma-joined)."""
    return F.md5(F.concat_ws("|", F.coalesce(_col(raw_prompt), F.lit("")), _col(ttype),
                             F.array_join(_col(symbols), ","), F.array_join(_col(files), ",")))


def prompts_from_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                       role_col: str = "role", text_col: str = "text",
                       out_col: str = "request_id") -> DataFrame:
    """P1 (long form): user turns in turn order joined by newline; every
    conversation yields one row, '' when it has no user turn.

    The ordered text is assembled per conversation: the prompt is one value
    by definition. Partial aggregation keeps the shuffle to one row per
    conversation and map task.
    """
    part = F.when(F.col(role_col) == "user",
                  F.struct(F.col(turn_col).alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("x")))
    return (turns.groupBy(F.col(id_col).alias(out_col))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["x"]),
                              "\n").alias("prompt")))


def prompt_from_messages(messages) -> Column:
    """P1 (wide form): ``messages array<struct<role, content, parts>>`` where a
    message has either string ``content`` or ``parts array<struct<type,text>>``."""
    users = F.filter(_col(messages), lambda m: m["role"] == "user")
    texts = F.transform(users, lambda m: F.when(
        m["content"].isNotNull(), F.array(m["content"])).otherwise(
        F.transform(F.filter(F.coalesce(m["parts"], F.array().cast("array<struct<type:string,text:string>>")),
                             lambda p: p["type"] == "text"), lambda p: p["text"])))
    return F.array_join(F.flatten(texts), "\n")


def with_signals(requests: DataFrame, prompt_col: str = "prompt", word_boundaries: bool = False,
                 symbol_stop_words: tuple[str, ...] = (), trim_file_dots: bool = False) -> DataFrame:
    """One pass adding every signal column.

    Options for documented quirks (defaults keep the reference's behaviour):
    ``word_boundaries`` (Q1), ``symbol_stop_words`` (Q2), ``trim_file_dots`` (Q4).
    """
    raw = F.coalesce(F.col(prompt_col), F.lit(""))
    df = requests.withColumn("raw_prompt", raw)
    df = (df.withColumn("task_type", F.when(F.col("raw_prompt") == "", F.lit("other"))
                        .otherwise(task_type("raw_prompt", word_boundaries)))
          .withColumn("symbols", symbol_mentions("raw_prompt"))
          .withColumn("file_mentions", file_mentions("raw_prompt")))
    if symbol_stop_words:
        stop = F.array(*[F.lit(w) for w in symbol_stop_words])
        df = df.withColumn("symbols", F.array_except("symbols", stop))
    if trim_file_dots:
        df = df.withColumn("file_mentions", F.array_sort(F.array_distinct(F.filter(
            F.transform("file_mentions", lambda f: F.regexp_replace(f, r"\.+$", "")), lambda f: f != ""))))
    if "scope_hint" in requests.columns:
        df = df.withColumn("scope_hint", F.coalesce(F.nullif(F.col("scope_hint"), F.lit("")), F.col("raw_prompt")))
    else:
        df = df.withColumn("scope_hint", F.col("raw_prompt"))
    return df.withColumn("fingerprint", fingerprint("raw_prompt", "task_type", "symbols", "file_mentions"))
