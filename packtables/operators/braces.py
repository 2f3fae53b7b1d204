"""Definitions and calls of JavaScript/TypeScript and Go (X2, X3, X7) with column functions, joins and windows.

1. *Mask*: one tokenising pattern consumes comments and strings; their characters become blanks in a copy of the text of equal
   length, so nothing inside them is seen.
2. *Marks*: each pattern (function heads, classes, methods, arrows, type specs, calls) and the single characters that structure
   a text (brackets, semicolons, line feeds) are found in the mask. A mark's place is the running sum of the lengths of
   matches and the texts between them.
3. *Structure*: running sums over a file's marks give depths, lines and columns. Marks of one depth come in order, so the brace that
   closes a block is the next one of its depth, and the block that holds a place at some depth is the last one opened there.
4. *Texts*: a definition's body and first line are cut from the content, joined once per file.

Texts are dealt by (repository, path) once, and all marks, windows, groups and joins of a file stay there; a file is as much as a task holds. Nested depth costs a row
for each level around a definition, nothing is quadratic in a file's length. Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packtables.operators.imports import _C_COMMENTS
from packtables.session import cut_dealt

NAMED = ["repo_id", "path"]
FILE = ["file", *NAMED]         # a hash leads: sorts tell files apart by their first eight bytes

# Comments and strings; a quote that is not closed on its line ends there, a template or raw string where it is closed.
_LINE_STRINGS = r""""(?:\\(?s:.)|[^"\\\n])*+"?|'(?:\\(?s:.)|[^'\\\n])*+'?"""
BLANKED = {"js": f"{_C_COMMENTS}|{_LINE_STRINGS}" + r"|`(?:\\(?s:.)|[^`\\])*+`?", "go": f"{_C_COMMENTS}|{_LINE_STRINGS}" + r"|`[^`]*+`?"}

_NAME, _AFTER = r"[A-Za-z_$][\w$]*+", r"(?<![\w$.])"
_CALL = _AFTER + rf"{_NAME}(?:\s*+\??\.\s*+[A-Za-z_$#][\w$]*+)*+\s*+(?:<[\w$<>,\s\[\]]*>)?\s*+\("
PATTERNS = {
    "js": {
        "function": _AFTER + rf"(?:async\s+)?function\s*+\*?\s*+{_NAME}\s*+(?:<[^>{{]*+>)?\s*+\(",
        "class": _AFTER + rf"class\s+{_NAME}[^{{;]*+\{{",
        "method": r"(?m:^)[ \t]*+(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)\s+)*\*?\s*+"
                  r"[A-Za-z_$#][\w$]*\s*+(?:<[^>{]*+>)?\s*+\([^)]*+\)\s*+(?::[^{;]++)?\{",
        "arrow": _AFTER + rf"(?:const|let)\s+{_NAME}\s*+(?::[^=;]++)?=\s*+(?:async\s+)?(?:\([^)]*+\)|{_NAME})\s*+(?::[^=;{{]++)?=>\s*+",
        "call": _CALL,
    },
    "go": {
        "function": r"(?m:^)func\s+(?:\([^)]*+\)\s*+)?[A-Za-z_]\w*+\s*+(?:\[[^\]]*+\])?\s*+\(",
        "type": r"(?m:^)type\s+(?:\(|[ \t]*+[A-Za-z_]\w*+)",
        "spec": r"(?m:^)[ \t]*+[A-Za-z_]\w*+",
        "call": _CALL,
    },
}
# The characters that structure a text; Go needs no depth but that of braces.
STRUCTURE = {"js": r"[(){}\[\];\n]", "go": r"[{})\n]"}

# Words that look like calls but are statements.
NOT_CALLS = {
    "js": ["if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "new", "delete", "void", "in", "of",
           "instanceof", "yield", "class", "do", "else", "import", "export", "throw", "case", "with"],
    "go": ["if", "for", "switch", "func", "return", "select", "go", "defer", "range", "case", "else", "type", "struct", "interface",
           "map", "chan", "package", "import", "var", "const"],
}


def masked(text: Column, pattern: str) -> Column:
    """``text`` with blanks for the characters of comments and strings; line feeds and the quotes around a string stay."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    blank = lambda s: F.regexp_replace(s, r"[^\n]", " ")
    blanks = F.transform(found, lambda m: F.when(m.startswith("/"), blank(m)).otherwise(
        F.concat(F.substring(m, 1, 1), blank(F.substring(m, 2, F.length(m) - 2)), F.when(F.length(m) > 1, F.when(
            F.right(m, F.lit(1)) == F.substring(m, 1, 1), F.right(m, F.lit(1))).otherwise(blank(F.right(m, F.lit(1))))).otherwise(""))))
    return F.array_join(F.zip_with(between, blanks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def _found(kind: str) -> Column:
    """``kind, i, gap`` (length of the text before), ``m`` and ``tail`` (the last characters before) of each match; needs ``m_`` and ``p_<kind>``."""
    between = F.col(f"p_{kind}")
    return F.transform(f"m_{kind}", lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(between, i)).alias("gap"), m.alias("m"),
        (F.right(F.get(between, i), F.lit(10)) if kind == "call" else F.lit("")).alias("tail")))


def marks(files: DataFrame, lang: str) -> DataFrame:
    """``repo_id, path, size, kind, m, tail, start, stop`` of every mark of the files (``stop`` is the place after it), where the texts are."""
    t = files.select(*FILE, masked(F.coalesce("content", F.lit("")), BLANKED[lang]).alias("mask"))
    # generators between the mask, the matches and their uses: each is made once a file
    t = t.select(*FILE, F.explode(F.array("mask")).alias("mask"))
    kinds = {**{k: "(?U)" + p for k, p in PATTERNS[lang].items()}, "mark": STRUCTURE[lang]}
    arrays = [F.length("mask").alias("size")]
    for k, p in kinds.items():
        # specs are a match a line: only where a group of types begins
        text = F.when(F.col("mask").rlike(r"(?m)^type\s+\("), F.col("mask")).otherwise("") if k == "spec" else F.col("mask")
        arrays += [F.regexp_extract_all(text, F.lit(p), 0).alias(f"m_{k}"), F.split(text, p, -1).alias(f"p_{k}")]
    t = t.select(*FILE, F.inline(F.array(F.struct(*arrays))))
    rows = t.select(*FILE, "size", F.explode(F.concat(*[_found(k) for k in kinds])).alias("f")).select(*FILE, "size", "f.*")
    w = Window.partitionBy(*FILE, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.length("m")).over(w).cast("int"))
    return rows.withColumn("start", F.col("stop") - F.length("m")).drop("gap", "i")


def _structure(rows: DataFrame) -> DataFrame:
    """The single characters at ``p`` with the ``depth`` (of all brackets) and ``braces`` around them.

    ``close`` of an opening brace is the brace that closes it: its place and whether a semicolon follows it (null: none does).
    """
    s = rows.filter(F.col("kind") == "mark").select(*FILE, "m", F.col("start").alias("p"))
    order = Window.partitionBy(*FILE).orderBy("p")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    step = lambda opening, closing: F.when(F.col("m").isin(*opening), 1).when(F.col("m").isin(*closing), -1).otherwise(0)
    s = s.withColumn("depth", F.coalesce(F.sum(step("([{", ")]}")).over(before), F.lit(0))) \
        .withColumn("braces", F.coalesce(F.sum(step("{", "}")).over(before), F.lit(0))) \
        .withColumn("semicolon", F.coalesce((F.lead("m").over(order) == ";") & (F.lead("p").over(order) == F.col("p") + 1), F.lit(False)))
    level = F.when(F.col("m") == "{", F.col("braces") + 1).when(F.col("m") == "}", F.col("braces"))
    s = s.withColumn("level", level)
    partner = F.lead(F.when(F.col("m") == "}", F.struct("p", "semicolon"))).over(Window.partitionBy(*FILE, "level").orderBy("p"))
    return s.withColumn("close", F.when(F.col("m") == "{", partner))


def _probed(structure: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes(repo_id, path, p, ...)`` with what stands around place ``p``: ``depth``, ``braces``, their least number so far
    (``floor``), ``line``, ``bol`` (first place of the line), and the next brace that opens (``open``: place and close), line feed and closing parenthesis at or after it.
    """
    own = [c for c in probes.columns if c not in FILE]
    both = structure.select(*FILE, "p", "m", F.col("depth").alias("d"), F.col("braces").alias("b"), "close", F.lit(1).alias("mark")) \
        .unionByName(probes.withColumn("mark", F.lit(0)), allowMissingColumns=True)
    behind = Window.partitionBy(*FILE).orderBy("p", "mark").rowsBetween(Window.unboundedPreceding, 0)
    # what comes next is what came last in the other order: frames that grow cost a step a row, frames that shrink a pass
    ahead = Window.partitionBy(*FILE).orderBy(F.desc("p"), F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    next_of = lambda c, value: F.last(F.when(F.col("m") == c, value), ignorenulls=True).over(ahead)
    feed = F.col("m") == "\n"
    both = both.withColumns({
        "depth": F.coalesce(F.last(F.when(F.col("mark") == 1, F.col("d") + F.when(F.col("m").isin("(", "[", "{"), 1)
                                          .when(F.col("m").isin(")", "]", "}"), -1).otherwise(0)), ignorenulls=True).over(behind), F.lit(0)),
        "braces": F.coalesce(F.last(F.when(F.col("mark") == 1, F.col("b") + F.when(F.col("m") == "{", 1).when(F.col("m") == "}", -1).otherwise(0)),
                                    ignorenulls=True).over(behind), F.lit(0)),
        "floor": F.least(F.lit(0), F.min(F.when(F.col("mark") == 1, F.col("b") - F.when(F.col("m") == "}", 1).otherwise(0))).over(behind)),
        "line": (F.lit(1) + F.count_if(feed).over(behind)).cast("int"),
        "bol": F.coalesce(F.max(F.when(feed, F.col("p") + 1)).over(behind), F.lit(0)),
        "open": next_of("{", F.struct("p", "close")), "feed": next_of("\n", F.col("p")), "paren": next_of(")", F.col("p"))})
    return both.filter("mark = 0").select(*FILE, *own, "depth", "braces", "floor", "line", "bol", "open", "feed", "paren")


def _heads(rows: DataFrame, structure: DataFrame, kinds: list[str], first: Column, anchor: Column) -> DataFrame:
    """Marks of ``kinds`` with what stands around their ``first`` place, and, as ``a``, around the ``anchor`` they look from."""
    h = rows.filter(F.col("kind").isin(*kinds)).withColumns({"first": first, "anchor": anchor}).drop("tail")
    places = F.explode(F.array(F.struct(F.lit(0).alias("tag"), F.col("first").alias("p")), F.struct(F.lit(1).alias("tag"), F.col("anchor").alias("p"))))
    around = _probed(structure, h.withColumn("x", places).select("*", "x.*").drop("x"))
    facts = F.struct("depth", "braces", "line", "bol", "open", "feed", "paren")
    return around.groupBy(*FILE, "kind", "start", "stop", "m", "size", "first", "anchor").agg(
        F.max(F.when(F.col("tag") == 0, F.struct("depth", "braces", "floor", "line", "bol"))).alias("f"),
        F.first(F.when(F.col("tag") == 1, facts), ignorenulls=True).alias("a"))


def _ended(defs: DataFrame, structure: DataFrame, files: DataFrame) -> DataFrame:
    """Symbol rows of ``defs(name, what, first, last, f, bodied)``: the line of ``last`` and the texts from the content."""
    at_end = _probed(structure, defs.withColumn("p", F.col("last"))).withColumn("end_line", F.col("line"))
    text = at_end.select(*FILE, "name", "what", "first", "last", "bodied", "f", "end_line").join(files.select(*FILE, "content"), FILE)
    body = F.substring("content", F.col("first") + 1, F.col("last") + 1 - F.col("first"))
    line = F.substring_index(F.substring("content", F.col("f.bol") + 1, F.lit(2 ** 31 - 1)), "\n", 1)
    stripped = F.regexp_replace(line, r"^\s+|\s+$", "")
    return text.select(
        *FILE, F.lit("symbol").alias("tag"), "name", F.col("what").alias("kind"), F.col("f.line").cast("int").alias("start_line"),
        F.col("end_line").cast("int").alias("end_line"), F.col("first").cast("int").alias("col"), F.when(F.col("bodied"), body).otherwise("").alias("body"),
        F.when(F.col("bodied"), stripped).otherwise("").alias("signature"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("error"))


def _classes_around(heads: DataFrame, structure: DataFrame) -> DataFrame:
    """``repo_id, path, kind, start, class, class_level``: the innermost class block around each function and method head.

    The block around a place at some depth is the last one that opened at that depth, if the place is that deep.
    """
    kind = F.col("kind")
    # braces that close nothing lower the count for the rest of the file: blocks open above the lowest count so far
    asks = heads.filter(kind.isin("function", "method") & (F.col("f.braces") > F.col("f.floor"))).select(
        *FILE, F.explode(F.sequence(F.col("f.floor").cast("long") + 1, F.col("f.braces").cast("long"))).alias("level"), F.col("start").alias("p"), "kind", F.lit(2).alias("turn"))
    opened = structure.filter("m = '{'").select(*FILE, F.col("level").cast("long").alias("level"), "p", F.lit(0).alias("turn"))
    classes = heads.filter(kind == "class").select(*FILE, (F.col("a.braces") + 1).cast("long").alias("level"), F.col("anchor").alias("p"), F.lit(1).alias("turn"),
                                                    F.col("name").alias("class"))
    rows = opened.unionByName(classes, allowMissingColumns=True).unionByName(asks, allowMissingColumns=True)
    last = Window.partitionBy(*FILE, "level").orderBy("p", "turn").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("turn") < 2, F.struct("class")), ignorenulls=True).over(last)
    inner = rows.withColumn("held", held["class"]).filter("turn = 2 and held is not null")
    return inner.groupBy(*FILE, "kind", F.col("p").alias("start")).agg(F.max_by("held", "level").alias("class"), F.max("level").alias("class_level"))


def _expression_ends(arrows: DataFrame, structure: DataFrame) -> DataFrame:
    """``end``: the first mark of an arrow's own depth at or after its expression: a bracket that closes around it, ``;`` or a line feed."""
    stops = structure.filter("m in (')', ']', '}', ';', '\n')").select(*FILE, "p", "depth", F.lit(1).alias("mark"), F.struct("p", "m").alias("stop_at"))
    asks = arrows.select(*FILE, "start", F.col("anchor").alias("p"), F.col("a.depth").alias("depth"), F.lit(0).alias("mark"))
    w = Window.partitionBy(*FILE, "depth").orderBy(F.desc("p"), F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    both = stops.unionByName(asks, allowMissingColumns=True).withColumn("s", F.last("stop_at", ignorenulls=True).over(w))
    return both.filter("mark = 0").select(*FILE, "start", F.col("s.p").alias("end"), (F.col("s.m") == ";").alias("semicolon"))


def _js(rows: DataFrame, structure: DataFrame) -> DataFrame:
    """``name, what, first, last, f, bodied, name_at`` of every definition."""
    kind, lead = F.col("kind"), F.length("m") - F.length(F.regexp_replace("m", r"^\s+", ""))
    first = F.when(kind == "method", F.col("start") + lead).otherwise(F.col("start"))
    anchor = F.when(kind.isin("class", "method"), F.col("stop") - 1).otherwise(F.col("stop"))
    h = _heads(rows, structure, ["function", "class", "method", "arrow"], first, anchor)
    named = {"function": rf"function\s*\*?\s*({_NAME})", "class": rf"^class\s+({_NAME})", "arrow": rf"^(?:const|let)\s+({_NAME})",
             "method": r"([A-Za-z_$#][\w$]*)\s*(?:<[^>{]*>)?\s*\([^)]*\)\s*(?::[^{;]+)?\{$"}
    name = F.coalesce(*[F.when(kind == k, F.regexp_extract("m", "(?U)" + p, 1)) for k, p in named.items()])
    h = cut_dealt(h.withColumn("name", name))           # a few rows of each file, read three times
    h = h.join(_classes_around(h, structure), [*FILE, "kind", "start"], "left")
    h = h.join(_expression_ends(h.filter(kind == "arrow"), structure).withColumn("kind", F.lit("arrow")), [*FILE, "kind", "start"], "left")
    closed = F.coalesce(F.col("a.open.close.p"), F.col("size") - 1)
    block = F.col("a.open.p") == F.col("anchor")
    end = F.when(block, closed + 1 + F.coalesce(F.col("a.open.close.semicolon"), F.lit(False)).cast("int")).otherwise(
        F.coalesce(F.col("end") + F.col("semicolon").cast("int"), F.col("size")))
    last = F.when(kind == "arrow", F.greatest(F.col("first"), F.coalesce(end, F.col("size")) - 1)).otherwise(closed)
    own = F.col("class").isNotNull() & (F.col("class_level") == F.col("f.braces")) & ~F.col("name").isin(*NOT_CALLS["js"])
    h = h.filter(kind.isin("class", "arrow") | ((kind == "function") & F.col("a.open").isNotNull()) | ((kind == "method") & own))
    member = F.col("class").isNotNull() & kind.isin("function", "method")
    what = F.when(kind == "class", "class").when(member, "method").otherwise("function")
    at = F.col("start") + F.length("m") - F.length(F.regexp_extract("m", rf"(?U)({_NAME}\s*(?:<[^>{{]*>)?\s*\((?:[^)]*\)\s*(?::[^{{;]+)?\{{)?)$", 1))
    return h.select(*FILE, F.when(member, F.concat_ws(".", "class", "name")).otherwise(F.col("name")).alias("name"), what.alias("what"), "first",
                    last.alias("last"), "f", (kind != "class").alias("bodied"), F.when(kind.isin("function", "method"), at).alias("name_at"))


def _go(rows: DataFrame, structure: DataFrame) -> DataFrame:
    """``name, what, first, last, f, bodied, name_at`` of every definition."""
    kind = F.col("kind")
    word = r"(?U)([A-Za-z_]\w*)"
    rows = rows.filter(kind.isin("function", "type", "spec"))
    grouped = (kind == "type") & F.col("m").endswith("(")
    at_name = F.col("stop") - F.length(F.regexp_extract("m", word + "$", 1))
    first = F.when(kind == "function", F.col("start")).when(grouped, F.col("stop")).otherwise(at_name)
    h = _heads(rows, structure, ["function", "type", "spec"], first, F.when(kind == "function", F.col("stop")).otherwise(first))
    # a spec counts within a group of types: after its parenthesis, before the next one that closes, as deep in braces as the group
    w = Window.partitionBy(*FILE).orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    group = F.last(F.when(grouped, F.struct(F.coalesce("a.paren", "size").alias("close"), F.col("f.braces").alias("braces"))), ignorenulls=True).over(w)
    h = h.withColumn("group", group).filter(~grouped & ((kind != "spec") | (
        (F.col("first") < F.col("group.close")) & (F.col("f.braces") == F.col("group.braces")))))
    receiver = F.regexp_extract("m", r"^func\s+\(([^)]*)\)", 1)
    owner = F.regexp_replace(F.element_at(F.split(F.btrim(F.regexp_replace(receiver, r"\s+", " ")), " "), -1), r"^\*+", "")
    method = F.col("m").rlike(r"^func\s+\(")
    own = F.regexp_extract("m", word + r"\s*(?:\[[^\]]*\])?\s*\($", 1)
    name = F.when(kind == "function", F.when(method & (owner != ""), F.concat_ws(".", owner, own)).otherwise(own)).otherwise(F.regexp_extract("m", word + "$", 1))
    closed = F.coalesce(F.col("a.open.close.p"), F.col("size") - 1)
    feed = F.coalesce("a.feed", "size")
    # a type ends with its line, or with the line that closes the brace on it
    last = F.when(kind == "function", F.when(F.col("a.open").isNotNull(), closed).otherwise(feed - 1)).when(
        F.col("a.open.p") < feed, F.greatest(F.col("first"), closed)).otherwise(F.greatest(F.col("first"), feed - 1))
    what = F.when(kind != "function", "class").when(method, "method").otherwise("function")
    at = F.col("stop") - F.length(F.regexp_extract("m", "(" + word + r"\s*(?:\[[^\]]*\])?\s*\()$", 1))
    return h.select(*FILE, name.alias("name"), what.alias("what"), "first", last.alias("last"), "f", (kind == "function").alias("bodied"),
                    F.when(kind == "function", at).otherwise(F.col("first")).alias("name_at"))


def _calls(rows: DataFrame, structure: DataFrame, defs: DataFrame) -> DataFrame:
    """Call rows: the callee as written, its line and its place in it; statements and the names of definitions are none."""
    callee = F.regexp_extract("m", rf"(?U)^({_NAME}(?:\s*\??\.\s*[A-Za-z_$#][\w$]*)*)", 1)
    c = rows.filter((F.col("kind") == "call") & ~F.col("tail").rlike(r"(?:function|func|new)\s*$")).withColumn("name", callee)
    word = F.regexp_extract("name", r"(?U)^([\w$]+)", 1)
    statement = F.lit(False)
    for lang, words in NOT_CALLS.items():
        statement = statement | ((F.col("rules") == lang) & word.isin(*words))
    c = c.filter(~statement).select(*FILE, "name", F.col("start").alias("p"))
    named = defs.filter("name_at is not null").select(*FILE, F.lit(None).cast("string").alias("name"), F.col("name_at").alias("p"))
    # grouped where they are: calls at the places of names go
    both = c.unionByName(named).groupBy(*FILE, "p").agg(F.collect_list("name").alias("names"), F.bool_or(F.col("name").isNull()).alias("named"))
    c = _probed(structure, both.filter(~F.col("named")).select(*FILE, "p", F.explode("names").alias("name")))
    null = lambda kind: F.lit(None).cast(kind)
    return c.select(*FILE, F.lit("call").alias("tag"), "name", null("string").alias("kind"), null("int").alias("start_line"), null("int").alias("end_line"),
                    (F.col("p") - F.col("bol")).cast("int").alias("col"), null("string").alias("body"), null("string").alias("signature"),
                    F.col("line").cast("int").alias("line"), null("string").alias("error"))


AT_ONCE, AT_MOST = 2 ** 18, 2 ** 22         # bytes of texts of a task where there are few tasks, and in any case


def partitions_for(size: int, most: int) -> int:
    """Tasks that ``size`` bytes of texts are dealt to: at most ``most``, unless a task would get more than ``AT_MOST``; two at least (one is not taken for dealt by a key)."""
    return max(2, min(-(-size // AT_ONCE), max(most, -(-size // AT_MOST))))


def _key(c: str) -> Column:
    """A key that is not null, for joins that know how it is dealt; ``_value`` gives the value back."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c)


def _value(c: str) -> Column:
    return F.when(F.col(c) != "", F.substring(c, 2, 2 ** 31 - 1)).alias(c)


def extract_braced(files: dict[str, DataFrame], sizes: dict[str, int] | None = None) -> DataFrame:
    """Symbol and call rows (``code.EXTRACT_SCHEMA``) of ``files(repo_id, path, content)`` by the rules they follow (``js``, ``go``).

    ``sizes`` are the bytes of each one's contents, counted here if they are not given.
    """
    if sizes is None:
        sizes = {lang: own.select(F.sum(F.octet_length("content")).alias("n")).first().n or 0 for lang, own in files.items()}
    out, hashed = None, F.xxhash64(*NAMED).alias("file")
    for lang, own in files.items():
        n = partitions_for(sizes[lang], int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        own = own.select(*map(_key, NAMED), "content").select(hashed, "*").repartition(n, *FILE)
        found = cut_dealt(marks(own, lang))
        structure = cut_dealt(_structure(found))
        rows = cut_dealt(found.filter("kind <> 'mark'"))        # the few that are read again and again
        defs = cut_dealt({"js": _js, "go": _go}[lang](rows, structure))
        both = _ended(defs, structure, own).unionByName(_calls(rows.withColumn("rules", F.lit(lang)), structure, defs))
        out = both if out is None else out.unionByName(both)
    return out.select(*map(_value, NAMED), *[c for c in out.columns if c not in FILE])
