"""Scalar text helpers used by strategies and packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker lines and formats the pack text uses.
TRUNCATED_MARKER = "\n  // ... truncated"
TRIMMED_MARKER = "\n  // ... trimmed"
BLAST_HEADER = "// [blast radius - imports {seed}]"
BLAST_FOOTER = "// ..."


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines_of(text) -> Column:
    return F.split(_col(text), "\n", -1)


def truncate_lines(body, max_lines: int) -> Column:
    """Keep the first ``max_lines`` lines and add a marker line."""
    b = _col(body)
    parts = lines_of(b)
    return (F.when(b.isNull() | (b == ""), b)
            .when(F.size(parts) > max_lines,
                  F.concat(F.array_join(F.slice(parts, 1, max_lines), "\n"), F.lit(TRUNCATED_MARKER)))
            .otherwise(b))


def head_summary(content, seed) -> Column:
    """P10: first three lines between a header naming the seed and an ellipsis."""
    head = F.array_join(F.slice(lines_of(content), 1, 3), "\n")
    return F.concat(F.lit("// [blast radius - imports "), _col(seed), F.lit("]\n"), head, F.lit("\n" + BLAST_FOOTER))


def chunk_text(body, max_chars: int = 2000) -> Column:
    """First ``max_chars`` code points of a body."""
    return F.substring(_col(body), 1, max_chars)


def similarity(distance) -> Column:
    """score = 1 / (1 + distance)."""
    return F.lit(1.0) / (F.lit(1.0) + _col(distance))


def short_hash(h) -> Column:
    """Seven-character hash."""
    return F.substring(_col(h), 1, 7)


def short_message(message, width: int = 80) -> Column:
    """First line of the stripped message, cut at ``width``."""
    stripped = F.regexp_replace(_col(message), r"(?U)^\s+|\s+$", "")
    return F.substring(F.substring_index(stripped, "\n", 1), 1, width)


def relative_age(committed_at, as_of) -> Column:
    """P14: 'N days ago' from one day on; 'N hours ago' above 3600 s; else
    'N minutes ago'. Commits in the future count as 0 minutes (fixes Q19)."""
    micros = F.unix_micros(_col(as_of).cast("timestamp")) - F.unix_micros(_col(committed_at).cast("timestamp"))
    secs = F.greatest(F.floor(micros / 1_000_000), F.lit(0)).cast("long")
    days = F.floor(secs / 86400).cast("long")
    rem = secs - days * 86400
    return (F.when(days > 0, F.concat(days.cast("string"), F.lit(" days ago")))
            .when(rem > 3600, F.concat(F.floor(rem / 3600).cast("long").cast("string"), F.lit(" hours ago")))
            .otherwise(F.concat(F.floor(rem / 60).cast("long").cast("string"), F.lit(" minutes ago"))))


def xml_escape(text) -> Column:
    """Escape & < > and, for attribute values, the double quote (fixes Q12)."""
    t = F.replace(_col(text), F.lit("&"), F.lit("&amp;"))
    t = F.replace(t, F.lit("<"), F.lit("&lt;"))
    t = F.replace(t, F.lit(">"), F.lit("&gt;"))
    return F.replace(t, F.lit('"'), F.lit("&quot;"))


def cdata(text) -> Column:
    """CDATA section; a ']]>' inside the text is split across two sections."""
    body = F.replace(F.coalesce(_col(text), F.lit("")), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit("<![CDATA["), body, F.lit("]]>"))


def score_text(score) -> Column:
    """Score with two decimals."""
    return F.format_string("%.2f", _col(score))
