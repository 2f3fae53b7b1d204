"""Secret scan: fixed patterns, then novelty under a dictionary-primed zstandard.

Base spans (leftmost, not overlapping, per kind; a failing match is dropped and
its characters aren't tried again):

* ``assign``: a sensitive name, ``:`` or ``=``, and a value of at least 6 characters;
* ``access``: ``AKIA`` and capitals or digits, 20 characters at least;
* ``hex``: a run of lower-case hex digits, 24 at least.

Novel spans: a candidate is a run of key characters, ``LEAST`` long at least and
with both a letter and a digit, or of letters whose case or whose lack of vowels
no words have. Words and numbers between its separators (``/``, ``-``, ``_`` and
so on) are set apart: ``LEAST`` - 4 characters of a candidate, or half of it,
must lie outside them, so addresses, paths and titles are none. It begins within ``REACH`` characters after a sensitive word, or
ends within ``REACH`` before one; a reported span carries the reach on from its
own end, so the segments and lines of a key follow each other. A shorter run
between a reported one and ``-----END`` is the last line of its key. A candidate is compressed behind its surroundings by a compressor
primed with the corpus's most frequent identifiers; the bytes it adds, over its
length, are its novelty. Text the surroundings or the dictionary hold adds
next to nothing; a random key cannot be shortened, so ``NOVEL`` bytes a
character or more report it. Candidates that overlap a base span are left to it.
Copies of a candidate that are in a base span, or in reach on the same side of a
sensitive word, are cut out of its surroundings; a copy elsewhere stays there.

The dictionary is counted over the distinct texts of all documents; its size is
bounded (``DICTIONARY`` most frequent identifiers, ties by name). A name that
could be a key itself, as it stands or padded, is never in it.

Defined results: a null text counts as empty and has no span; repeated rows are
scanned one by one; an empty table gives an empty table; extra columns are
ignored by ``scan`` and kept by ``redact``. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packtables.llm.common import slices, texts_of, trimmed

KINDS = ("assign", "access", "hex", "novel")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")         # maximal runs, as [0-9a-f]+ gives them

SENSITIVE = ("password", "passwd", "secret", "token", "api key", "credential", "authorization", "bearer", "private key", "access key",
             "client key", "signing key", "license key", "session id", "passphrase")
HINTS = ("passw", "secret", "token", "key", "credential", "authorization", "bearer", "session", "passphrase")   # each word has one
CONTEXT = re.compile("|".join(x.replace(" ", "[ _-]?") for x in SENSITIVE), re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_][A-Za-z0-9_]{3,63}(?=\x20?[=:(])")       # no part of a longer run
RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")         # the characters of a candidate
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SEGMENT = re.compile(r"[A-Za-z0-9]+")
WORDLIKE = re.compile(r"[0-9]{1,10}|[0-9]{0,4}(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}")       # a word or a number, or both
LAST_LINE = re.compile(r"(?:\s|\\[nr])+-----END")
REACH, LEAST, NOVEL, AROUND = 64, 16, 0.5, 256
DICTIONARY = 2_048
MARK = "[SECRET]"
SLICE_CHARS = 4_000_000
Judge = Callable[[int, int], bool]


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end). ``low`` is the lower-case text."""
    out = []
    if any(x in low for x in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def compressor(identifiers: list[str]) -> zstandard.ZstdCompressor:
    """Primed with the identifiers, the most frequent last (nearest)."""
    options = {"level": 3, "write_content_size": False, "write_dict_id": False}
    content = "\n".join(reversed(identifiers)).encode()
    if len(content) < 8:
        return zstandard.ZstdCompressor(**options)
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options)


def without(text: str, lo: int, hi: int, hidden: list[tuple[int, int]]) -> str:
    """``text[lo:hi]`` without the hidden spans (sorted)."""
    out, at = [], lo
    for x, y in hidden:
        if at < y and x < hi:
            out.append(text[at:max(at, x)])
            at = y
    return "".join([*out, text[at:hi]])


def novelty(z: zstandard.ZstdCompressor, text: str, a: int, b: int, hidden: list[tuple[int, int]] = ()) -> float:
    """Marginal compressed bytes of ``text[a:b]`` behind its surroundings (without the hidden spans), per byte."""
    around = (without(text, max(0, a - AROUND), a, hidden) + "\n" + without(text, b, b + AROUND, hidden) + "\n").encode()
    own = text[a:b].encode()
    return (len(z.compress(around + own)) - len(z.compress(around))) / len(own)


def irregular(s: str) -> bool:
    """Whether a run without digits changes case, or lacks vowels, as words and joined words don't."""
    letters = sum(map(str.isalpha, s))
    vowels = sum(x in "aeiouAEIOU" for x in s)
    changes = sum(len(PART.findall(x)) - 1 for x in re.split(r"[^A-Za-z]+", s) if x)
    return vowels < 0.15 * letters or (changes >= letters / 4 and vowels < 0.35 * letters)


def odd(s: str) -> int:
    """How many characters of a run are neither separators nor in segments like words or numbers."""
    return sum(len(x) for x in SEGMENT.findall(s) if not WORDLIKE.fullmatch(x) or irregular(x.strip("0123456789") or "a"))


def keylike(s: str, least: int = LEAST) -> bool:
    """Whether a run of key characters is measured at all."""
    if len(s) < least or not any(map(str.isalpha, s)) or not (any(map(str.isdigit, s)) or irregular(s)):
        return False
    # padding and a few separators are part of a key: what counts is that words do not fill it
    return odd(s) >= least - 4 or (odd(s) > 0 and 2 * odd(s) >= len(s))


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The characters that the sorted spans cover, as spans that don't touch each other."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def meets(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether ``[a, b)`` overlaps one of the sorted, separate spans."""
    i = bisect_left(spans, b, key=lambda x: x[0])
    return i > 0 and spans[i - 1][1] > a


def copies(text: str, a: int, b: int, *cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Other copies of ``text[a:b]``, padding aside, in its surroundings that overlap one of the ``cuts``."""
    s = text[a:b].strip("=-")
    lo, hi = max(0, a - AROUND - len(s)), b + AROUND + len(s)
    out, at = [], text.find(s, lo, hi)
    while at >= 0:
        end = at + len(s)
        if (end <= a or b <= at) and any(meets(x, at, end) for x in cuts):
            out.append((at, end))
        at = text.find(s, end, hi)
    return out


def before(text: str, at: int, floor: int) -> tuple[int, int]:
    """The last run of key characters in ``text[floor:at]``; empty, at ``floor``, if there is none."""
    while at > floor and text[at - 1] not in RUN:
        at -= 1
    a = at
    while a > floor and text[a - 1] in RUN:
        a -= 1
    return a, at


def ahead(text: str, words: list[tuple[int, int]], known: list[tuple[int, int]], judge: Judge) -> list[tuple[int, int]]:
    """Runs in reach after a word that are judged keys."""
    out, done, told = [], 0, -1         # told: the end of the last reported span
    for _, word in words:
        limit = word + REACH
        for m in CANDIDATE.finditer(text, max(done, word)):
            a, b = m.span()
            if a > limit:
                break
            done = b
            if not meets(known, a, b):
                last = b - a < LEAST and told >= 0 and not text[told:a].strip(" \t\r\n\\\"'+") and LAST_LINE.match(text, b)
                if not last and not (keylike(m.group()) and judge(a, b)):
                    continue
                out.append((a, b))
            told = b
            limit = max(limit, b + REACH)
    return out


def back(text: str, words: list[tuple[int, int]], known: list[tuple[int, int]], judge: Judge) -> list[tuple[int, int]]:
    """Runs in reach before a word that are judged keys; one that touches the word is a part of its name."""
    out, floor = [], 0
    for word, end in words:
        at, limit, found = word, word - REACH, []
        while True:
            a, b = before(text, at, floor)
            if a == b or b < limit:
                break
            at = a
            if b == word:
                continue
            if not meets(known, a, b):
                if not (keylike(text[a:b]) and judge(a, b)):
                    continue
                found.append((a, b))
            limit = min(limit, a - REACH)
        out += reversed(found)
        floor = end
    return out


def novel_spans(text: str, low: str, base: list[tuple[int, int, int]], z: zstandard.ZstdCompressor) -> list[tuple[int, int, int]]:
    if not any(x in low for x in HINTS):
        return []
    words = [m.span() for m in CONTEXT.finditer(text)]
    known, out = merged(base), set()
    for side in (ahead, back):
        near = side(text, words, known, lambda a, b: True)
        out |= set(side(text, words, known, lambda a, b: novelty(z, text, a, b, copies(text, a, b, near, known)) >= NOVEL))  # noqa: B023
    return [(a, 3, b) for a, b in sorted(out)]


def spans_of(text: str, z: zstandard.ZstdCompressor) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    low = text.lower()
    base = base_spans(text, low)
    return base, sorted(base + novel_spans(text, low, base, z))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def names_of(text: str) -> set[str]:
    """Names before ``=``, ``:`` or an opening bracket that aren't keys, with up to two ``=`` of padding or without."""
    return {x for x in IDENTIFIER.findall(text) if not keylike(x, LEAST - 2)}


def identifiers(docs: DataFrame, top: int = DICTIONARY) -> list[str]:
    """The identifiers that most distinct texts hold, over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, keys, seen = [], [], set()
            for t, key in zip(texts_of(b), b.column(1).to_pylist()):
                if t and key not in seen and ("=" in t or ":" in t or "(" in t):
                    seen.add(key)
                    found = names_of(t)
                    names += found
                    keys += [key] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.int64())], ["name", "key"])

    pairs = docs.select("text", F.xxhash64("text").alias("key")).mapInArrow(run, "name string, key long").distinct()
    counts = pairs.groupBy("name").agg(F.count("*").alias("n"))
    return [r.name for r in counts.orderBy(F.desc("n"), "name").limit(top).collect()]


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of each document."""
    names = identifiers(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = compressor(names)
        for b in batches:
            n, digest, spans = [[], [], []], [], []
            for t in texts_of(b):
                base, every = spans_of(t or "", z)
                for k in range(3):
                    n[k].append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(digest, pa.string()),
                                              pa.array(spans, pa.string())],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(trimmed(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = MARK) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b          # a span that overlaps the one before is covered by its mark
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of a text replaced by a mark, and ``n_chars``, where there is such a column, set anew
    for the rows that changed."""
    names = identifiers(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = compressor(names)
        for b in batches:
            at, k = b.schema.get_field_index("text"), b.schema.get_field_index("n_chars")
            for part, _ in slices(b, SLICE_CHARS):
                old = part.column(at).to_pylist()
                new = [t and redacted(t, spans_of(t, z)[1]) for t in old]
                cols = list(part.columns)
                cols[at] = pa.array(new, b.schema.field(at).type)
                if k >= 0 and pa.types.is_integer(b.schema.field(k).type):
                    sizes = [n if x is y or x == y else len(y) for n, x, y in zip(part.column(k).to_pylist(), old, new)]
                    cols[k] = pa.array(sizes, b.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(trimmed(run), docs.schema)
