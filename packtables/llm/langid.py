"""Language identification of mixed-language text.

Words are runs of letters (and combining marks). A word's script, by code-point
ranges, narrows the languages that can score it: those that use the script in
the training texts. Its score for a language is the sum of log probabilities of
its letter trigrams (edges included). Viterbi over a document's words, with a
penalty for each change of language, labels spans; the document's language is
the one whose spans hold most letters.

The trigram tables are fitted on a bounded sample of the labelled documents:
about ``TRAIN_DOCS`` for each language, chosen by a hash of the id, whole
texts. They are hashed into ``BUCKETS`` cells, so the model is BUCKETS x languages
floats however large the corpus. Prediction reads the text and nothing else.

Defined results: ``und`` with score 0 for a null text or one without letters;
if no language was learned, every text is ``und``; a script that no learned
language uses is no evidence for any (a text of it has score 0); ties go to the
first language in sort order; repeated rows are labelled one by one; a null id
is never learned from and not held out; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packtables.llm.common import sample_hash, sample_threshold, slices, trimmed

TRAIN_DOCS = 2_000     # labelled documents of each language in the sample
BUCKETS = 1 << 16
PENALTY = 12.0         # log odds that a change of language has to win
SMOOTH = 0.5
SCRIPT_SHARE = 0.001   # a language uses a script that holds this share of its letters
SLICE_CHARS = 6_000_000        # characters of the texts whose words run side by side
BLOCK_CHARS = 500_000          # characters whose letters and trigrams are held at once (or one text)

#: First code point, last code point, script.
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0300, 0x036F, "mark"), (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"),
    (0x0700, 0x074F, "syriac"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"), (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"),
    (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"),
    (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1200, 0x137F, "ethiopic"), (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"), (0x3040, 0x309F, "hiragana"), (0x30A0, 0x30FF, "katakana"), (0x3130, 0x318F, "hangul"),
    (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0xF900, 0xFAFF, "han"),
    (0x20000, 0x323AF, "han"),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(s for _, _, s in SCRIPTS)]


@functools.lru_cache(maxsize=1)
def char_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower-case code point of a word character (0: none), whether it is a letter, its script."""
    n = 0x110000
    lower, letter, script = np.zeros(n, np.uint32), np.zeros(n, bool), np.zeros(n, np.uint8)
    for cp in range(n):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LM":
            low = chr(cp).lower()
            lower[cp] = ord(low) if len(low) == 1 else cp
            letter[cp] = kind == "L"
    for a, b, name in SCRIPTS:
        script[a:b + 1] = SCRIPT_NAMES.index(name)
    return lower, letter, script


@dataclass
class Words:
    """Words of some texts: text number, place in the text, letters, script; grams: bucket and word of each."""
    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    script: np.ndarray
    buckets: np.ndarray
    first_gram: np.ndarray
    letters: np.ndarray     # letters of each text


def words_of(texts: list[str]) -> Words:
    lower, letter, script = char_tables()
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    cp = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), "<u4")
    c = lower[cp].astype(np.uint64)
    at = np.flatnonzero(c)
    prev = c[np.maximum(at - 1, 0)] * (at > 0)
    after = c[np.minimum(at + 1, len(c) - 1)] * (at < len(c) - 1)
    mixed = (prev * np.uint64(0x9E3779B1) + c[at]) * np.uint64(0x85EBCA77) + after
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    first = np.flatnonzero(prev == 0)
    start = at[first]
    doc = np.searchsorted(begin, start, "right") - 1
    size = np.diff(np.append(first, len(at)))
    is_letter = np.concatenate([[0], np.cumsum(letter[cp])])
    return Words(doc, start - begin[doc], size, script[cp[start]],
                 (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), first,
                 is_letter[begin[1:] - 1] - is_letter[begin[:-1]])


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray        # BUCKETS x languages
    allowed: np.ndarray     # scripts x languages
    penalty: float = PENALTY


def held_out_column(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Trigram tables from the documents that are not held out and have a language."""
    known = docs.select("doc_id", "text", "lang").filter(
        "text is not null and lang is not null and doc_id is not null").filter(~held_out_column())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(sample_threshold(train_docs, sizes[k])).cast("long"))])
    sample = known.filter(sample_hash(F.col("doc_id"), F.lit("language sample")) <= share[F.col("lang")])
    place = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), BUCKETS), np.int64)
        scripts = np.zeros((len(langs), len(SCRIPT_NAMES)), np.int64)
        drawn = np.zeros((len(langs), 1), np.int64)
        for b in batches:
            texts, lang = b.column(0).to_pylist(), np.array([place[x] for x in b.column(1).to_pylist()])
            drawn[:, 0] += np.bincount(lang, minlength=len(langs))
            for i in range(0, len(texts), 256):
                w = words_of(texts[i:i + 256])
                of = lang[i:i + 256][w.doc]
                np.add.at(grams, (np.repeat(of, w.size), w.buckets), 1)
                np.add.at(scripts, (of, w.script), w.size)
        both = np.concatenate([grams, scripts, drawn], axis=1)
        of, cell = np.nonzero(both)
        if len(of):
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int64)), pa.array(cell.astype(np.int64)),
                                              pa.array(both[of, cell])], ["lang", "cell", "n"])

    # at most languages x (BUCKETS + scripts + 1) rows
    rows = sample.select("text", "lang").mapInArrow(count, "lang long, cell long, n long") \
        .groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((BUCKETS + len(SCRIPT_NAMES) + 1, len(langs)))
    both[rows["cell"], rows["lang"]] = rows["n"]
    unseen = [k for k, n in zip(langs, both[-1]) if not n]
    if unseen:
        raise RuntimeError(f"no document was drawn of {', '.join(unseen)}; raise train_docs")
    grams, scripts = both[:BUCKETS] + SMOOTH, both[BUCKETS:-1]
    allowed = scripts > SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), allowed)


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float) -> np.ndarray:
    """The best language of each word (rows of ``scores``, in order, of documents ``doc``).

    Documents run side by side, longest first: step t handles word t of every document that has one.
    """
    n_words = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-n_words, kind="stable")
    rank = np.empty(n_docs, np.int64)
    rank[order] = np.arange(n_docs)
    steps = int(n_words.max(initial=0))
    active = np.searchsorted(-n_words[order], -np.arange(steps), "left")     # documents with more than t words
    offset = np.concatenate([[0], np.cumsum(active)])
    t = np.arange(len(doc)) - (np.cumsum(n_words) - n_words)[doc]
    slot = offset[t] + rank[doc]
    by_step = np.empty_like(scores)
    by_step[slot] = scores
    stay = np.empty(scores.shape, bool)
    back = np.empty(len(doc), np.int16)
    best = np.zeros((n_docs, scores.shape[1]), np.float32)
    for i in range(steps):
        k, o = active[i], offset[i]
        m = best[:k]
        if i:
            top = m.argmax(axis=1)
            jump = m.max(axis=1)[:, None] - penalty
            back[o:o + k] = top
            np.greater_equal(m, jump, out=stay[o:o + k])
            np.maximum(m, jump, out=m)
        m += by_step[o:o + k]
    cur = best.argmax(axis=1)
    path = np.empty(len(doc), np.int16)
    rows = np.arange(n_docs)
    for i in range(steps - 1, -1, -1):
        k, o = active[i], offset[i]
        path[o:o + k] = cur[:k]
        if i:
            held = stay[o:o + k][rows[:k], cur[:k]]
            cur[:k] = np.where(held, cur[:k], back[o:o + k])
    return path[slot]


def word_scores(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each word (rows) in each language, 0 for the best; those its script rules out are far below.
    And whether any language uses the word's script; else the word is no evidence."""
    k = len(model.langs)
    scores = np.empty((len(w.doc), k), np.float32)
    step = max(1, 2_000_000 // k)
    edges = np.append(w.first_gram, len(w.buckets))
    i = 0
    while i < len(w.doc):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + step)) - 1)
        scores[i:j] = np.add.reduceat(model.logp[w.buckets[edges[i]:edges[j]]], edges[i:j] - edges[i], axis=0)
        i = j
    allowed = model.allowed[w.script]
    none = ~allowed.any(axis=1)
    scores -= scores.max(axis=1, keepdims=True, initial=-np.inf) if k else 0
    scores[none] = 0
    scores[~allowed & ~none[:, None]] -= 1e4
    return scores, ~none


def label(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, score and spans of each text."""
    n, k = len(texts), len(model.langs)
    blocks, i = [], 0
    while i < n and k:                               # blocks of texts, to bound the letters and trigrams held at once
        j, size = i + 1, len(texts[i])
        while j < n and size + len(texts[j]) <= BLOCK_CHARS:
            size += len(texts[j])
            j += 1
        w = words_of(texts[i:j])
        blocks.append((w.doc + i, w.start, w.size, w.letters, *word_scores(w, model)))
        i = j
    if not sum(len(b[0]) for b in blocks):
        return ["und"] * n, np.zeros(n), [[] for _ in texts]
    doc, start, size, n_letters, scores, known = (np.concatenate(x) for x in zip(*blocks))
    del blocks
    path = viterbi(scores, doc, n, model.penalty)
    letters = np.zeros((n, k))
    np.add.at(letters, (doc[known], path[known]), size[known])
    pick = letters.argmax(axis=1)
    own = path == pick[doc]
    total = np.zeros((n, k))
    np.add.at(total, doc[own], scores[own])
    total -= total.max(axis=1, keepdims=True)
    odds = np.exp(total)
    rows = np.arange(n)
    score = letters[rows, pick] / np.maximum(1, np.bincount(doc, size, n)) * (odds[rows, pick] / odds.sum(axis=1))
    some = n_letters > 0
    new = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(path, prepend=-1))
    last = np.append(new[1:], len(path)) - 1
    spans: list[list[dict]] = [[] for _ in texts]
    for a, b in zip(new, last):
        if some[d := doc[a]]:
            spans[d].append({"start": int(start[a]), "end": int(start[b] + size[b]), "lang": model.langs[path[a]]})
    return ([model.langs[p] if s else "und" for p, s in zip(pick, some)], np.where(some, score, 0.0), spans)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``spans`` (start, end, lang; code points) of each text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in slices(b, SLICE_CHARS):
                lang, score, spans = label(texts, shipped.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(spans, span)],
                                                 ["doc_id", "lang_pred", "score", "spans"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(trimmed(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, "
                                "spans array<struct<start:int,end:int,lang:string>>")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.25) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text has a language with at least that score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in slices(b, SLICE_CHARS):
                lang, score, _ = label(texts, shipped.value)
                keep = (np.array(lang, object) != "und") & (score >= least_score)
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(trimmed(run), docs.schema)
