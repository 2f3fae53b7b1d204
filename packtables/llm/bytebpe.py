"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is encoded by halves, recursively; a leaf of at most ``LEAF`` characters
goes to the tokenizer library. Two neighbours are joined by encoding a window
around their boundary again. The window grows until it starts and ends at a
*settled* position: one between a character that is no white space and a space
or line feed. No alternative of the split pattern reaches from a non-space
character into white space, and none looks further back than its own start, so

* the matches left of a settled position are the same in the left part alone
  and in the whole text, and
* those right of a settled position depend only on the text from there on.

Hence all tokens outside the window are final; where no settled position is
left, the window reaches the end of the part and takes it whole. Joining is
associative: any tree over the same text gives the ids of the whole text.
Decoding concatenates the bytes of halves up the tree.

Defined results: a null text counts as empty and has no ids; repeated rows are
encoded one by one; an empty table gives an empty table; extra columns are
ignored. Memory holds one Arrow batch (Spark bounds its bytes) and one text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from packtables.llm.common import slices, trimmed

LEAF = 2_048           # characters (encoding) or ids (decoding) of a leaf
SLICE_CHARS = 2_000_000     # characters of the texts whose ids are held at once (or one text)
WINDOW = 48            # characters on either side of a boundary, at first
SETTLED = re.compile(r"[\w!-~](?=[ \n])")      # ends at a settled position


class ByteBpe:
    """Ranks and split pattern, with the tree reductions over them."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in rank_file.splitlines() if line)}
        self.core = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def leaf(self, text: str) -> np.ndarray:
        return np.array(self.core.encode_ordinary(text), np.uint32)

    def encode(self, text: str, leaf: int = LEAF, window: int = WINDOW) -> np.ndarray:
        def tree(a: int, b: int) -> np.ndarray:
            if b - a <= leaf:
                return self.leaf(text[a:b])
            m = (a + b) // 2
            return self.join(text, a, m, b, tree(a, m), tree(m, b), window)
        return tree(0, len(text))

    def join(self, text: str, a: int, m: int, b: int, left: np.ndarray, right: np.ndarray,
             window: int = WINDOW) -> np.ndarray:
        """The ids of ``text[a:b]`` from those of ``text[a:m]`` and ``text[m:b]``."""
        p = q = None
        while p is None or q is None:
            lo, hi = max(a, m - window), min(b, m + window)
            if p is None:
                ends = [x.end() for x in SETTLED.finditer(text, lo, min(m + 1, b))]
                p = ends[-1] if ends else a if lo == a else None
            if q is None:
                x = SETTLED.search(text, max(a, m - 1), min(hi + 1, b))
                q = x.end() if x else b if hi == b else None
            window *= 4
        if p == q:
            return np.concatenate([left, right])
        keep = self.cut(left[::-1], len(text[p:m].encode()))
        skip = self.cut(right, len(text[m:q].encode()))
        return np.concatenate([left[:len(left) - keep], self.leaf(text[p:q]), right[skip:]])

    def cut(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many of the first ids make up ``n_bytes``."""
        if not n_bytes:
            return 0
        done = np.cumsum(self.lengths[ids[:n_bytes]])
        k = int(np.searchsorted(done, n_bytes))
        assert done[k] == n_bytes, "a settled position is a token boundary"
        return k + 1

    def decode(self, ids: np.ndarray, leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return self.core.decode_bytes(ids.tolist())
        m = len(ids) // 2
        return self.decode(ids[:m], leaf) + self.decode(ids[m:], leaf)


@functools.lru_cache(maxsize=4)
def tokenizer(rank_file: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def shipped(docs: DataFrame, path: str | None, pattern: str | None):
    """The rank file (its size is the vocabulary's) sent to the executors once, and the pattern."""
    default_path, default_pattern = defaults() if path is None or pattern is None else (path, pattern)
    with open(path or default_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read()), pattern or default_pattern


def list_batch(ids: pa.Array, rows: list[np.ndarray], name: str) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    values = pa.array(np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32))
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", name])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of each document."""
    ranks, pat = shipped(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks.value, pat)
        for b in batches:
            for part, texts in slices(b, SLICE_CHARS):
                yield list_batch(part.column(0), [bpe.encode(t) for t in texts], "ids")

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(trimmed(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def id_rows(batch: pa.RecordBatch, column: str = "ids") -> Iterator[np.ndarray]:
    lists = batch.column(batch.schema.get_field_index(column))
    values = lists.values.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy(zero_copy_only=False)
    for a, b in zip(offsets, offsets[1:]):
        yield values[a:b]


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id`` and the decoded ``bytes`` of each row of ``encode``'s result."""
    ranks, pat = shipped(encoded, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks.value, pat)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                data = pa.array([bpe.decode(x) for x in id_rows(part)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), data], ["doc_id", "bytes"])

    slim = encoded.select("doc_id", "ids")
    return slim.mapInArrow(trimmed(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes each document: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (and the ids).

    ``encode`` and ``decode`` in one pass, so that one worker a task holds the tokenizer.
    """
    ranks, pat = shipped(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks.value, pat)
        for b in batches:
            for part, texts in slices(b, SLICE_CHARS):
                rows = [bpe.encode(t) for t in texts]
                ids = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows]
                data = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in rows]
                cols = [part.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array(ids, pa.string()),
                        pa.array(data, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols, names = [*cols, list_batch(part.column(0), rows, "ids").column(1)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(trimmed(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_tokens long, "
                                         "ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
