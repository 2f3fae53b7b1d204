"""Token ids as Parquet list columns that allow selective reads.

File format, one file for each range of ``doc_id``, rows in ascending order:

* ``doc_id``, ``part`` (number of the file), ``local_start`` (tokens of the file before the row) and
  ``n_tokens``: version 2 pages, no dictionary, so sorted ids and starts become delta-packed;
* ``token_ids``: list of int32 with a dictionary, so an id takes as many bits as the file's vocabulary needs;
* row groups of ``ROW_GROUP`` bytes and pages of ``PAGE_ROWS`` rows at most, with Parquet's page index, so that a
  read of some ids or of the metadata alone touches few pages.

``local_start`` plus the sum of the files before (one row for each file) gives a document's place in the corpus.

A text is encoded by the tokenizer library in pieces between ASCII white space,
each distinct piece once as long as a bounded memory holds it. That equals the
encoding of the whole text where the tokenizer splits at white space and drops
it, as ``word_bpe_49k.json`` does: its normaliser never composes characters
across a space, and no match of its split pattern holds white space.

Defined results: a null text counts as empty and has the end id alone; null ids
come first; rows that share an id are ordered by a hash of their text; repeated
rows each have their own place; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packtables.llm.bytebpe import id_rows
from packtables.llm.common import shared_path, slices, trimmed

END_ID = 2
ROW_GROUP = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1_000
MEMO = 800_000         # distinct pieces kept by a worker
MEMO_CHARS = 64        # longer pieces aren't kept
SLICE_CHARS = 8_000_000
OUTER = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"     # ASCII punctuation but '<|>
PLAIN = chr(0x250)       # no combining marks below
STOP = r"([a-z0-9])([.,])([ \n])"

WRITE = {
    "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.enable.dictionary": "true",
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "local_start", "n_tokens")},
    "compression": "snappy",
}


class Pieces:
    """Encodes texts by pieces between ASCII white space, each distinct piece of a slice once, known ones from memory.

    Some steps make more pieces alike or cheaper; all leave the ids as they are:

    * a text of Latin-1 characters without ``<|`` (special tokens) is lower-cased, as the normaliser would, which has
      nothing to compose there;
    * a full stop or comma between a letter or digit and white space becomes a piece, as the split pattern has it;
    * a piece that isn't known is parted into ASCII punctuation, core and ASCII punctuation if the core begins and ends
      with a letter or digit below ``PLAIN`` and the punctuation holds none of ``'<|>`` (contractions, special tokens):
      the split pattern parts there, and nothing is composed across;
    * words of lower-case letters below ``PLAIN`` go to the same model without the normaliser, which would not change
      them, split at spaces, as the pattern would.
    """

    def __init__(self, model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # Spark's tasks already use all cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.core = Tokenizer.from_str(model.decode("utf-8"))
        self.words = Tokenizer.from_str(model.decode("utf-8"))
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.core.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def lowered(text: str | None) -> str:
        if not text or "<|" in text:
            return text or ""
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    @staticmethod
    def parted(piece: str) -> tuple[str, ...]:
        core = piece.strip(OUTER)
        if len(core) == len(piece) or not core or not (_plain(core[0]) and _plain(core[-1])) or "<|" in piece:
            return (piece,)
        at = piece.index(core)
        return tuple(x for x in (piece[:at], core, piece[at + len(core):]) if x)

    def learn(self, parts: set[str]) -> dict[str, bytes]:
        """Asks for the ids of parts; plain words are joined by spaces, each ends with a token that ends a word."""
        found: dict[str, bytes] = {}
        plain = [p for p in parts if p.isalpha() and p.islower() and (p.isascii() or max(p) < PLAIN)]
        for i in range(0, len(plain), 100):
            block = plain[i:i + 100]
            ids = np.array(self.words.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, "<u4")
            at = np.append(0, np.flatnonzero(self.ends_word[ids]) + 1)
            assert len(at) == len(block) + 1 and at[-1] == len(ids)
            raw, at = ids.tobytes(), (4 * at).tolist()
            found.update(zip(block, [raw[a:b] for a, b in zip(at, at[1:])]))
        rest = list(parts.difference(plain))
        for p, e in zip(rest, self.core.encode_batch_fast(rest, add_special_tokens=False)):
            found[p] = np.array(e.ids, "<u4").tobytes()
        return found

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of some distinct pieces, as little-endian bytes."""
        out = list(map(self.memo.get, pieces))
        new = [p for p, ids in zip(pieces, out) if ids is None]
        if new:
            split = {p: self.parted(p) for p in new if not p.isalpha()}
            parts = {x for xs in split.values() for x in xs}.union(p for p in new if p not in split)
            found = self.learn(parts.difference(self.memo))
            look = lambda x: found[x] if x in found else self.memo[x]
            for p, xs in split.items():
                if len(xs) > 1:
                    found[p] = b"".join(map(look, xs))
            out = [found[p] if ids is None else ids for p, ids in zip(pieces, out)]
            if len(self.memo) + len(found) > MEMO:
                self.memo.clear()
            self.memo.update(found if len(max(new, key=len)) <= MEMO_CHARS else
                             {p: ids for p, ids in found.items() if len(p) <= MEMO_CHARS})      # long pieces aren't kept
        return out

    def encode(self, texts: Sequence[str | None], end_id: int | None) -> pa.ListArray:
        """Ids of each text, the end id appended. What is held grows with the texts given."""
        low = pa.array(list(map(self.lowered, texts)), pa.string())
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(low, STOP, r"\1 \2\3"))
        coded = words.flatten().dictionary_encode()
        ids = self.ids_of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        which = coded.indices.to_numpy(zero_copy_only=False)
        offsets = words.offsets.to_numpy(zero_copy_only=False)
        n = size[which]
        if end_id is not None:
            n[offsets[1:] - 1] += 1           # each text has a last piece, if an empty one
        ends = np.append(0, np.cumsum(n, dtype=np.int64))
        assert ends[-1] < 2 ** 31, "a list column's offsets have 32 bits"
        ends = ends.astype(np.int32)
        source = np.repeat((np.cumsum(size, dtype=np.int32) - size)[which] - ends[:-1], n)
        source += np.arange(ends[-1], dtype=np.int32)
        values = np.frombuffer(b"".join(ids) + bytes(4), "<i4")[source]
        if end_id is not None:
            values[ends[offsets[1:]] - 1] = end_id
        return pa.ListArray.from_arrays(pa.array(ends[offsets]), pa.array(values))


def _plain(c: str) -> bool:
    return c < PLAIN and (c.isalpha() or "0" <= c <= "9") and c != "\u0130"       # its lower case ends with a mark


@functools.lru_cache(maxsize=2)
def pieces_encoder(model: bytes) -> Pieces:
    gc.set_threshold(500_000)       # many short-lived lists of pieces, and no cycles
    return Pieces(model)


def write_tokens(docs: DataFrame, path: str, model_path: str | None = None, end_id: int | None = END_ID) -> None:
    """Encodes ``docs`` and writes the token files below ``path``."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("word_bpe_49k.json")
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())      # the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place = pieces_encoder(model.value), TaskContext.get().partitionId(), 0
        for b in batches:
            for some, texts in slices(b, SLICE_CHARS):
                lists = encoder.encode(texts, end_id)
                starts = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(texts), part, np.int32)), pa.array(place + starts[:-1]),
                     pa.array(np.diff(starts)), lists], ["doc_id", "part", "local_start", "n_tokens", "token_ids"])
                place += int(starts[-1])

    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id"), F.xxhash64("text")]
    slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        trimmed(run), f"doc_id {kind}, part int, local_start long, n_tokens long, token_ids array<int>",
    ).write.options(**WRITE).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the token files with ``start``, the tokens of all documents before."""
    files = spark.read.parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))           # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "token_ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` as read from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, crc = [], []
            for x in id_rows(b, "token_ids"):
                n.append(len(x))
                crc.append(zlib.crc32(x.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    slim = tokens.select("doc_id", "start", "token_ids")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(trimmed(run), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame) -> DataFrame:
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return token_digests(read_tokens(docs.sparkSession, path))
