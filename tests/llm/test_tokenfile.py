"""Token files against the tokenizer library on whole texts, and selective reads."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from packtables.llm import tokenfile as T


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def random_text(rng, n):
    chars = ["a", "B", "é", "É", "́", "İ", "Σ", "ς", "K", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "1", "2", ".", "!",
             "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "漢", "🙂", "ﬁ", "_", "the ", "ing ", "\x00", "‍"]
    return "".join(rng.choice(chars) for _ in range(n))


def test_pieces_equal_whole_texts(model, whole):
    rng = random.Random(1)
    texts = [random_text(rng, n) for n in [0, 1, 2, 5, 30, 200] for _ in range(150)] + [None, "x" * 3000, "a" * 200 + " b " + "c" * 130]
    enc = T.Pieces(model)
    want = [whole.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert enc.encode(texts, 2).to_pylist() == want
    assert enc.encode(texts, 2).to_pylist() == want       # from memory
    assert enc.encode(texts[::-1], None).to_pylist() == [w[:-1] for w in want[::-1]]
    assert enc.encode([], 2).to_pylist() == []


def test_memory_is_bounded(model, whole, monkeypatch):
    monkeypatch.setattr(T, "MEMO", 20)
    enc = T.Pieces(model)
    texts = [" ".join(f"w{i * j}" for i in range(15)) + " " + "z" * 300 for j in range(20)]
    for t in texts:
        assert enc.encode([t], None).to_pylist() == [whole.encode(t, add_special_tokens=False).ids]
        assert len(enc.memo) <= 20 and not any(len(k) > T.MEMO_CHARS for k in enc.memo)


ROWS = [(5, "Five words are in here", "a"), (1, "One", "b"), (3, None, "c"), (9, "", "d"), (7, "twice", "e"), (7, "twice", "e"),
        (None, "no id", "f"), (2, "long " * 50_000, "g")]


def test_round_trip(spark, whole):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, start string").repartition(3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in T.token_file_round_trip(df).collect())
    at, want = 0, []
    for d, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert T.token_file_round_trip(df.limit(0)).collect() == []


def test_files_are_ordered_encoded_and_selective(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = [(i, f"text number {i} of many " * 30) for i in range(4000)]
    path = str(tmp_path / "tokens")
    T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path)
    last = -1
    for p in sorted((tmp_path / "tokens").glob("part-*")):
        f = pq.ParquetFile(p)
        ids = f.read(["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
        for c in range(f.metadata.num_columns if ids else 0):
            col = f.metadata.row_group(0).column(c)
            if col.path_in_schema.startswith("token_ids"):
                assert "RLE_DICTIONARY" in col.encodings
            else:
                assert "DELTA_BINARY_PACKED" in col.encodings and "RLE_DICTIONARY" not in col.encodings
            assert col.has_offset_index and col.has_column_index
    some = T.read_tokens(spark, path).filter("doc_id between 100 and 102").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in plan and "GreaterThanOrEqual(doc_id,100)" in plan
    assert [r.doc_id for r in some.orderBy("doc_id").collect()] == [100, 101, 102]
