"""The pipeline against a brute-force version of its stages, on the smallest tables."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline as C
from packtables.llm import bytebpe, langid, secretscan
from packtables.session import read_table
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.001"


def brute(spark, rows, items):
    """(doc_id, text) rows through all stages, one document at a time."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    labels = [langid.label([t or ""], model) for _, t, _ in rows]
    rows = [(d, t) for (d, t, _), (lang, score, _) in zip(rows, labels) if lang[0] != "und" and score[0] >= C.LEAST_LANGUAGE_SCORE]
    comp = {}
    for d, _, c in brute_components(rows):
        comp.setdefault(c, []).append(d)
    rows = [r for r in rows if r[0] in {min(v) for v in comp.values()}]
    bad = {r[0] for r in brute_contamination(rows, items) if r[-1]}
    rows = [r for r in rows if r[0] not in bad]
    names = secretscan.identifiers(spark.createDataFrame(rows, "doc_id long, text string"))
    z = secretscan.compressor(names)
    path, pattern = bytebpe.defaults()
    with open(path, "rb") as f:
        core = bytebpe.ByteBpe(f.read(), pattern).core
    out = []
    for d, t in rows:
        clean = secretscan.redacted(t, secretscan.spans_of(t, z)[1])
        ids = core.encode_ordinary(clean)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest(), ids))
    return sorted(out)


@pytest.fixture(scope="module")
def ran(spark):
    return sorted(tuple(r) for r in C.run(spark, SF).collect())


def test_run_matches_brute_force(spark, ran):
    rows = [tuple(r) for r in read_table(spark, SF, "documents").select("doc_id", "text", "lang").collect()]
    items = [tuple(r) for r in read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert ran == brute(spark, rows, items)
    assert 0 < len(ran) < len(rows)


def test_stages_keep_columns_and_handle_odd_rows(spark):
    rows = [(1, "the house that he built and the dog that he had " * 5, "en", "s", 9, "x"),
            (1, "the house that he built and the dog that he had " * 5, "en", "s", 9, "x"),
            (2, None, None, None, None, None), (3, "", "en", "s", 0, "x"), (None, "a token = \"q7Zx9LmP2vTb8RkW4nYc6HdJ\" the house", "en", "s", 50, "x"),
            (5, "den hund hat das haus gebaut und nicht verkauft " * 4, "de", "s", 1, "x"), (6, "1234 5678", None, "s", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, df, SF)
        if k < len(C.STAGES) - 1:
            assert out.columns == df.columns
            assert {f.name: f.dataType for f in out.schema} == {f.name: f.dataType for f in df.schema}
        out.collect()
        assert stage(spark, df.limit(0), SF).collect() == []
