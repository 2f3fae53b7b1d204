"""Chat request bodies (S3) and enrichment of message lists."""

import json

from packtables.functions.signals import prompt_from_messages
from packtables.plans.packs import enrich_messages
from packtables.sources.store import requests_from_bodies


def _bodies(spark, docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "request_id long, body string")


def test_string_and_multipart_content(spark):
    docs = [{"messages": [{"role": "system", "content": "be brief"},
                          {"role": "user", "content": [{"type": "text", "text": "a"},
                                                       {"type": "image_url", "image_url": {"url": "x"}},
                                                       {"type": "text", "text": "b"}]},
                          {"role": "user", "content": "c"}], "stream": False},
            {"messages": []},
            {"messages": [{"role": "assistant", "content": "only"}]}]
    r = requests_from_bodies(_bodies(spark, docs))
    got = {x.request_id: x.p for x in r.select("request_id", prompt_from_messages("messages").alias("p")).collect()}
    assert got == {0: "a\nb\nc", 1: "", 2: ""}


def _packs(spark, rows):
    return spark.createDataFrame(rows, "request_id long, xml string, n_entries long")


def test_enrich_messages(spark):
    docs = [{"messages": [{"role": "user", "content": "q"}]},                                   # no system turn
            {"messages": [{"role": "system", "content": "sys"}, {"role": "user", "content": "q"}]},
            {"messages": [{"role": "system", "content": [{"type": "text", "text": "sys"}]},
                          {"role": "user", "content": "q"}]},                                   # multi-part system
            {"messages": [{"role": "user", "content": "q"}]},                                   # empty pack
            {"messages": [{"role": "user", "content": "q"}]}]                                   # no pack at all
    req = requests_from_bodies(_bodies(spark, docs))
    packs = _packs(spark, [(0, "<P0/>", 1), (1, "<P1/>", 2), (2, "<P2/>", 1), (3, "<E/>", 0)])
    out = {r.request_id: r.messages for r in enrich_messages(req, packs).collect()}
    m0 = out[0]
    assert (m0[0].role, m0[0].content) == ("system", "<P0/>") and m0[1].content == "q"
    assert out[1][0].content == "<P1/>\n\nsys" and len(out[1]) == 2
    assert [p.text for p in out[2][0].parts] == ["<P2/>", "sys"]
    assert [(m.role, m.content) for m in out[3]] == [("user", "q")]
    assert [(m.role, m.content) for m in out[4]] == [("user", "q")]


def test_read_requests_json_file(spark, tmp_path):
    from packtables.sources.store import read_requests_json

    docs = [{"request_id": 7, "ts": "2024-01-01T00:00:00Z",
             "body": {"messages": [{"role": "user", "content": [{"type": "text", "text": "fix FooBar"}]}],
                      "stream": True}}]
    p = tmp_path / "req.jsonl"
    p.write_text("\n".join(json.dumps(d) for d in docs))
    r = read_requests_json(spark, str(p))
    row = r.select("request_id", prompt_from_messages("messages").alias("p")).first()
    assert (row.request_id, row.p) == (7, "fix FooBar")
