"""Hand-written rows for the request signals."""

from pyspark.sql import functions as F

from packtables.functions import signals as sig


def _signals(spark, prompts):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "request_id long, prompt string")
    return {r.request_id: r for r in sig.with_signals(df).collect()}


def test_keyword_inside_words(spark):
    r = _signals(spark, ["prefix the address", "the latest one", "remove it"])
    assert r[0].task_type == "debug"          # "fix" inside "prefix" comes before "add"
    assert r[1].task_type == "test"           # "latest"
    assert r[2].task_type == "refactor"       # "move" inside "remove"


def test_symbols_follow_the_code_not_the_readme(spark):
    r = _signals(spark, ["explain the OrderService.createOrder function"])[0]
    assert r.symbols == ["OrderService.createOrder", "createOrder"]
    assert r.task_type == "add_feature"       # "create" inside createOrder


def test_unicode_word_boundaries(spark):
    r = _signals(spark, ["Füß Éautre naïveCase API Foo."])[0]
    assert r.symbols == ["Foo"]


def test_file_mentions_keep_quirks(spark):
    r = _signals(spark, ["see and/or src/a.py. x"])[0]
    assert r.file_mentions == ["and/or", "src/a.py."]


def test_empty_prompt(spark):
    r = _signals(spark, [""])[0]
    assert (r.task_type, r.symbols, r.file_mentions, r.scope_hint) == ("other", [], [], "")


def test_prompt_from_turns_user_only(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "x"),
         (2, 0, "assistant", "only")], "conv_id long, turn long, role string, text string")
    out = {r.request_id: r.prompt for r in sig.prompts_from_turns(turns).collect()}
    assert out == {1: "a\nb", 2: ""}


def test_prompt_from_messages_text_parts_only(spark):
    msgs = [[{"role": "user", "content": None,
              "parts": [{"type": "text", "text": "hi"}, {"type": "image_url", "text": None},
                        {"type": "text", "text": "there"}]},
             {"role": "assistant", "content": "no", "parts": None},
             {"role": "user", "content": "last", "parts": None}]]
    df = spark.createDataFrame([(m,) for m in msgs],
                               "messages array<struct<role:string,content:string,"
                               "parts:array<struct<type:string,text:string>>>>")
    assert df.select(sig.prompt_from_messages("messages").alias("p")).first().p == "hi\nthere\nlast"


def test_fingerprint_is_order_free(spark):
    a = _signals(spark, ["FooBar and BazQux"])[0]
    b = _signals(spark, ["FooBar and BazQux"])[0]
    assert a.fingerprint == b.fingerprint and len(a.fingerprint) == 32


def test_word_boundary_option(spark):
    df = spark.createDataFrame([(0, "prefix the address")], "request_id long, prompt string")
    r = sig.with_signals(df, word_boundaries=True).first()
    assert r.task_type == "other"
    assert df.select(sig.task_type(F.col("prompt"), True).alias("t")).first().t == "other"


def test_quirk_options(spark):
    df = spark.createDataFrame([(0, "Explain The FooBar in src/a.py.")], "request_id long, prompt string")
    plain = sig.with_signals(df).first()
    assert plain.symbols == ["Explain", "FooBar", "The"] and plain.file_mentions == ["src/a.py."]
    opt = sig.with_signals(df, symbol_stop_words=("Explain", "The"), trim_file_dots=True).first()
    assert opt.symbols == ["FooBar"] and opt.file_mentions == ["src/a.py"]
