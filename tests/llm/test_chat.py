import json

import pyarrow as pa

from treeline.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS prompt", "'y' AS number", "'z' AS type")
    return {r.conv_id: r for r in chat.format_chats(df).collect()}


def test_typed_parts_in_order(spark):
    parts = [{"type": "text", "text": "see"}, {"type": "image", "uri": "i.png", "units": 2}, {"type": "text", "text": "and"}, {"type": "document", "uri": "d.pdf", "units": 3}, {"type": "audio", "uri": "a.wav", "units": 10}]
    r = run(spark, [(1, 0, "user", json.dumps(parts)), (1, 1, "assistant", "fine"), (1, 2, "user", json.dumps([{"type": "image", "uri": "j.png"}]))])[1]
    assert r.prompt == "<|user|>\nsee<|image_1|>and<|document_2|><|audio_3|><|end|>\n<|assistant|>\nfine<|end|>\n<|user|>\n<|image_4|><|end|>\n"
    assert r.n_turns == 3 and r.n_attachments == 4
    assert r.n_tokens == 3 * chat.TURN_TOKENS + 3 + 2 * 576 + 3 * 800 + 10 * 25 + 576
    assert [(a["number"], a["type"], a["uri"], a["tokens"]) for a in json.loads(r.attachments)] == [(1, "image", "i.png", 1152), (2, "document", "d.pdf", 2400), (3, "audio", "a.wav", 250), (4, "image", "j.png", 576)]


def test_what_isnt_a_list_of_parts_is_text(spark):
    rows = [(1, 0, "user", "[1, 2]"), (2, 0, "user", "[not json"), (3, 0, "user", "a <|end|> b"), (4, 0, "user", "[]"), (5, 0, "user", json.dumps([{"type": "video", "uri": "v"}]))]
    got = run(spark, rows)
    assert got[1].prompt == "<|user|>\n[1, 2]<|end|>\n" and got[2].prompt == "<|user|>\n[not json<|end|>\n"
    assert got[3].prompt == "<|user|>\na < |end|> b<|end|>\n"
    assert got[4].prompt == "<|user|>\n[]<|end|>\n" and got[5].prompt == "<|user|>\n<|end|>\n"


def test_nulls_repeats_long_and_empty(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 0, "user", "y"), (2, 0, "user", "word " * 100_000), (3, 0, "user", "")]
    got = run(spark, rows)
    assert got[1].prompt == "<|user|>\nx<|end|>\n" * 2 + "<|unknown|>\n<|end|>\n" and got[1].attachments == "[]"
    assert got[None].n_turns == 1 and got[2].n_tokens == 100_002 and got[3].n_tokens == 2
    assert run(spark, []) == {}


def test_tokens_of_the_automaton(spark):
    """Text tokens may be those of operator 1."""
    from treeline.llm import bpe

    rows = [(1, 0, "user", "Hello, wörld's <|end|> tokens"), (1, 1, "assistant", None), (2, 0, "user", ""), (3, 0, "user", "word " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r.n_tokens for r in chat.format_chats(df, chat.Visitor(chat.tokens(spark))).collect()}
    automaton = bpe.compiled()
    alone = lambda t: sum(len(x[2]) for x in bpe.encode_column(automaton, pa.array([t])))
    assert got == {1: alone(rows[0][3]) + 2 * chat.TURN_TOKENS, 2: chat.TURN_TOKENS, 3: alone(rows[3][3]) + chat.TURN_TOKENS}


def test_the_query_has_attachments_of_all_types(spark, sf):
    found = [a for r in chat.op6_chat(spark, sf).collect() for a in json.loads(r.attachments)]
    assert {a["type"] for a in found} == set(chat.TOKENS) and all(a["tokens"] > 0 and a["uri"] for a in found)
