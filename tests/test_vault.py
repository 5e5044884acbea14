import base64

import pytest

from quillguard.functions.kernel import Kernel, Scope
from quillguard.functions.patterns import detectors
from quillguard.operators import vault

JWT = "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12
TEXTS = ["a@x.io b@x.io", f"password={JWT} c@x.io", None, "b@x.io 10.0.0.1", f"token={JWT} secret: plain1", "", f"{JWT} password={JWT.replace('a', 'd')}"]


def sequential(texts):
    """What one pass over the rows in order, with one shared dictionary, gives."""
    known, top = {}, {}

    def assign(kind, value):
        if (kind, value) not in known:
            top[kind] = top.get(kind, 0) + 1
            known[kind, value] = f"{kind}_{top[kind]}"
        return known[kind, value]

    k = Kernel(detectors())
    return [None if t is None else k.redact(t, Scope(assign=assign)) for t in texts], {v: value for (_, value), v in known.items()}


def test_global_numbers_equal_a_sequential_pass(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string")
    out, v = vault.redact_global(df, "i")
    want, tokens = sequential(TEXTS)
    assert [r.redacted for r in out.orderBy("i").collect()] == want
    assert {r.token: r.value for r in v.collect()} == tokens
    more, v2 = vault.redact_global(spark.createDataFrame([(0, "z@x.io a@x.io")], "i long, text string"), "i", vault=v)
    assert more.first().redacted == "[EMAIL_4] [EMAIL_1]" and v2.count() == len(tokens) + 1


def test_reveal(spark):
    v = spark.createDataFrame([("EMAIL", 1, "EMAIL_1", "a<b>@x.io"), ("EMAIL", 2, "EMAIL_2", "line\n2")], vault.SCHEMA)
    df = spark.createDataFrame([(1, "x [EMAIL_1][EMAIL_2] [EMAIL_3] EMAIL_1"), (2, None), (3, "plain")], "i long, text string")
    want = ["x a<b>@x.iolline".replace("lline", "line") + "\n2 [EMAIL_3] EMAIL_1", None, "plain"]
    for limit in (10, 0):
        assert [r.revealed for r in vault.reveal(df, v, map_limit=limit).orderBy("i").collect()] == want
    bodies = spark.createDataFrame([('{"a":["[EMAIL_1]"]}',), ("no",)], "body string")
    assert [r.revealed for r in vault.reveal_bodies(bodies, v).collect()] == ['{"a":["a\\u003cb\\u003e@x.io"]}', "no"]


def test_sealing(spark, tmp_path):
    v = spark.createDataFrame([("EMAIL", 1, "EMAIL_1", "a\nb"), ("PHONE_NUMBER", 12, "PHONE_NUMBER_12", "é")], vault.SCHEMA)
    key, other = bytes(range(32)), bytes(32)
    vault.save(v, key, f"{tmp_path}/v")
    assert sorted(map(tuple, vault.load(spark, key, f"{tmp_path}/v").collect())) == sorted(map(tuple, v.collect()))
    with pytest.raises(Exception, match="does not open"):
        vault.load(spark, other, f"{tmp_path}/v").collect()
    assert vault.load(spark, key, f"{tmp_path}/none").count() == 0
    assert vault.load_key(base64.b64encode(key).decode()) == key == vault.decode_key(key) and vault.load_key() is None
    with pytest.raises(ValueError):
        vault.decode_key(b"short")


def test_bodies_are_revealed_alike_with_a_small_and_a_large_vault(spark):
    bodies = ['{"a":"to [EMAIL_1] and [EMAIL_2], [EMAIL_9]","[EMAIL_1]":1}', "no json [EMAIL_1]", None, '{"x":"[IP_1]"}', '{"x":"[IP_1]"}', "{}"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    known = spark.createDataFrame([("EMAIL", 1, "EMAIL_1", 'q"<a@b.io'), ("EMAIL", 2, "EMAIL_2", "c@d.io"), ("IP", 1, "IP_1", "10.0.0.1")], vault.SCHEMA)
    want = ['{"[EMAIL_1]":1,"a":"to q\\"\\u003ca@b.io and c@d.io, [EMAIL_9]"}', bodies[1], None, '{"x":"10.0.0.1"}', '{"x":"10.0.0.1"}', "{}"]
    for limit in (100, 0):
        out = vault.reveal_bodies(df, known, map_limit=limit)
        assert out.columns == ["i", "body", "revealed"] and [r.revealed for r in out.orderBy("i").collect()] == want


def test_one_plan_for_responses(spark):
    from quillguard.plans import traffic

    event = 'data: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"to [EMAIL_1], new@x.io"}}\n\n'
    rows = [("/v1/messages", "application/json", '{"content":[{"type":"text","text":"to [EMAIL_1], new@x.io, a@b.io"}]}'), ("/v1/messages", "text/event-stream; charset=utf-8", event + 'data: {"type":"message_stop"}\n\n'), ("/v1/messages", "text/plain", "a@b.io"), ("/v1/messages", None, None)]
    df = spark.createDataFrame(rows, "path string, content_type string, body string").coalesce(1)
    known = spark.createDataFrame([("EMAIL", 1, "EMAIL_1", "a@b.io")], vault.SCHEMA)
    plain, stream, other, none = traffic.process_responses(df, vault=known, auto_reveal=True).collect()
    assert "to [EMAIL_1], [EMAIL_2], [EMAIL_1]" in plain.redacted_body and "to a@b.io, new@x.io, a@b.io" in plain.client_body and plain.counts == {"EMAIL": 2}
    assert "@" not in stream.redacted_body and "[EMAIL_2]" in stream.redacted_body and "to a@b.io, new@x.io" in stream.client_body and stream.counts == {"EMAIL": 1}
    assert other.client_body == other.redacted_body == "a@b.io" and none.redacted_body is None
    off = traffic.process_responses(df, vault=known).collect()
    assert all(r.client_body == r.redacted_body for r in off)
    with pytest.raises(ValueError):
        traffic.process_responses(df, vault=known, vault_limit=0)
