import json

import pytest

from quillguard.functions import canonical, wire
from quillguard.functions.kernel import Kernel
from quillguard.functions.patterns import detectors
from quillguard.operators.redaction import rewritten

K = Kernel(detectors())
MAIL = "a@b.io"


@pytest.mark.parametrize("text, out", [
    ('{"b":1,"a":"<&>"}', '{"a":"\\u003c\\u0026\\u003e","b":1}'), ("12345678901234567890", "12345678901234567000"), ("1e21", "1e+21"), ("0.0000001", "1e-7"),
    ("1.50", "1.5"), ("-0.0", "-0"), ("1e20", "100000000000000000000"), ('"\\u2028\\u0001\\ud800"', '"\\u2028\\u0001�"'), ("[true,null]", "[true,null]"),
])
def test_canonical(text, out):
    assert canonical.dumps(canonical.loads(text)) == out


@pytest.mark.parametrize("text", ["1e400", "NaN", "{", "", "{'a':1}"])
def test_not_json(text):
    with pytest.raises(ValueError):
        canonical.loads(text)


def body(path, node, direction="request"):
    out, counts, ok = rewritten(path, json.dumps(node), direction, K)
    assert ok
    return json.loads(out), counts


def test_families():
    assert wire.family("/v1/completions") == "other" and wire.family("/v1/messages/batches/x") == "batches"
    assert body("/v1/chat/completions", {"messages": [{"content": MAIL}, {"role": "x"}, 3]}) == ({"messages": [{"content": "[EMAIL_1]"}, {"content": None, "role": "x"}, 3]}, {"EMAIL": 1})
    assert body("/v1/responses", {"instructions": MAIL, "input": [{"content": MAIL, "text": MAIL}, {"a": 1}]})[1] == {"EMAIL": 3}
    assert body("/v1/messages", {"system": [{"text": MAIL}], "messages": []})[0]["system"] == [{"text": "[EMAIL_1]"}]
    assert body("/v1/messages/batches", {"requests": [{"params": {"system": MAIL}}]})[1] == {"EMAIL": 1}
    assert body("/v1/complete", {"prompt": MAIL})[1] == {"EMAIL": 1} and body("/v1/complete", {"completion": MAIL}, "response")[1] == {"EMAIL": 1}
    gem = {"contents": [{"parts": [{"text": MAIL, "functionCall": {"args": {"k": [MAIL]}}, "functionResponse": {"response": MAIL}}]}], "system_instruction": {"parts": [{"text": MAIL}]}}
    assert body("/v1beta/m:generateContent", gem)[1] == {"EMAIL": 4}
    assert body("/v1/embeddings", {"input": MAIL}) == ({"input": MAIL}, {})
    assert body("/v1/messages/batches", {"content": MAIL}, "response")[1] == {}


def test_blocks():
    blocks = [
        {"type": "thinking", "text": MAIL}, {"type": "tool_use", "input": {"a": {"b": [MAIL, 1]}, MAIL: 2}}, {"type": "document", "source": {"type": "text", "data": MAIL}, "title": MAIL, "context": MAIL},
        {"type": "document", "source": {"type": "content", "content": [{"text": MAIL}]}}, {"type": "tool_result", "content": [{"type": "text", "text": MAIL}]}, {"type": "image", "source": {"type": "base64", "data": MAIL}},
    ]
    out, counts = body("/v1/messages", {"messages": [{"content": blocks}]})
    got = out["messages"][0]["content"]
    assert counts == {"EMAIL": 6} and got[0]["text"] == MAIL and MAIL in got[1]["input"] and got[5]["source"]["data"] == MAIL


def test_scope_and_bad_bodies():
    two = {"messages": [{"content": MAIL}, {"content": "c@d.io"}]}
    assert [m["content"] for m in body("/v1/messages", two)[0]["messages"]] == ["[EMAIL_1]", "[EMAIL_1]"]
    out, _, _ = rewritten("/v1/messages", json.dumps(two), "request", K, per_request=True)
    assert [m["content"] for m in json.loads(out)["messages"]] == ["[EMAIL_1]", "[EMAIL_2]"]
    for bad in ("x", "[1]", None, ""):
        assert rewritten("/v1/messages", bad, "request", K) == (bad, {}, False)
    assert rewritten("/v1/messages", "null", "request", K) == ("null", {}, True)
