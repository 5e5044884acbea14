import json
import time

from quillguard.functions.kernel import Kernel
from quillguard.functions.patterns import detectors
from quillguard.streaming import sse

K = Kernel(detectors())


def delta(text, index=0):
    return "data: " + json.dumps({"type": "content_block_delta", "index": index, "delta": {"type": "text_delta", "text": text}}) + "\n"


def chat(text, finish=None):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}, "finish_reason": finish}]}) + "\n"


def shown(out):
    text = ""
    for line, _ in out:
        if line.startswith("data: {"):
            e = json.loads(line[6:])
            text += e.get("delta", {}).get("text", "") if "delta" in e else "".join(c["delta"].get("content") or "" for c in e.get("choices", []))
    return text


def test_a_value_split_across_events():
    out, counts = sse.process("/v1/messages", [delta("mail jo"), delta("hn@x.com now"), "event: content_block_stop\n", 'data: {"type":"content_block_stop"}\n'], K)
    assert shown(out) == "mail [EMAIL_1] now" and counts == {"EMAIL": 1} and [m for _, m in out] == [False, False, False, True, True, False]


def test_done_finish_and_pass_through():
    lines = [": ping\n", "data: \n", "data: [1]\n", chat("a@b.io "), chat("x" * 80 + " "), chat("y"), "data: [DONE]\n"]
    out, _ = sse.process("/v1/chat/completions", lines, K)
    assert [x for x, _ in out[:3]] == lines[:3] and out[-1][0] == lines[-1] and shown(out) == "[EMAIL_1] " + "x" * 80 + " y"
    out, _ = sse.process("/v1/chat/completions", [chat("a@b.io"), chat("", "stop")], K)
    assert shown(out) == "[EMAIL_1]" and out[1][1]


def test_holdback_cuts_and_safe_mode():
    parts = [delta("my password: "), delta("hunter2secretvalue " + "z" * 50)]
    assert "hunter2secretvalue" in shown(sse.process("/v1/messages", parts, K)[0])  # the cut may fall between key and value
    assert "hunter2secretvalue" not in shown(sse.process("/v1/messages", parts, K, keep_all=True)[0])
    pem = "-----BEGIN PRIVATE KEY-----\n" + "a b\n" * 40
    out, counts = sse.process("/v1/messages", [delta(pem), delta("-----END PRIVATE KEY----- " + "w " * 50)], K)
    assert counts == {"PRIVATEKEY": 1} and "a b" not in shown(out)


def test_other_formats_and_reveal():
    gem = 'data: {"candidates":[{"content":{"parts":[{"text":"a@b.io"}]}}]}\n'
    assert "[EMAIL_1]" in sse.process("/v1beta/m:streamGenerateContent", [gem], K)[0][0][0]
    assert "[EMAIL_1]" in sse.process("/v1/responses", ['data: {"delta":"a@b.io"}\n'], K)[0][0][0]
    assert "[EMAIL_1]" in sse.process("/v1/messages", ['data: {"type":"content_block_delta","delta":{"partial_json":"a@b.io"}}\n'], K)[0][0][0]
    assert "seen" in sse.process("/v1/responses", ['data: {"text":"a@b.io"}\n'], K, reveal=lambda s: s.replace("[EMAIL_1]", "seen"))[0][0][0]


def test_counts_are_the_redactors_own(spark):
    jwt = "eyJ" + ".".join(["a" * 14] * 3)
    lines = [("s", "/v1/messages", 0, delta(f"password={jwt} and [EMAIL_9]")), ("s", "/v1/messages", 1, 'data: {"type":"message_stop"}\n'), ("t", "/v1/messages", 0, delta("a@b.io " + "w " * 50)), ("t", "/v1/messages", 1, delta("c@d.io"))]
    out = sse.redact_stream_table(spark.createDataFrame(lines, "stream_id string, path string, event_seq long, line string"))
    want = {(s, k, n) for s in "st" for k, n in sse.process("/v1/messages", [x[3] for x in lines if x[0] == s], K)[1].items()}
    assert {tuple(r) for r in sse.counts(out).collect()} == want and ("s", "JWT", 1) in want and ("t", "EMAIL", 2) in want


def test_structured_streaming_equals_the_table(spark, tmp_path):
    lines = [("s1", "/v1/messages", i, x) for i, x in enumerate([delta("call jo"), delta("hn@x.com " + "q " * 60), delta("end"), 'data: {"type":"message_stop"}\n'])]
    lines += [("s2", "/v1/chat/completions", i, x) for i, x in enumerate([chat("10.0."), chat("0.1 ok"), "data: [DONE]\n"])]
    schema = "stream_id string, path string, event_seq long, line string"
    whole = spark.createDataFrame(lines, schema)
    want = sorted((r.stream_id, r.event_seq, r.part, r.line) for r in sse.redact_stream_table(whole).collect())
    early, late = [lines[1], lines[4], lines[6]], [lines[0], lines[2], lines[3], lines[5], lines[5]]  # out of order, one twice
    for i, rows in enumerate((early, late)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    from quillguard.sources.readers import read_sse

    q = sse.redact_streams(read_sse(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("sse_out").option("checkpointLocation", f"{tmp_path}/c").start()
    # a query with timeouts always has a next batch, so it is stopped when all rows are out
    until = time.time() + 60
    while time.time() < until and spark.table("sse_out").count() < len(want):
        time.sleep(0.5)
    q.stop()
    assert sorted((r.stream_id, r.event_seq, r.part, r.line) for r in spark.table("sse_out").collect()) == want
    assert {(r.stream_id, r.kind, r.n) for r in sse.counts(spark.table("sse_out")).collect()} == {("s1", "EMAIL", 1), ("s2", "IP", 1)}
