import hashlib

import pytest

from quillguard.operators import audit, routing
from quillguard.sources import readers, settings


def fold(leaves):
    while len(leaves) > 1:
        leaves = [hashlib.sha256(bytes.fromhex(leaves[i]) + bytes.fromhex(leaves[min(i + 1, len(leaves) - 1)])).hexdigest() for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else ""


@pytest.mark.parametrize("n, height", [(0, 2), (1, 2), (2, 2), (3, 10), (4, 2), (5, 2), (7, 1), (9, 2), (17, 2), (21, 1), (33, 3)])
def test_merkle(spark, n, height):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    df = spark.createDataFrame([(i + 1, h) for i, h in enumerate(leaves)], "pos long, payload_hash string")
    assert audit.merkle_root(df, height).first()["merkle_root"] == fold(leaves)


@pytest.fixture
def log(spark):
    rows = [(i, "2024-01-01T00:00:00.5Z", "POST", "/v1/messages", None if i == 3 else "m", {"EMAIL": i, "CARD": 1} if i % 2 else {}, f"{i:064x}") for i in range(1, 8)]
    entries = spark.createDataFrame(rows, "o long, time string, method string, path string, model string, pii_redacted map<string,int>, payload_hash string")
    return audit.build_chain(entries, ["o"])


def test_chain(spark, log, tmp_path):
    rows, prev = log.orderBy("seq").collect(), audit.GENESIS
    for r in rows:
        digest = ",".join(f"{k}={v}" for k, v in sorted(r.pii_redacted.items()))
        text = f"{r.seq}\n{r.time}\n{r.method}\n{r.path}\n{r.model or ''}\n{r.payload_hash}\n{digest}\n{prev}"
        assert (r.prev_hash, r.hash) == (prev, hashlib.sha256(text.encode()).hexdigest())
        prev = r.hash
    readers.write_audit(log, f"{tmp_path}/log")
    back = readers.read_audit(spark, f"{tmp_path}/log")
    assert audit.verify(back).first().asDict() == {"records": 7, "chain_ok": True, "error": None}
    more = audit.build_chain(spark.createDataFrame([(1, "t", "GET", "/", "m", {}, "00")], "o long, time string, method string, path string, model string, pii_redacted map<string,int>, payload_hash string"), ["o"], prev, 7)
    readers.write_audit(more, f"{tmp_path}/log")
    assert audit.verify(readers.read_audit(spark, f"{tmp_path}/log")).first()["records"] == 8
    assert [r.seq for r in audit.recent(back, 3).collect()] == [5, 6, 7] and [r.seq for r in audit.recent(back, 2, True).collect()] == [7, 6]
    assert len(audit.root_digest(back)) == 32 and audit.anchor(back, [lambda d: 1 / 0, lambda d: d]) == [audit.root_digest(back)]
    with pytest.raises(RuntimeError):
        audit.anchor(back, [lambda d: 1 / 0])


def test_a_log_of_files_of_any_size(spark, tmp_path):
    schema = "o long, time string, method string, path string, model string, pii_redacted map<string,int>, payload_hash string"
    last, seq = audit.GENESIS, 0
    for n in (3, 57, 1, 20):
        part = audit.build_chain(spark.createDataFrame([(i, "t", "GET", "/", "m", {}, f"{i:02d}") for i in range(n)], schema), ["o"], last, seq).persist()
        readers.write_audit(part, f"{tmp_path}/log")
        end = part.orderBy(audit.F.desc("seq")).first()
        last, seq = end.hash, end.seq
    back = readers.read_audit(spark, f"{tmp_path}/log")
    assert audit.verify(back).first().asDict() == {"records": 81, "chain_ok": True, "error": None}
    assert [r.pos for r in back.orderBy("seq").collect()] == list(range(1, 82))
    (tmp_path / "long.jsonl").write_text('{"seq":1,"model":"' + "x" * readers.LONGEST + '"}\n')
    assert readers.read_audit(spark, str(tmp_path / "long.jsonl")).first().seq is None


def test_odd_query_strings(spark):
    rows = [("a=b c|d",), ("key=",), ("akey=1",), ("a=b&key=z%zz",), (None,), ("key=1#x",), ("%",)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string").select(routing.query_value(audit.F.col("q"), "key")).collect()]
    assert got == ["", "", "", "z%zz", "", "1", ""]


def test_breaks(spark, log, tmp_path):
    lines = [r.value for r in log.orderBy("seq").select(audit.F.to_json(audit.F.struct("*")).alias("value")).collect()]

    def check(changed):
        (tmp_path / "x.jsonl").write_text("\n".join(changed) + "\n\n")
        df = readers.read_audit(spark, str(tmp_path / "x.jsonl"))
        return audit.verify(df).first()["error"], audit.summary(df).first().asDict(), {r.kind: r.n for r in audit.per_kind(df).collect()}

    assert check(lines)[0] is None and check(lines[:-2])[0] is None
    error, s, kinds = check([lines[0], lines[2], lines[1], *lines[3:]])
    assert error == "seq 3: out of order (expected 2)" and s["records"] == 0 and s["merkle_root"] is None and kinds == {"EMAIL": 1, "CARD": 1}
    assert check([*lines[:4], lines[4].replace('"EMAIL":5', '"EMAIL":6'), *lines[5:]])[0] == "seq 5: hash mismatch, record tampered"
    assert check([*lines[:4], "{oops", *lines[5:]])[0] == "corrupt json near record 5"
    assert check(lines[1:])[0] == "seq 2: out of order (expected 1)"
    assert check([])[1]["records"] == 0


def test_chains_side_by_side(spark):
    rows = [(g, i, "t", "m", "p", "x", {}, "00") for g in ("a", "b") for i in range(3)]
    out = audit.build_chains(spark.createDataFrame(rows, "log string, o long, time string, method string, path string, model string, pii_redacted map<string,int>, payload_hash string"), "log", ["o"]).collect()
    assert sorted((r.log, r.seq) for r in out) == [(g, i) for g in "ab" for i in (1, 2, 3)] and len({r.hash for r in out}) == 3


def test_time_and_headers(spark):
    one = spark.sql("select timestamp'2024-01-02 03:04:05.120' a, timestamp'2024-01-02 03:04:05' b, map('Host','h','TE','x','X-A','1') h")
    r = one.select(audit.rfc3339_nano(one.a), audit.rfc3339_nano(one.b), routing.forwarded(one.h)).first()
    assert tuple(r) == ("2024-01-02T03:04:05.12Z", "2024-01-02T03:04:05Z", {"X-A": "1"})


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("# c\neu_pack: yes\ncustom_terms:\n  - 'A b'\n  - c\ngoogle_url: http://g # x\n")
    s = settings.load(str(tmp_path / "c.yaml"), {"QUILLGUARD_EU_PACK": "off", "QUILLGUARD_NAME_PACK": "1"})
    assert (s.eu_pack, s.name_pack, s.custom_terms, s.google_url) == (False, True, ["A b", "c"], "http://g")
    (tmp_path / "d.yaml").write_text("nope: 1\n")
    with pytest.raises(ValueError):
        settings.load(str(tmp_path / "d.yaml"), {})


def test_terms(spark, tmp_path):
    (tmp_path / "t").write_text("a\n\n # no\n b c \n")
    assert readers.read_terms(spark, str(tmp_path / "t")) == ["a", "b c"]
