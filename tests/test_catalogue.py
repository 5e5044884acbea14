"""Every query against its SQL counterpart in another engine."""

import math
import os

import duckdb
import pytest

from quillguard.functions.patterns import detectors
from quillguard.operators import redaction
from quillguard.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "events", "documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(df):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else int(v) if type(v).__name__.startswith(("int", "uint")) else v
    return sorted((tuple(map(clean, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLE:
        want = con.execute(catalogue.ORACLE[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)


def test_sql_functions(spark):
    redaction.register(spark)
    r = spark.sql("select redact('a@b.io').text t, luhn_valid('4111111111111111') a, amka_valid('01019000122') b, afm_valid('123456784') c, (select count(*) from detect_spans('a@b.io 10.0.0.1')) n").first()
    assert tuple(r) == ("[EMAIL_1]", True, True, False, 2)


def test_recogniser_fails_open(spark):
    df = spark.createDataFrame([("Bob a@b.io",), (None,)], "text string")
    good = redaction.redact_with_recogniser(df, lambda ts: [[("PER", "Bob")] for _ in ts]).collect()
    assert good[0].redacted.text == "[NAME_1] [EMAIL_1]" and good[1].redacted.text is None
    bad = redaction.redact_with_recogniser(df, lambda ts: 1 / 0).collect()
    assert bad[0].redacted.text == "Bob [EMAIL_1]" and bad[0].redacted.counts == {"EMAIL": 1}
    own = df.selectExpr("text", "1 AS redacted", "2 AS counts")  # a table with such columns keeps them
    again = redaction.redact_with_recogniser(own, lambda ts: [[] for _ in ts], into="r").first()
    assert (again.redacted, again.counts, again.r.text) == (1, 2, "Bob [EMAIL_1]")


def test_stage_carries_numbers(spark):
    pack = [d for d in detectors() if d.kind == "APIKEY"]
    df = spark.createDataFrame([("AKIA" + "A" * 16 + " sk-" + "b" * 20,)], "text string")
    from pyspark.sql import functions as F

    one = df.select(redaction.stage(F.col("text"), pack[0]).alias("s"))
    two = one.select(redaction.stage(F.col("s.text"), pack[1], F.col("s.values")).alias("s")).first()
    assert two.s.text == "[APIKEY_2] [APIKEY_1]"
