"""Redaction as DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import canonical, wire
from ..functions.kernel import ENTITY_KINDS, Kernel, Scope, replace_entities
from ..functions.patterns import BUILT_IN, Detector, detectors, ported
from ..functions.validators import COLUMNS, afm_column, amka_column, card_column
from ..shipping import ship

RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.IntegerType()))])


def builtin_count() -> int:
    return len(BUILT_IN)


def redact_udf(kernel: Kernel) -> Callable[[Column], Column]:
    """``text -> struct<text, counts>``. Null stays null with empty counts; numbering starts at 1 in
    each text."""

    @F.pandas_udf(RESULT)
    def redact(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            scope = Scope()
            out.append((None if t is None else kernel.redact(t, scope), scope.counts))
        return pd.DataFrame(out, columns=["text", "counts"])

    return redact


def spread(scan: DataFrame) -> DataFrame:
    """A scan that has fewer partitions than there are cores, such as one of a file with a single row
    group, dealt out to all of them: detection costs far more than moving the text. Others stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def redact(df: DataFrame, column: str = "text", pack: list[Detector] | None = None, into: str = "redacted") -> DataFrame:
    """Adds ``into`` struct<text, counts>. One Arrow pass, no shuffle; any other column is kept."""
    ship(df.sparkSession)
    return df.withColumn(into, redact_udf(Kernel(pack if pack is not None else detectors()))(F.col(column)))


def redact_entities(df: DataFrame, text: str, entities: str, into: str = "redacted") -> DataFrame:
    """Replace the given ``entities`` array<struct<type, text>>; a null or empty list changes nothing."""
    ship(df.sparkSession)

    @F.pandas_udf(RESULT)
    def apply(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for t, es in zip(texts, found):
            scope = Scope()
            pairs = [] if es is None else [(e["type"], e["text"]) for e in es]
            out.append((None if t is None else replace_entities(t, pairs, scope), scope.counts))
        return pd.DataFrame(out, columns=["text", "counts"])

    return df.withColumn(into, apply(F.col(text), F.col(entities)))


def redact_with_recogniser(df: DataFrame, recognise: Callable[[list[str]], list[list[tuple[str, str]]]], column: str = "text", pack: list[Detector] | None = None, into: str = "redacted") -> DataFrame:
    """Adds ``into`` struct<text, counts>: the pack, then entities of a user's recogniser, called once for
    each Arrow batch. When it raises, the batch keeps the pack's result: an outage never stops redaction."""
    ship(df.sparkSession)
    kernel = Kernel(pack if pack is not None else detectors())

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for given in batches:
            scopes = [Scope() for _ in range(len(given))]
            texts = [None if t is None else kernel.redact(t, s) for t, s in zip(given, scopes)]
            try:
                found = recognise([t or "" for t in texts])
            except Exception:  # noqa: BLE001  fails open by contract
                found = [[] for _ in texts]
            texts = [None if t is None else replace_entities(t, e, s) for t, e, s in zip(texts, found, scopes)]
            yield pd.DataFrame({"text": texts, "counts": [s.counts for s in scopes]})

    return df.withColumn(into, run(F.col(column)))


def entity_kind(kind: Column) -> Column:
    out = None
    for name, types in ENTITY_KINDS.items():
        hit = F.upper(kind).isin(*types)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.upper(kind))


def stage(text: Column, d: Detector, seen: Column | None = None) -> Column:
    """One detector as a Catalyst expression: struct<text, values>, ``values`` being those replaced, in
    order. ``seen`` holds the distinct values of this kind from earlier stages. A text without a match
    costs one search."""
    pattern = F.lit(ported(d.pattern, java=True))
    found = F.rlike(text, pattern)
    if "@" in d.pattern:
        found = text.contains("@") & found
    whole, value = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(d.group))
    parts = F.split(text, ported(d.pattern, java=True), -1)
    valid = COLUMNS[d.validator] if d.validator else (lambda c: F.lit(True))
    kept = F.filter(value, lambda v: valid(v))
    known = F.array_distinct(F.concat(seen, kept) if seen is not None else kept)

    def token(m, v):
        n = F.array_position(known, v)
        return F.when(valid(v), F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(v)), F.lit(f"[{d.kind}_"), n.cast("string"), F.lit("]"))).otherwise(m)

    replaced = F.concat(F.zip_with(whole, value, token), F.array(F.lit("")))
    changed = F.struct(F.array_join(F.zip_with(parts, replaced, lambda p, r: F.concat(p, r)), "").alias("text"), kept.alias("values"))
    none = F.struct(text.alias("text"), F.array().cast("array<string>").alias("values"))
    return F.when(found, changed).otherwise(none)


def counts_by_kind(df: DataFrame, counts: str = "redacted.counts") -> DataFrame:
    """Sum of a map column by kind; partial sums leave each task before the shuffle."""
    return df.select(F.explode(F.col(counts)).alias("kind", "n")).groupBy("kind").agg(F.sum("n").cast("long").alias("n"))


BODY = T.StructType([T.StructField("body", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.IntegerType())), T.StructField("parse_ok", T.BooleanType())])


def rewritten(path: str | None, body: str | None, direction: str, kernel: Kernel, per_request: bool = False, assign: Callable[[str, str], str] | None = None) -> tuple:
    """(body, counts, parse_ok). A body that is no JSON object stays as it is, with no counts. Each text
    field numbers afresh; ``per_request`` numbers through the whole body instead, ``assign`` as it says."""
    try:
        node = canonical.loads(body or "")
        if node is not None and not isinstance(node, dict):
            raise ValueError("not an object")
    except (ValueError, RecursionError):
        return body, {}, False
    total: dict[str, int] = {}
    shared = Scope()

    def change(text: str) -> str:
        scope = Scope(numbers=shared.numbers, assign=assign) if per_request else Scope(assign=assign)
        out = kernel.redact(text, scope)
        for k, n in scope.counts.items():
            total[k] = total.get(k, 0) + n
        return out

    wire.rewrite_body(path or "", node, direction, change)
    return canonical.dumps(node), total, True


def redact_bodies(df: DataFrame, direction: str = "request", path: str = "path", body: str = "body", pack: list[Detector] | None = None, into: str = "rewritten", per_request: bool = False) -> DataFrame:
    """Adds ``into`` struct<body, counts, parse_ok>: the body with its family's text fields redacted, in
    canonical JSON."""
    ship(df.sparkSession)
    kernel = Kernel(pack if pack is not None else detectors())

    @F.pandas_udf(BODY)
    def apply(paths: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rewritten(p, b, direction, kernel, per_request) for p, b in zip(paths, bodies)], columns=["body", "counts", "parse_ok"])

    return df.withColumn(into, apply(F.col(path), F.col(body)))


def register(spark: SparkSession, pack: list[Detector] | None = None) -> None:
    """SQL functions ``redact``, ``luhn_valid``, ``amka_valid``, ``afm_valid`` and the table function
    ``detect_spans``."""
    ship(spark)
    kernel = Kernel(pack if pack is not None else detectors())
    spark.udf.register("redact", redact_udf(kernel))
    from ..functions import validators as v

    for name, check in (("luhn_valid", v.card), ("amka_valid", v.amka), ("afm_valid", v.afm)):
        spark.udf.register(name, F.pandas_udf(lambda s, check=check: s.map(lambda x: x is not None and check(x)), "boolean"))

    @F.udtf(returnType="kind string, start int, end int, value string")
    class DetectSpans:
        def eval(self, text: str):
            yield from kernel.spans(text or "")

    spark.udtf.register("detect_spans", DetectSpans)


__all__ = ["afm_column", "amka_column", "card_column", "builtin_count", "counts_by_kind", "entity_kind", "redact", "redact_bodies", "redact_entities", "redact_udf", "redact_with_recogniser", "register", "rewritten", "stage"]
