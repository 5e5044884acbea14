"""Counters, cumulative histograms and label normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Latency bounds in seconds, and route prefixes in order of precedence.
BOUNDS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
ROUTES = ["/v1/messages/count_tokens", "/v1/messages/batches", "/v1/messages", "/v1/complete", "/v1/chat/completions", "/v1/responses"]


def counter(df: DataFrame, labels: list[str], value: str | None = None, name: str = "total") -> DataFrame:
    """Sum by labels; without ``value`` each row counts one."""
    return df.groupBy(*labels).agg(F.sum(F.col(value).cast("double") if value else F.lit(1.0)).alias(name))


def histogram(df: DataFrame, labels: list[str], value: str, bounds: list[float] = BOUNDS) -> DataFrame:
    """Rows (labels, le, cumulative, sum, count); bounds are inclusive and the last is +Inf. One
    aggregation; a null value is not observed."""
    v = F.col(value)
    sums = [F.sum((v <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.where(v.isNotNull()).groupBy(*labels).agg(*sums, F.sum(v).alias("sum"), F.count(v).alias("count"))
    pairs = F.array(*(F.struct(F.lit(_number(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("cumulative")))
    return wide.select(*labels, F.explode(pairs).alias("b"), "sum", "count").select(*labels, "b.le", "b.cumulative", "sum", "count")


def _number(b: float) -> str:
    return f"{b:g}"


def normalise_path(path: Column) -> Column:
    out = None
    for r in ROUTES:
        out = F.when(path.startswith(r), r) if out is None else out.when(path.startswith(r), r)
    return out.otherwise("other")


def status_class(status: Column) -> Column:
    return F.when(status >= 500, "5xx").when(status >= 400, "4xx").when(status >= 300, "3xx").when(status >= 200, "2xx").otherwise("1xx")


def exposition_histogram(buckets: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """Text lines of ``histogram``'s rows: ``name_bucket`` with ``le`` last, ``name_sum`` and ``name_count``."""
    once = buckets.where("le = '+Inf'")
    lines = [exposition(buckets, f"{name}_bucket", [*labels, "le"], "cumulative"), exposition(once, f"{name}_sum", labels, "sum"), exposition(once, f"{name}_count", labels, "count")]
    return lines[0].unionByName(lines[1]).unionByName(lines[2])


def exposition(counters: DataFrame, name: str, labels: list[str], value: str = "total") -> DataFrame:
    """Text lines ``name{label="value"} n`` in label order."""
    quoted = [F.concat(F.lit(f'{x}="'), F.regexp_replace(F.regexp_replace(F.col(x).cast("string"), r"\\", r"\\\\\\\\"), '"', r'\\\\"'), F.lit('"')) for x in labels]
    body = F.concat(F.lit("{"), F.concat_ws(",", *quoted), F.lit("}")) if labels else F.lit("")
    v = F.col(value)
    text = F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
    return counters.select(F.concat(F.lit(name), body, F.lit(" "), text).alias("line"), *labels).orderBy(*labels).select("line")
