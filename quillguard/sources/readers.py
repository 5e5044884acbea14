"""Readers and writers of the formats that audit logs and term lists use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.audit import SCHEMA


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """One term a line; blank lines and ``#`` comments are skipped. Terms become one pattern, so they
    come to the driver."""
    t = F.trim("value")
    return [r["t"] for r in spark.read.text(path).select(t.alias("t")).where("t <> '' AND NOT startswith(t, '#')").collect()]


#: Fixed value: bytes of the longest line that is read as a record.
LONGEST = 4 << 20


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log with ``pos``, each record's place, blank lines not counted. A corrupt line, and one
    of more than 4 MiB, is kept with a null seq.

    Lines keep their order within a file, so a reordered log stays reordered; files follow each other by
    the seq of their first record (then by time and name), whatever their sizes and names. The places
    come from a count of each split's lines, a row a split, not from a sort of the log.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    m = F.col("_metadata")
    lines = lines.select("value", F.struct(m["file_path"].alias("file"), m["file_block_start"].alias("block")).alias("_s"), m["file_modification_time"].alias("_t"), F.monotonically_increasing_id().alias("_id"))
    seq = F.get_json_object("value", "$.seq").try_cast("long")
    splits = lines.groupBy("_s").agg(F.count("*").alias("n"), F.min("_t").alias("t"), F.min_by(seq, F.when(seq.isNotNull(), F.col("_id"))).alias("seq")).collect()
    if not splits:
        return spark.createDataFrame([], SCHEMA).withColumn("pos", F.lit(0).cast("long"))
    first: dict[str, tuple] = {}
    for r in sorted(splits, key=lambda r: r["_s"]["block"]):
        first.setdefault(r["_s"]["file"], (r["seq"] is None, r["seq"] or 0, r["t"], r["_s"]["file"]))
    before, total = [], 0
    for r in sorted(splits, key=lambda r: (first[r["_s"]["file"]], r["_s"]["block"])):
        before.append((tuple(r["_s"]), total))
        total += r["n"]
    starts = spark.createDataFrame(before, "_s struct<file string, block long>, _first long")
    place = F.row_number().over(Window.partitionBy("_s").orderBy("_id"))
    placed = lines.withColumn("_place", place).join(starts, "_s")
    record = F.when(F.octet_length("value") <= LONGEST, F.from_json("value", SCHEMA)).otherwise(F.from_json(F.lit(""), SCHEMA))
    return placed.select(record.alias("r"), (F.col("_first") + F.col("_place")).cast("long").alias("pos")).select("r.*", "pos")


def write_audit(log: DataFrame, path: str, mode: str = "append") -> None:
    """Append records as JSON lines in seq order; a failed write raises, so that nothing goes on unrecorded."""
    log.repartitionByRange(1, "seq").sortWithinPartitions("seq").select(F.to_json(F.struct(*[f.name for f in SCHEMA]), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def read_sse(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event lines (stream_id, path, event_seq, line) from JSON files."""
    return spark.readStream.schema("stream_id string, path string, event_seq long, line string").json(path)
