"""Hash-chained audit log: building, verification, summaries and Merkle roots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Fixed value: what the first record links to.
GENESIS = "0" * 64

SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("time", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("model", T.StringType()), T.StructField("pii_redacted", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("payload_hash", T.StringType()), T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType()),
])


def payload_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def pii_digest(counts: Column) -> Column:
    """``kind=n`` sorted by kind, comma-joined; empty or null: ''."""
    pairs = F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.coalesce(F.array_join(pairs, ","), F.lit(""))


def rfc3339_nano(ts: Column) -> Column:
    """UTC time with a fraction of no trailing zeros; session time zone UTC is assumed."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(base, "0+$", ""), r"\.$", ""), F.lit("Z"))


def _head(r=F.col) -> Column:
    """What a record's hash covers, up to the digest of its counts."""
    s = lambda c: F.coalesce(r(c).cast("string"), F.lit(""))  # noqa: E731  concat_ws would skip nulls
    return F.concat_ws("\n", s("seq"), s("time"), s("method"), s("path"), s("model"), s("payload_hash"), pii_digest(r("pii_redacted")))


def chain_hash(head: Column, prev: Column) -> Column:
    return F.sha2(F.concat(head, F.lit("\n"), prev), 256)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1, buckets: int = 64) -> DataFrame:
    """A gapless number in the order of ``order``, whose first column is numeric, without a window over
    all rows: equal-width buckets of the first column, their counts, and a number within each."""
    lo, hi = df.agg(F.min(order[0]), F.max(order[0])).first()
    if lo is None:
        return df.withColumn(name, F.lit(start).cast("long"))
    width = max(1, -(-(int(hi) - int(lo) + 1) // buckets))
    cut = df.withColumn("_bucket", F.floor((F.col(order[0]) - F.lit(lo)) / width).cast("int"))
    before, total = {}, start - 1
    for r in cut.groupBy("_bucket").count().orderBy("_bucket").collect():  # at most `buckets` rows
        before[r["_bucket"]] = total
        total += r["count"]
    first = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_bucket"))
    return cut.withColumn(name, (first + F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))).cast("long")).drop("_bucket")


def build_chain(entries: DataFrame, order: list[str], last_hash: str = GENESIS, last_seq: int = 0) -> DataFrame:
    """Records for ``entries`` (time, method, path, model, pii_redacted, payload_hash) in ``order``.

    All but the link is computed in parallel; the fold itself is sequential by definition and runs in
    one task that streams sorted batches and holds one hash. Independent logs go through
    ``build_chains``, a task each. ``last_hash`` and ``last_seq`` continue an existing log.
    """
    rows = numbered(entries, order, "seq", last_seq + 1)
    rows = rows.select("seq", "time", "method", "path", "model", "pii_redacted", "payload_hash").withColumn("_head", _head())

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev = last_hash
        for pdf in batches:
            prevs, hashes = [], []
            for head in pdf["_head"]:
                prevs.append(prev)
                prev = hashlib.sha256(f"{head}\n{prev}".encode()).hexdigest()
                hashes.append(prev)
            yield pdf.drop(columns="_head").assign(prev_hash=prevs, hash=hashes)

    return rows.repartitionByRange(1, "seq").sortWithinPartitions("seq").mapInPandas(fold, SCHEMA)


def build_chains(entries: DataFrame, log: str, order: list[str]) -> DataFrame:
    """One chain for each value of ``log``; a chain is a group, chains run side by side."""
    w = Window.partitionBy(log).orderBy(*order)
    rows = entries.withColumn("seq", F.row_number().over(w).cast("long")).select(log, *[f.name for f in SCHEMA if f.name not in ("prev_hash", "hash")]).withColumn("_head", _head())

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, prev, prevs, hashes = pdf.sort_values("seq"), GENESIS, [], []
        for head in pdf["_head"]:
            prevs.append(prev)
            prev = hashlib.sha256(f"{head}\n{prev}".encode()).hexdigest()
            hashes.append(prev)
        return pdf.drop(columns="_head").assign(prev_hash=prevs, hash=hashes)

    schema = T.StructType([entries.schema[log], *SCHEMA.fields])
    return rows.groupBy(log).applyInPandas(fold, schema)


def violations(log: DataFrame) -> DataFrame:
    """Every record that fails, with its first failing check: (pos, seq, error). ``log`` has the record
    columns and ``pos``, the line's place from 1; a null seq marks a line that is no record.

    Hashes are recomputed from each record alone; the link is an equi-join with the line before.
    """
    prev = log.select((F.col("pos") + 1).alias("pos"), F.col("hash").alias("_before"))
    joined = log.join(prev, "pos", "left")
    expected = F.when(F.col("pos") == 1, F.lit(GENESIS)).otherwise(F.col("_before"))
    seq = F.col("seq").cast("string")
    error = (
        F.when(F.col("seq").isNull(), F.concat(F.lit("corrupt json near record "), F.col("pos").cast("string")))
        .when(F.col("seq") != F.col("pos"), F.concat(F.lit("seq "), seq, F.lit(": out of order (expected "), F.col("pos").cast("string"), F.lit(")")))
        .when(~F.col("prev_hash").eqNullSafe(expected), F.concat(F.lit("seq "), seq, F.lit(": broken chain link")))
        .when(~F.col("hash").eqNullSafe(chain_hash(_head(), F.coalesce("prev_hash", F.lit("")))), F.concat(F.lit("seq "), seq, F.lit(": hash mismatch, record tampered")))
    )
    return joined.select("pos", "seq", error.alias("error")).where("error IS NOT NULL")


def verify(log: DataFrame) -> DataFrame:
    """One row: records, chain_ok, error. The earliest failing line decides; records is 0 when one fails.
    A log cut at its end still verifies, so the number of records has to be pinned elsewhere."""
    bad = violations(log).agg(F.min(F.struct("pos", "error")).alias("first"))
    total = log.agg(F.count("*").alias("n"))
    return total.crossJoin(bad).select(F.when(F.col("first").isNull(), F.col("n")).otherwise(0).cast("long").alias("records"), F.col("first").isNull().alias("chain_ok"), F.col("first.error").alias("error"))  # one row each


def per_kind(log: DataFrame) -> DataFrame:
    """Counts by kind over the records before the first violation, most frequent first, then by name."""
    stop = violations(log).agg(F.min("pos").alias("stop"))
    good = log.crossJoin(F.broadcast(stop)).where("stop IS NULL OR pos < stop")  # one row
    return good.select(F.explode("pii_redacted").alias("kind", "n")).groupBy("kind").agg(F.sum("n").cast("long").alias("n")).orderBy(F.desc("n"), "kind")


def summary(log: DataFrame, exists: bool = True) -> DataFrame:
    """One row: exists, records, chain_ok, error, last_time, merkle_root."""
    v = verify(log)
    stop = violations(log).agg(F.min("pos").alias("stop"))
    last = log.crossJoin(F.broadcast(stop)).where("stop IS NULL OR pos < stop").agg(F.max_by("time", "pos").alias("last_time"))
    root = merkle_root(log.select("pos", "payload_hash"))
    return v.crossJoin(last).crossJoin(root).select(F.lit(exists).alias("exists"), "records", "chain_ok", F.regexp_replace("error", "broken chain link|hash mismatch, record tampered", "chain broken or record tampered").alias("error"), "last_time", F.when(F.col("chain_ok"), F.col("merkle_root")).alias("merkle_root"))


def recent(log: DataFrame, n: int, newest_first: bool = False) -> DataFrame:
    """The last ``n`` records; the limit is a top-k over partial results, not a full sort."""
    last = log.orderBy(F.desc("pos")).limit(n)
    return last if newest_first else last.orderBy("pos")


def row_total(counts: Column) -> Column:
    return F.coalesce(F.aggregate(F.map_values(counts), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")


def pair_hash(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(F.unhex(a), F.lit(b"")), F.coalesce(F.unhex(b), F.lit(b""))), 256)


def _fold_once(level: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1), lambda i: pair_hash(F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.get(level, i * 2))))


def merkle_root(leaves: DataFrame, height: int = 10) -> DataFrame:
    """One row: merkle_root of ``leaves`` (pos from 1, payload_hash); '' for no leaf.

    Aligned subtrees of 2**height leaves are folded side by side, JVM-side, then their roots in the same
    way, so the number of passes is the logarithm to base 2**height. Where there are several
    subtrees, each is folded through its whole height: a short last one pairs with itself, as it would
    level by level.
    """
    n = leaves.count()
    rows = leaves.select((F.col("pos") - 1).cast("long").alias("i"), F.col("payload_hash").alias("h"))
    if not n:
        return leaves.sparkSession.createDataFrame([("",)], "merkle_root string")
    while n > 1:
        several = n > 1 << height
        steps = height if several else max(1, (n - 1).bit_length())
        level = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        tree = rows.groupBy(F.shiftright("i", height).alias("i")).agg(level.alias("level"))
        folded = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("level"), lambda acc, _: _fold_once(acc))
        rows = tree.select("i", F.get(folded, F.lit(0)).alias("h"))
        n = -(-n // (1 << height))
    return rows.select(F.col("h").alias("merkle_root"))


def root_digest(log: DataFrame) -> bytes:
    """The 32-byte root of a verified log; an error when it is broken or empty."""
    v = verify(log).first()
    if not v["chain_ok"]:
        raise ValueError(v["error"])
    if not v["records"]:
        raise ValueError("the log is empty")
    return bytes.fromhex(merkle_root(log.select("pos", "payload_hash")).first()["merkle_root"])


def anchor(log: DataFrame, stamps: list) -> list:
    """Give the root to callables that stamp it; some may fail, all may not."""
    digest, out, errors = root_digest(log), [], []
    for stamp in stamps:
        try:
            out.append(stamp(digest))
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    if not out:
        raise RuntimeError(f"no stamp succeeded: {errors}")
    return out
