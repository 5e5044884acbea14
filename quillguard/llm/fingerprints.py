"""Document fingerprints by content-defined chunking with a normalised gear hash."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import store
from .words import bounded, mix

#: Chunk sizes in bytes: none below the first but the last one, a strict mask up to the second, a
#: loose one from there, none above the third.
SMALLEST, NORMAL, LARGEST = 8, 24, 96
WINDOW = 32
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
STRICT, LOOSE = np.uint32(0xF8000000), np.uint32(0xE0000000)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: h = (h << 1) + gear[byte], which in 32 bits depends on 32 bytes alone;
    five doublings give it for all bytes at once."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks. A boundary depends on the bytes before it back to the last boundary and on
    the window, so after an edit the chunks meet the old ones again."""
    n = len(data)
    if n <= SMALLEST:
        return [n] if n else []
    h = rolling(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = (h[loose] & STRICT) == 0
    out, last = [], 0
    for i, s in zip((loose + 1).tolist(), strict.tolist()):
        while i - last > LARGEST:
            last += LARGEST
            out.append(last)
        size = i - last
        if size >= SMALLEST and (s or size >= NORMAL):
            out.append(i)
            last = i
    while n - last > LARGEST:
        last += LARGEST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunks(text: str) -> dict[int, int]:
    """Digest -> bytes of the distinct chunks of a text."""
    data = text.encode("utf-8", "replace")
    out, last, digest = {}, 0, xxhash.xxh3_64_intdigest
    for end in boundaries(data):
        out[digest(data[last:end]) >> 16] = end - last
        last = end
    return out


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Containment: the bytes in chunks of both over the bytes in chunks of the smaller. Two empty
    fingerprints are alike, an empty and another are not."""
    if not a or not b:
        return float(not a and not b)
    if len(b) < len(a):
        a, b = b, a
    least = min(sum(a.values()), sum(b.values()))
    return min(1.0, sum(n for d, n in a.items() if d in b) / least)


def written(c: dict[int, int]) -> str:
    """A fingerprint as text: for each distinct chunk, sorted, 12 digits of digest and 2 of length."""
    return "".join([f"{d:012x}{n:02x}" for d, n in sorted(c.items())])


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _part(cuts: list[tuple[int, int]]):
    """Range of a key (o, h) among ascending ``cuts``, by bisection: how many cuts are not above it."""
    first, second = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)

    @F.pandas_udf("int")
    def part(o: pd.Series, h: pd.Series) -> pd.Series:
        o, h = o.to_numpy(np.int64), h.to_numpy(np.int64)
        low, high = np.searchsorted(first, o, "left"), np.searchsorted(first, o, "right")
        for x in np.unique(o[low < high]).tolist():  # cuts that share their first half
            own = np.flatnonzero(o == x)
            i, j = low[own[0]], high[own[0]]
            high[own] = i + np.searchsorted(second[i:j], h[own], "right")
        return pd.Series(high.astype(np.int32))

    return part


def compare_with_next(docs: DataFrame, folder: str, sample: int = 64) -> DataFrame:
    """For each document of ``docs`` (doc_id, text): its fingerprint, that of its edited text (the last
    quarter of its code points replaced by the first as many of the next document's, by ascending
    doc_id, the first after the last), and the likeness to that and to the next document.

    Null text: empty, with an empty fingerprint. Rows without doc_id come first; repeated ids are
    ordered by a hash of the text. One row alone is its own next. An empty table gives no rows. Other
    columns are not read.

    One shuffle of the texts, by ranges of (doc_id, hash), so that an id that many rows share is cut as
    well; about ``sample`` keys a range come to the driver to cut the ranges, which no result depends
    on. Each range also gets the first row of the range after it, so that neighbours across the border meet
    without a window over all rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("o"), F.xxhash64(text).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n, total = store.parts(spark), rows.count()
    if not total:
        return spark.createDataFrame([], OUT)
    # seeded by the row's own key, so that a repeated job finds the same cuts
    share = min(1.0, sample * n / total)
    some = rows.select("o", "h").where(F.pmod(F.xxhash64("o", "h", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    keys = sorted(some.distinct().limit(4 * sample * n).collect()) if n > 1 else []
    cuts = sorted({tuple(keys[i * len(keys) // n]) for i in range(1, n)}) if keys else []
    part = _part(cuts)(F.col("o"), F.col("h")) if cuts else F.lit(0)
    firsts = rows.groupBy(part.alias("part")).agg(F.min(F.struct("o", "h")).alias("m")).select("part", "m.o", "m.h").orderBy("part").collect()  # a row a range
    after = spark.createDataFrame([(firsts[i - 1]["part"], r["o"], r["h"]) for i, r in enumerate(firsts)], "part int, _o long, _h long")  # wraps to the last range
    tails = rows.join(F.broadcast(after), (F.col("o") == F.col("_o")) & (F.col("h") == F.col("_h"))).groupBy("part").agg(F.first("text").alias("text"))
    dealt = rows.select(part.alias("part"), F.lit(0).alias("tail"), "o", "h", "doc_id", "text")
    dealt = dealt.unionByName(tails.select("part", F.lit(1).alias("tail"), F.lit(None).cast("long").alias("o"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("doc_id"), "text"))
    return dealt.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "tail", "o", "h").select("part", "tail", "doc_id", "text").mapInArrow(_walk, OUT)


def _walk(batches):
    state = {"part": None}

    def done(nxt_text, nxt_chunks):
        d, text, own = state["held"]
        k = len(text) // 4
        edited = text[: len(text) - k] + nxt_text[:k] if k else text
        ed = own if edited == text else chunks(edited)
        return (d, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), written(own), written(ed), likeness(own, ed), likeness(own, nxt_chunks))

    def flush(out):
        cols = list(zip(*out)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    out, size = [], 0
    for batch in bounded(batches):
        for p, tail, d, t in zip(*(c.to_pylist() for c in batch.columns)):
            if p != state["part"]:
                state = {"part": p, "held": None}
            own = chunks(t)
            if state["held"] is not None:
                out.append(done(t, own))
            state["held"] = None if tail else (d, t, own)
            size += len(t)
            if size > 4_000_000:
                yield flush(out)
                out, size = [], 0
    yield flush(out)
