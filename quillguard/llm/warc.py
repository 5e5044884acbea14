"""WARC archives with a capture index that is merged externally.

Every writing task makes archives and, beside them, sorted runs of captures by (URL key, timestamp,
page id). Runs are merged by a loser tree, key range by key range, into a globally ordered history.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import store
from .words import bounded

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort key of a URL: scheme and ``www`` dropped, host labels reversed, then path and query."""
    m = re.match(r"(?s)[^:]*://([^/?#]*)([^#]*)", url or "")
    if not m:
        return url or ""
    host = m[1].lower().split(":")[0].removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def record(kind: str, page_id: int | None, url: str | None, stamp: int, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One record, compressed as a member of its own. A revisit has no payload but its length and digest."""
    d = f"{stamp:014d}"
    when = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"
    safe = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {stamp} {digest} {url}')}>", f"WARC-Date: {when}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers}", "WARC-Truncated: length"]
        payload = b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return gzip.compress(VERSION + "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + http + payload + b"\r\n\r\n", 1, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one compressed record."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0].encode() + b"\r\n" != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


# --- runs: sorted captures, with the key of every SPARSE-th one at the end -------------------------

SPARSE = 256
Entry = tuple  # (url key, timestamp, has id, page id, archive, offset, length)


def _dump(e: Entry) -> bytes:
    key, path = e[0].encode("utf-8", "surrogatepass"), e[4].encode()
    return struct.pack("<IqBqIQI", len(key), e[1], e[2], e[3], len(path), e[5], e[6]) + key + path


def write_run(uri: str, entries) -> int:
    """Write sorted entries as they come; only the sparse index is held. Returns their number."""
    sparse, at, n = [], 0, 0
    with store.Target(uri) as f:
        for e in entries:
            data = _dump(e)
            if n % SPARSE == 0:
                sparse.append((at, _dump(e)))
            f.write(data)
            at += len(data)
            n += 1
        for pos, data in sparse:
            f.write(struct.pack("<QI", pos, len(data)) + data)
        f.write(struct.pack("<QQQ", at, len(sparse), n))
    return n


_HEAD = struct.Struct("<IqBqIQI")


def _load(buf: bytes, at: int) -> tuple[Entry, int]:
    nk, stamp, has, page, npath, off, length = _HEAD.unpack_from(buf, at)
    a = at + _HEAD.size
    return (buf[a : a + nk].decode("utf-8", "surrogatepass"), stamp, has, page, buf[a + nk : a + nk + npath].decode(), off, length), a + nk + npath


def sparse_index(uri: str) -> list[tuple[tuple, int]]:
    with store.opened(uri) as f:
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 24)
        at, n, _ = struct.unpack("<QQQ", f.read(24))
        f.seek(at)
        data, pos, out = f.read(end - 24 - at), 0, []
    for _ in range(n):
        where, size = struct.unpack_from("<QI", data, pos)
        out.append((_load(data, pos + 12)[0][:4], where))
        pos += 12 + size
    return [*out, ((), at)]


def read_run(uri: str, start: int, end: int, low: tuple | None, high: tuple | None, buffer: int = 1 << 16):
    """Entries with low <= key < high of the part start..end of a run, through a buffer of bounded size."""
    with store.opened(uri) as f:
        at = start
        f.seek(at)
        buf, pos = b"", 0
        while True:
            if not _whole(buf, pos):
                more = f.read(min(buffer, end - at))
                at += len(more)
                buf, pos = buf[pos:] + more, 0
                if not buf:
                    return
                if not more and not _whole(buf, pos):
                    raise ValueError("a run ends inside an entry")
                if not _whole(buf, pos):
                    continue
            e, pos = _load(buf, pos)
            if low is not None and e[:4] < low:
                continue
            if high is not None and e[:4] >= high:
                return
            yield e


def pieces(index: list[tuple[tuple, int]], cuts: list[tuple]) -> list[tuple[int, int, int]]:
    """(shard, start, end): the parts of a run, given its sparse index, that may hold entries of each
    shard; shards are divided by ``cuts``. Found by bisection, for all shards in one pass."""
    end = index[-1][1]
    keys = [k for k, _ in index[:-1]]
    if not keys:
        return []
    out = []
    # a cut falls behind the last indexed key that is below it
    first = [0, *(max(0, bisect.bisect_left(keys, c) - 1) for c in cuts)]
    last = [*(bisect.bisect_left(keys, c) for c in cuts), len(keys)]
    for shard, (i, j) in enumerate(zip(first, last)):
        if i < j:
            out.append((shard, index[i][1], index[j][1] if j < len(keys) else end))
    return out


def _whole(buf: bytes, pos: int) -> bool:
    if len(buf) - pos < _HEAD.size:
        return False
    h = _HEAD.unpack_from(buf, pos)
    return len(buf) - pos >= _HEAD.size + h[0] + h[4]


def loser_tree(runs: list):
    """Merge sorted iterators. Inner nodes hold the losers of their matches, so the next entry costs
    one comparison a level. Equal keys come out in the order of the runs."""
    k = len(runs)
    if not k:
        return
    runs = [iter(r) for r in runs]
    head = [next(r, None) for r in runs]
    tree = [-1] * k  # tree[0]: the winner

    def beats(a: int, b: int) -> bool:
        x, y = head[a], head[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x[:4], a) < (y[:4], b)

    def play(i: int, at: int) -> None:
        while at > 0:
            if tree[at] == -1:
                tree[at] = i
                return
            if beats(tree[at], i):
                tree[at], i = i, tree[at]
            at //= 2
        tree[0] = i

    for i in range(k):
        play(i, (i + k) // 2)
    while head[w := tree[0]] is not None:
        yield head[w]
        head[w] = next(runs[w], None)
        at, i = (w + k) // 2, w
        while at > 0:
            if beats(tree[at], i):
                tree[at], i = i, tree[at]
            at //= 2
        tree[0] = i


# --- Spark ---------------------------------------------------------------------------------------


def deduplicated(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """``pages`` (page_id, url, html, stamp) with digest, size and refers_to: of rows with equal payloads
    of at least ``least`` bytes that with the smallest page_id is the response."""
    raw = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"), F.col("stamp").cast("long").alias("stamp"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    twice = base.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = store.saved(twice.select(F.col("digest").alias("_d"), "first"), f"{folder}/repeated")
    return base.join(twice, F.col("digest") == F.col("_d"), "left").drop("_d").withColumn("refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first"))).drop("first")


def write(pages: DataFrame, folder: str, archive_bytes: int = 256 << 20, run_rows: int = 200_000) -> DataFrame:
    """Write ``pages`` (page_id, url, html, stamp as yyyyMMddHHmmss number) as WARC records.

    Null html: empty payload. Null url: empty target and key. Null page_id: a response without the
    page's header. Repeated rows are records each; of rows with one page_id and payload all are
    responses. An empty table writes nothing. Other columns are not read. Returns the runs (path, n).
    """

    def run(batches):
        part, k, entries, runs = TaskContext.get().partitionId(), 0, [], []
        target = file = name = None
        at = 0

        def close(error=None):
            nonlocal target, k
            if target is not None:
                target.__exit__(error)
                target, k = None, k + 1

        def flush():
            path = f"{folder}/runs/run-{part:06d}-{len(runs):04d}.bin"
            runs.append((path, write_run(path, iter(sorted(entries)))))
            entries.clear()

        try:
            for batch in bounded(batches):
                for p, u, payload, stamp, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "stamp", "digest", "refers_to"))):
                    if target is None:
                        name, at = f"{folder}/archives/part-{part:06d}-{k:04d}.warc.gz", 0
                        target = store.Target(name)
                        file = target.__enter__()
                    data = record("revisit" if refers is not None else "response", p, u, stamp or 0, payload, digest, refers)
                    file.write(data)
                    entries.append((url_key(u), stamp or 0, int(p is not None), p or 0, name, at, len(data)))
                    at += len(data)
                    if at >= archive_bytes:
                        close()
                    if len(entries) >= run_rows:
                        flush()
        except BaseException as e:
            close(type(e))
            raise
        close()
        if entries:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.string()), pa.array([r[1] for r in runs], pa.int64())], ["path", "n"])

    columns = pages.select("page_id", "url", "payload", "stamp", "digest", "refers_to")
    return store.saved(columns.mapInArrow(run, "path string, n long"), f"{folder}/run-list")


INDEX = "url_key string, stamp long, page_id long, archive string, offset long, length long, shard int, place long"


def merged(spark, runs: DataFrame, folder: str, shard_rows: int = 50_000, max_shards: int = 4096, fan_in: int = 256) -> DataFrame:
    """The captures of all runs in global order: shards follow each other, place counts within one.

    Key ranges are cut at entries of the runs' sparse indexes (one in 256 captures); about 64 keys for
    each of at most ``max_shards`` shards come to the driver. Each run's index is then read once more to
    list the part of it that each shard needs, and a shard's task opens the listed parts alone. It
    merges up to ``fan_in`` at once; more take further passes over intermediate runs. Keys end in
    timestamp and page id, so a URL with a third of all captures is cut as well; merging streams,
    so a shard may be of any size. An empty table has no runs and gives no rows; entries with equal
    keys are all kept, in the order of their runs' paths.
    """
    n, total, blocks = runs.agg(F.count("*"), F.sum("n"), F.sum(F.ceil(F.col("n") / SPARSE))).first()
    if not total:
        return spark.createDataFrame([], INDEX)
    shards = max(1, -(-total // shard_rows), min(store.parts(spark), total // SPARSE))
    shards = min(shards, max_shards)
    every = max(1, blocks // (64 * shards))

    def sample(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                keys = [k for k, _ in sparse_index(path)[:-1]]
                some = keys[zlib.crc32(path.encode()) % every :: every]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["k", "t", "h", "p"])

    paths = runs.select("path").repartition(min(n, 4 * store.parts(spark)), "path")
    keys = sorted(tuple(r) for r in paths.mapInArrow(sample, "k string, t long, h long, p long").collect())  # about 64 a shard
    cuts = sorted({keys[i * len(keys) // shards] for i in range(1, shards)}) if keys else []
    shared = spark.sparkContext.broadcast(cuts)  # at most max_shards keys

    def locate(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                got = pieces(sparse_index(path), shared.value)
                cols = list(zip(*got)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([path] * len(got), pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["shard", "path", "start", "end"])

    def run(batches):
        shard, parts = None, []
        for b in batches:
            for s, path, start, end in zip(*(c.to_pylist() for c in b.columns)):
                if s != shard and parts:
                    yield from _shard(folder, shard, parts, shared.value, fan_in)
                    parts = []
                shard = s
                parts.append((path, start, end))
        if parts:
            yield from _shard(folder, shard, parts, shared.value, fan_in)

    listed = paths.mapInArrow(locate, "shard int, path string, start long, end long")
    listed = listed.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "path")
    return store.saved(listed.mapInArrow(run, INDEX), f"{folder}/history")


def _shard(folder: str, shard: int, todo: list[tuple[str, int, int]], cuts: list[tuple], fan_in: int):
    """One shard's captures in batches, merged from parts of runs."""
    low, high = (cuts[shard - 1] if shard else None), (cuts[shard] if shard < len(cuts) else None)
    level = 0
    while len(todo) > fan_in:
        some = [todo[i : i + fan_in] for i in range(0, len(todo), fan_in)]
        todo = []
        for j, group in enumerate(some):
            path = f"{folder}/merge/shard-{shard:06d}-{level}-{j:05d}.bin"
            write_run(path, loser_tree([read_run(*p, low, high) for p in group]))
            todo.append((path, 0, sparse_index(path)[-1][1]))
        level += 1
    out, place = [], 0
    for e in loser_tree([read_run(*p, low, high) for p in todo]):
        out.append((e[0], e[1], e[3] if e[2] else None, e[4], e[5], e[6], shard, place))
        place += 1
        if len(out) == 20_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(rows):
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    cols = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in INDEX.split(", ")])


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, stamp string, shard int, place long"


def read(history: DataFrame, slice_bytes: int = 8 << 20) -> DataFrame:
    """The records that the history points to, read from the archives by offset and length. A response's
    digest and size are computed from its payload and must equal its headers; a revisit's come from its
    own. A record without page id gives null; an empty history gives no rows; a record listed twice is read twice."""

    def run(pdf):
        import pandas as pd

        out = []
        for path, rows in pdf.groupby("archive", sort=False):
            rows = rows.sort_values("offset")
            with store.opened(path) as f:
                for off, length, shard, place in zip(rows["offset"], rows["length"], rows["shard"], rows["place"]):
                    f.seek(off)
                    head, payload = parse(f.read(length))
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path} at {off}: the payload differs from its header")
                    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                    out.append((page and int(page), size, digest, head["WARC-Type"], refers and int(refers), head["WARC-Target-URI"], head["WARC-Date"], shard, place))
        cols = list(zip(*out)) or [()] * 9
        return pd.DataFrame({c.split()[0]: pd.Series(v, dtype={"long": "Int64", "int": "Int32"}.get(c.split()[1], "object")) for c, v in zip(RECORDS.split(", "), cols)})

    where = history.select("archive", "offset", "length", "shard", "place", F.floor(F.col("offset") / slice_bytes).alias("_s"))
    # the rows are small and the records behind them are not, so the partitions are not left to be merged
    where = where.repartition(4 * store.parts(history.sparkSession), "archive", "_s")
    return where.groupBy("archive", "_s").applyInPandas(run, RECORDS)
