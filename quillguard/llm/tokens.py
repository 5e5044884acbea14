"""Token ids of whole texts, and their file format: fixed-width bit packing with block offsets.

File layout (little-endian): magic ``QGBP``, u8 width, u32 ids a block; the blocks, each packed by
itself and byte-aligned; then the index: u64 byte offset of each block, and for each document
u8 has-id, i64 doc_id, u64 first id, u64 number of ids; last u64 block count, u64 document count,
u64 id count, u64 index offset. A block unpacks without its neighbours, so any range of ids is read
by seeking to its first block.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import store
from .words import bounded, held

MAGIC = b"QGBP"


class Encoder:
    """The tokenizers library on whole texts, each white-space-bounded word once while it is remembered.

    The vocabulary's normaliser turns white space to a blank and its pre-tokenizer drops it, so a
    text's ids are its words' ids in a row (tests hold this against whole texts). Words are kept in
    two generations of at most ``limit``, so those that go on occurring stay.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.limit, self.known, self.old = Tokenizer.from_file(path), limit, {}, {}
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        mark = self.tok.encode("|", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        data = (text or "").encode("utf-8", "replace")
        words = (data if b"<|" in data else data.lower()).split()
        if new := set(words).difference(self.known):
            if len(self.known) + len(new) > self.limit:
                self.old, self.known = self.known, {}
                new = set(words)
            self._learn(new)
        return b"".join(map(self.known.__getitem__, words))

    def _learn(self, new: set[bytes]) -> None:
        """A mark after an ASCII letter or digit is a piece of its own, so such words share their stem."""
        known, old, ended, stems = self.known, self.old, [], set()
        for w in new:
            if (ids := old.get(w)) is not None:
                known[w] = ids
            elif w[-1] in b".,!" and w[-2:-1].isalnum():
                ended.append(w)
                stems.add(w[:-1])
                stems.add(w[-1:])
            else:
                stems.add(w)
        for w in [w for w in stems if w not in known and w in old]:
            known[w] = old[w]
        stems = [w for w in stems if w not in known]
        if self.mark is None:
            odd, stems = stems, []
        else:
            odd, stems = [w for w in stems if b"|" in w], [w for w in stems if b"|" not in w]
        for i in range(0, len(stems), 256):
            # words with a mark between: one call for many, cut at the mark's id
            some = stems[i : i + 256]
            ids = np.array(self.tok.encode(" | ".join([w.decode() for w in some]), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(some) - 1:
                odd += some
                continue
            data = ids.tobytes()
            for w, a, b in zip(some, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(data)]):
                known[w] = data[a:b]
        for i in range(0, len(odd), 4096):
            some = odd[i : i + 4096]
            for w, e in zip(some, self.tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()
        for w in ended:
            known[w] = known[w[:-1]] + known[w[-1:]]


def encoder(path: str) -> Encoder:
    """The worker's own encoder; Spark reuses workers, so later tasks find its table filled."""
    return held(("encoder", path), lambda: Encoder(path))


def vocabulary_bits(path: str) -> int:
    """Minimum number of bits that hold every id of the vocabulary."""
    return max(1, (encoder(path).vocab - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


class Writer:
    def __init__(self, file, width: int, block: int):
        self.file, self.width, self.block = file, width, block
        self.at = file.write(head := MAGIC + struct.pack("<BI", width, block)) or len(head)
        self.at = len(head)
        self.left, self.left_n, self.n, self.offsets, self.docs = [], 0, 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id is not None, doc_id or 0, self.n, len(ids)))
        self.n += len(ids)
        self.left.append(ids)
        self.left_n += len(ids)
        if self.left_n >= 64 * self.block:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids = np.concatenate(self.left) if self.left else np.empty(0, np.uint32)
        full = len(ids) if end else len(ids) // self.block * self.block
        for i in range(0, full, self.block):
            data = pack(ids[i : min(full, i + self.block)], self.width)
            self.file.write(data)
            self.offsets.append(self.at)
            self.at += len(data)
        self.left, self.left_n = [ids[full:]], len(ids) - full

    def close(self) -> int:
        self._flush(True)
        d = np.array(self.docs, dtype=[("has", "u1"), ("id", "<i8"), ("start", "<u8"), ("n", "<u8")])
        self.file.write(np.array(self.offsets, "<u8").tobytes() + d.tobytes() + struct.pack("<QQQQ", len(self.offsets), len(d), self.n, self.at))
        return self.n


class Reader:
    """Random access to a file's ids; holds its index, not its blocks."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(0)
        head = file.read(9)
        if head[:4] != MAGIC:
            raise ValueError("not a packed token file")
        self.width, self.block = struct.unpack("<BI", head[4:])
        file.seek(end - 32)
        blocks, docs, self.n, self.end = struct.unpack("<QQQQ", file.read(32))
        file.seek(self.end)
        data = file.read(end - 32 - self.end)
        self.offsets = np.append(np.frombuffer(data, "<u8", blocks), np.uint64(self.end))
        self.docs = np.frombuffer(data, [("has", "u1"), ("id", "<i8"), ("start", "<u8"), ("n", "<u8")], docs, blocks * 8)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n, from the blocks that hold them alone."""
        if not n:
            return np.empty(0, "<u4")
        a, b = start // self.block, (start + n - 1) // self.block
        self.file.seek(int(self.offsets[a]))
        data = self.file.read(int(self.offsets[b + 1] - self.offsets[a]))
        at = [int(x - self.offsets[a]) for x in self.offsets[a : b + 2]]
        out = [unpack(data[at[i] : at[i + 1]], min(self.block, self.n - (a + i) * self.block), self.width) for i in range(b - a + 1)]
        return np.concatenate(out)[start - a * self.block :][:n]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, width: int | None = None, block: int = 8192, files: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write one file for each range of doc_id.

    Files hold documents in ascending doc_id order (null ids first, ties by text) and follow each
    other in that order. A null text is empty: its ids are the end id alone. Other columns are not
    read. An empty table gives no files. Returns the manifest (part, path, n_docs, n_ids).

    One range shuffle of the texts; memory is that of one block buffer and one file's index.
    """
    spark = docs.sparkSession
    width = width or max(vocabulary_bits(tokenizer), int(end_id).bit_length())

    def run(batches):
        part, enc, out, n = TaskContext.get().partitionId(), None, None, 0
        path = f"{folder}/tokens-{part:06d}.bin"
        batches = bounded(batches)
        first = next(batches, None)
        if first is None:
            return
        enc = encoder(tokenizer)
        with store.Target(path) as file:
            out = Writer(file, width, block)
            while first is not None:
                for i, t in zip(first.column(0).to_pylist(), first.column(1).to_pylist()):
                    out.add(i, np.append(np.frombuffer(enc.ids(t), "<u4"), np.uint32(end_id)))
                    n += 1
                first = next(batches, None)
            total = out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(files or store.parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return store.saved(rows.mapInArrow(run, "part int, path string, n_docs long, n_ids long"), f"{folder}/manifest")


def read(spark, manifest: DataFrame) -> DataFrame:
    """Read the files back: (doc_id, start, n_tokens, ids_crc32), start counted over all files.

    The manifest has a row for each file; the files' first positions are its running sum.
    """
    files, base = [], 0
    for r in manifest.orderBy("part").collect():  # one row a file
        files.append((r.path, base))
        base += r.n_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.opened(path) as file:
                    r = Reader(file)
                    d, i = r.docs, 0
                    while i < len(d):
                        j = max(i + 1, int(np.searchsorted(d["start"], d["start"][i] + np.uint64(1 << 20))))
                        lo, hi = int(d["start"][i]), int(d["start"][j - 1] + d["n"][j - 1])
                        ids = r.ids(lo, hi - lo)
                        some = d[i:j]
                        crc = [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip((some["start"] - np.uint64(lo)).tolist(), some["n"].tolist())]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(some["id"].tolist(), pa.int64(), mask=some["has"] == 0),
                            "start": pa.array(some["start"].astype(np.int64) + base, pa.int64()),
                            "n_tokens": pa.array(some["n"].astype(np.int64), pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        })
                        i = j

    paths = spark.createDataFrame(files, "path string, base long").repartition(max(1, min(len(files), 4 * store.parts(spark))))
    return paths.mapInArrow(run, schema)
