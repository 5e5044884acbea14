"""N-gram scoring by deleted interpolation.

p(w|h) = l2[b] c(h w)/c(h) + l1[b] c(w)/N + l0[b] / (V+1), where b is the bucket of c(h) by powers of
two. The mixture weights of each bucket come from expectation-maximisation: counts of one part of
the training documents are held against the events of the other, deleted part.

Counting never moves a token. A task cuts its texts into chunks of bounded size and sends each
chunk's distinct n-gram hashes, sorted and cut at fixed points of the hash range, to the task that
owns the range; that task adds up and sends back, for each chunk, the counts in the chunk's own
order. So a frequent word costs one entry a chunk, and no table of the corpus is held anywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import store
from .words import bounded, hashes, mix, split

ODD = np.uint64(0x9E3779B97F4A7C15)
END, BEGIN = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
BUCKETS, STEP, CELLS = 24, 0.5, 160
LEARN, DELETED, TEST = 0, 1, 2


def encode(c: np.ndarray) -> bytes:
    """Counts: a byte each, larger ones in full behind."""
    return np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype("<u8").tobytes()


def decode(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


class Chunk:
    """Tokens of some documents: the words' hashes with one end after each document."""

    def __init__(self, key: str):
        self.key, self.size, self.rows, self.arrays = key, 0, [], []

    def add(self, row: tuple, h: np.ndarray, size: int) -> None:
        self.rows.append((*row, len(h) + 1))
        self.arrays += [h, np.array([END])]
        self.size += size

    def close(self) -> "Chunk":
        self.tokens = np.concatenate(self.arrays)
        self.arrays = []
        n = np.array([r[-1] for r in self.rows])
        self.ends = np.cumsum(n)
        self.starts = self.ends - n
        prev = np.empty_like(self.tokens)
        prev[1:] = self.tokens[:-1]
        prev[self.starts] = BEGIN
        self.fold = np.repeat(np.array([r[1] for r in self.rows], np.int8), n)
        self.words, self.word_of = np.unique(self.tokens, return_inverse=True)
        self.pairs, self.pair_of = np.unique(mix(prev * ODD + self.tokens), return_inverse=True)
        self.before = np.empty_like(self.word_of)  # the preceding token's word; -1 at the beginning
        self.before[1:] = self.word_of[:-1]
        self.before[self.starts] = -1
        self.mark = xxhash.xxh3_64_intdigest(self.words.tobytes(), seed=len(self.tokens)) ^ xxhash.xxh3_64_intdigest(self.pairs.tobytes())
        return self


def chunks(batches, limit: int):
    """Chunks of a task's rows (doc_id, fold, text), in order; deleted documents have chunks of their own."""
    part, table = TaskContext.get().partitionId(), hashes()
    open_, count = {}, {}
    for batch in bounded(batches):
        for d, f, t in zip(*(c.to_pylist() for c in batch.columns)):
            k = int(f == DELETED)
            if k not in open_:
                open_[k] = Chunk(f"{part}-{k}-{count.get(k, 0)}")
                count[k] = count.get(k, 0) + 1
            open_[k].add((d, f), table.of(split(t)), len(t or ""))
            if open_[k].size >= limit:
                yield open_.pop(k).close()
    for k in sorted(open_):
        yield open_[k].close()


SENT = "bucket int, chunk string, wh binary, wa binary, wb binary, ph binary, pa binary, pb binary"
BACK = "chunk string, bucket int, nw long, np long, wc binary, wa binary, pc binary, pa binary, v long, n long, va long, na long"


def _send(limit: int, nb: int):
    def run(batches):
        cut = (np.arange(1, nb, dtype=np.uint64) * np.uint64((1 << 64) // nb)).astype(np.uint64)
        for c in chunks(batches, limit):
            cuts = {x: np.array([0, *np.searchsorted(uniq, cut).tolist(), len(uniq)]) for x, uniq in (("w", c.words), ("p", c.pairs))}
            some = np.flatnonzero((np.diff(cuts["w"]) > 0) | (np.diff(cuts["p"]) > 0)).tolist()  # empty ranges aren't sent
            out = {"bucket": some, "chunk": [c.key] * len(some)}
            for x, uniq, of in (("w", c.words, c.word_of), ("p", c.pairs, c.pair_of)):
                at = cuts[x].tolist()
                count = [np.bincount(of[c.fold == f], minlength=len(uniq)) for f in (LEARN, DELETED)]
                out[x + "h"] = [uniq[at[i] : at[i + 1]].tobytes() for i in some]
                for name, n in zip("ab", count):
                    out[x + name] = [encode(n[at[i] : at[i + 1]]) for i in some]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), *((k, pa.binary()) for k in ("wh", "wa", "wb", "ph", "pa", "pb"))]))

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Add up one range of the hashes over all chunks, and answer each chunk in its order."""
    out = {"chunk": pdf["chunk"].tolist(), "bucket": pdf["bucket"].tolist()}
    scalars = []
    for x in "wp":
        hs = [np.frombuffer(b, np.uint64) for b in pdf[x + "h"]]
        n = [len(h) for h in hs]
        uniq, of = np.unique(np.concatenate(hs), return_inverse=True)
        tot = []
        for name in "ab":
            each = np.concatenate([decode(b, k) for b, k in zip(pdf[x + name], n)])
            total = np.zeros(len(uniq), np.int64)
            np.add.at(total, of, each)
            tot.append(total)
        a, c = tot[0], tot[0] + tot[1]
        if x == "w":
            scalars = [int((c > 0).sum()), int(c.sum()), int((a > 0).sum()), int(a.sum())]
        at = np.cumsum([0, *n])
        out["n" + x] = n
        out[x + "c"] = [encode(c[of[i:j]]) for i, j in zip(at, at[1:])]
        out[x + "a"] = [encode(a[of[i:j]]) for i, j in zip(at, at[1:])]
    for k, name in enumerate(("v", "n", "va", "na")):  # once for the range
        out[name] = [scalars[k]] + [0] * (len(pdf) - 1)
    return pd.DataFrame(out)[[c.split()[0] for c in BACK.split(", ")]]


def _answers(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        key = pdf["chunk"].iloc[0]
        arrays = [np.concatenate([decode(b, k) for b, k in zip(pdf[x + name], pdf["n" + x])]) for x in "wp" for name in "ca"]
        data = [encode(a) for a in arrays]
        head = np.array([len(arrays[0]), len(arrays[2]), *map(len, data)], "<u8").tobytes()
        with store.Target(f"{folder}/{key}.bin") as f:
            f.write(head + b"".join(data))
        return pd.DataFrame({"chunk": [key]})

    return run


def _answer(folder: str, c: Chunk) -> list[np.ndarray]:
    """Counts of a chunk's words and pairs: all training, then without the deleted part."""
    with store.opened(f"{folder}/{c.key}.bin") as f:
        head = np.frombuffer(f.read(48), "<u8").tolist()
        if head[:2] != [len(c.words), len(c.pairs)]:
            raise RuntimeError(f"chunk {c.key} changed between two scans; write the input to a table first")
        return [decode(f.read(size), n) for size, n in zip(head[2:], (head[0], head[0], head[1], head[1]))]


def _level(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c.astype(np.float64))[1], BUCKETS - 1)


def _parts(c: Chunk, words: np.ndarray, pairs: np.ndarray, starts: int, n: int):
    """Context counts, p2 and p1 of each token. The beginning's count is the number of documents."""
    ctx = np.where(c.before < 0, starts, words[c.before])
    p2 = pairs[c.pair_of] / np.maximum(ctx, 1)
    return ctx, p2, words[c.word_of] / max(n, 1)


def _events(folder: str, limit: int, n: int, v: int, starts: int):
    """Events of the deleted part by bucket and by log2 of p2 and p1 over p0; -1 where it is zero."""

    def run(batches):
        total: dict[int, int] = {}
        for c in chunks(batches, limit):
            _, wa, _, pa_ = _answer(folder, c)
            ctx, p2, p1 = _parts(c, wa, pa_, starts, n)
            cell = lambda p: np.where(p > 0, np.clip(np.round(np.log2(np.maximum(p, 1e-300) * (v + 1)) / STEP) + 40, 0, CELLS - 1), -1).astype(np.int64) + 1
            code = (_level(ctx) * (CELLS + 1) + cell(p2)) * (CELLS + 1) + cell(p1)
            for k, m in zip(*(x.tolist() for x in np.unique(code, return_counts=True))):
                total[k] = total.get(k, 0) + m
        yield pa.RecordBatch.from_pydict({"code": pa.array(list(total), pa.int64()), "events": pa.array(list(total.values()), pa.int64())})

    return run


def expectation_maximisation(code: np.ndarray, events: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (l2, l1, l0) of each bucket. A bucket without events takes those of the one below."""
    level, rest = code // (CELLS + 1) ** 2, code % (CELLS + 1) ** 2
    value = lambda x: np.where(x > 0, 2.0 ** ((x - 1 - 40) * STEP), 0.0)
    p = np.stack([value(rest // (CELLS + 1)), value(rest % (CELLS + 1)), np.ones(len(code))], 1)
    out, last = np.empty((BUCKETS, 3)), np.array([0.0, 0.9, 0.1])
    for b in range(BUCKETS):
        own = level == b
        if own.any():
            last = np.array([0.4, 0.4, 0.2])
            for _ in range(rounds):
                g = p[own] * last
                last = (g / g.sum(1, keepdims=True) * events[own, None]).sum(0) / events[own].sum()
            last = (last + 1e-9) / (last + 1e-9).sum()
        out[b] = last
    return out


def folds(doc_id: Column, modulus: int = 7, test: int = 2, deleted: int = 3) -> Column:
    """Remainder of crc32(doc_id as text): test is never learned from, deleted trains the weights. A
    null doc_id counts as test."""
    r = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(test))
    return F.when(r == test, TEST).when(r == deleted, DELETED).otherwise(LEARN).cast("int")


def score(docs: DataFrame, folder: str, chunk_chars: int = 6_000_000, range_bytes: int = 8 << 20, is_table: bool = False) -> DataFrame:
    """Score whole texts of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end; a null or empty text is the
    end alone. Base: add-one unigrams. Repeated rows count each in training and are scored each; a
    null doc_id is scored, not learned from. An empty table gives no rows; without training
    documents N and V are 0 and every token has probability 1. Other columns are not read.

    Texts are scanned three times (the second scan reads the deleted part alone) and never shuffled.
    The scans must see the same rows in the same tasks: ``is_table`` says that ``docs`` is a scan of
    files; anything else is written to ``folder`` first. A chunk whose n-grams changed is an error.
    The hash range is cut so that about ``range_bytes`` of text stand behind each part, whatever the number
    of shuffle partitions: a part is what one task holds at once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not is_table:
        rows = store.saved(rows, f"{folder}/texts")
    rows = rows.select("doc_id", folds(F.col("doc_id")).alias("fold"), "text")
    starts = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}  # three rows
    learn, deleted = (starts[f]["n"] if f in starts else 0 for f in (LEARN, DELETED))
    ranges = max(store.parts(spark), -(-sum(r["bytes"] or 0 for r in starts.values()) // range_bytes))
    sent = rows.mapInArrow(_send(chunk_chars, ranges), SENT)
    back = store.saved(sent.groupBy("bucket").applyInPandas(_merge, BACK), f"{folder}/back")
    v, n, va, na = (int(x or 0) for x in back.agg(*(F.sum(c) for c in ("v", "n", "va", "na"))).first())
    answers = f"{folder}/answers"
    store.make(answers)
    store.saved(back.groupBy("chunk").applyInPandas(_answers(answers), "chunk string"), f"{folder}/gathered")
    hist = rows.where(F.col("fold") == DELETED).mapInArrow(_events(answers, chunk_chars, na, va, learn), "code long, events long")
    hist = hist.groupBy("code").agg(F.sum("events").alias("events")).toPandas()  # at most BUCKETS * (CELLS + 1)^2 rows
    weights = expectation_maximisation(hist["code"].to_numpy(), hist["events"].to_numpy())

    def run(batches):
        for c in chunks(batches, chunk_chars):
            wc, _, pc, _ = _answer(answers, c)
            ctx, p2, p1 = _parts(c, wc, pc, learn + deleted, n)
            level = _level(ctx)
            p2 *= weights[level, 0]
            p1 *= weights[level, 1]
            p = p2 + p1 + weights[level, 2] / (v + 1)
            if not n:
                p = np.ones(len(p))
            known = (wc > 0)[c.word_of]
            base = np.log10((wc + 1) / (n + v + 1))[c.word_of]
            add = lambda x: np.add.reduceat(x, c.starts)
            m = len(c.rows)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r[0] for r in c.rows], pa.int64()), "held_out": [r[1] == TEST for r in c.rows],
                "n_tokens": pa.array(c.ends - c.starts, pa.int64()), "n_known": pa.array(add(known.astype(np.int64)), pa.int64()),
                "train_tokens": pa.array([n] * m, pa.int64()), "base_score": add(base), "score": add(np.log10(p)),
            })

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
