"""Language identification by interpolated Kneser-Ney character models, one for each language.

All languages share, for each order, one sorted array of n-gram hashes with a column a language: the
n-gram's discounted share of its context, and the mass that it hands on as a context itself. So a
character costs one search an order, whatever the number of languages.
"""

from __future__ import annotations

import math
import re
import uuid
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import store
from .words import bounded, held, mix

ORDER, LEAST, MOST = 5, 0.1, 0.95
ODD = np.uint64(0x9E3779B97F4A7C15)
LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"


def letter_words(text: str) -> list[str]:
    """Runs of letters, lower-cased; a run of numerals alone is none."""
    words = LETTERS.findall(text.lower())
    return words if text.isascii() else [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words with a blank at both ends, in a row. For each character: the word it ends or stands in, its
    place in it (0 is the first blank), and for each order n the hash of the n characters that
    end there; 0 where these would begin before the word does."""
    s = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    blank = np.flatnonzero(s == 32)
    at = np.arange(len(s))
    # a blank ends one word and begins the next; here it ends
    owner = np.searchsorted(blank, at, "left") - 1
    place = at - blank[np.maximum(owner, 0)]
    out, h = [], np.zeros(len(s), np.uint64)
    for n in range(1, ORDER + 1):
        h = mix(h + (s[np.maximum(at - (n - 1), 0)] + np.uint64(1)) * ODD + np.uint64(n))
        out.append(np.where(place >= n - 1, h, np.uint64(0)))
    return owner, place, out


def _before(row: np.ndarray) -> np.ndarray:
    """For each character what the one before it has."""
    out = np.full_like(row, -1)
    out[1:] = row[:-1]
    return out


def fit(words: list[str], counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One language from its distinct words and their counts: for each order the sorted hashes of its
    n-grams, their shares, and what they hand on as contexts (1 where they never are one); first
    of all what the empty context hands on.

    The highest order counts occurrences, lower ones distinct characters to the left; an n-gram at a
    word's start has none, so it counts occurrences. The discount of an order is n1 / (n1 + 2 n2).
    """
    owner, place, g = grams(words)
    w = np.where(owner >= 0, np.asarray(counts, np.int64)[np.maximum(owner, 0)], 0)
    tables, rows = [], []
    for n in range(1, ORDER + 1):
        use = (g[n - 1] != 0) & (place > 0)
        keys, first, of = np.unique(g[n - 1][use], return_index=True, return_inverse=True)
        row = np.full(len(owner), -1)
        row[use] = of
        if n == ORDER:
            c = np.bincount(of, weights=w[use], minlength=len(keys))
        else:
            wider = (g[n] != 0) & (place > 0)
            one = np.flatnonzero(wider)[np.unique(g[n][wider], return_index=True)[1]]
            c = np.bincount(row[one], minlength=len(keys)).astype(float)
            starts = use & (place == n - 1)  # these begin with the first blank
            c += np.bincount(row[starts], weights=w[starts], minlength=len(keys))
        if n == 1:
            rows.append(row.copy())
            rows[0][0] = np.flatnonzero(keys == g[0][0])[0] if (keys == g[0][0]).any() else -1
            ctx = np.zeros(len(keys), np.int64)
        else:
            ctx = _before(rows[-1])[np.flatnonzero(use)[first]]
            rows.append(row)
        size = len(tables[-1][0]) if n > 1 else 1
        total, kinds = np.bincount(ctx, weights=c, minlength=size), np.bincount(ctx, minlength=size)
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = min(MOST, max(LEAST, n1 / max(1, n1 + 2 * n2)))
        back = np.where(kinds > 0, d * kinds / np.maximum(total, 1), 1.0)
        if n == 1:
            empty = back
        else:
            tables[-1][2][:] = back
        tables.append((keys, (c - d) / total[ctx], np.ones(len(keys))))
    return [(np.empty(0, np.uint64), np.empty(0), empty), *tables]


class Scorer:
    """All languages' models in one, and their calibration. Memory: 16 bytes for each n-gram of any
    language and each language."""

    def __init__(self, models: dict[str, list]):
        self.langs, self.mark = sorted(models), uuid.uuid4().hex
        self.scale, self.reject_at, self.place, self.spread = 1.0, math.inf, {}, {}
        self.keys, self.share, self.back = [], [], []
        n = len(self.langs)
        for k in range(1, ORDER + 1) if n else ():
            keys = np.unique(np.concatenate([models[x][k][0] for x in self.langs]))
            share, back = np.zeros((len(keys) + 1, n)), np.ones((len(keys) + 1, n))  # the last row: not found
            for i, x in enumerate(self.langs):
                at = np.searchsorted(keys, models[x][k][0])
                share[at, i], back[at, i] = models[x][k][1], models[x][k][2]
            self.keys.append(keys), self.share.append(share), self.back.append(back)
        self.empty = np.array([models[x][0][2][0] for x in self.langs])
        self.floor = 1.0 / (len(self.keys[0]) + 256) if n else 1.0

    def logp(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log p by language, and the number of characters predicted (a word's end is one)."""
        owner, place, g = grams(words)
        p = np.broadcast_to(self.floor * self.empty, (len(owner), len(self.langs)))
        ctx = None
        for n in range(ORDER):
            keys = self.keys[n]
            row = np.full(len(owner), -1)
            # a longer n-gram is known only where its end is
            some = np.flatnonzero(g[n] != 0) if ctx is None else np.flatnonzero((g[n] != 0) & (last >= 0))
            at = np.minimum(np.searchsorted(keys, g[n][some]), len(keys) - 1)
            hit = keys[at] == g[n][some]
            row[some[hit]] = at[hit]
            if ctx is None:
                p = self.share[0][row] + p
            else:
                p = self.share[n][row] + self.back[n - 1][np.where(g[n] != 0, ctx, -1)] * p
            ctx, last = _before(row), row
        of = owner[1:]
        logs = np.log(p[1:])
        sums = np.stack([np.bincount(of, weights=logs[:, i], minlength=len(words)) for i in range(len(self.langs))], 1)
        return sums, np.bincount(of, minlength=len(words))

    def decide(self, totals: np.ndarray) -> list[tuple]:
        """(lang, score, cross-entropy, rejected) of each text. The score is the best language's
        posterior at the calibrated temperature."""
        out = []
        for row in totals:
            n = row[-1]
            if not n or not self.langs:
                out.append((UND, 0.0, None, True))
                continue
            ce = -row[:-1] / n
            best = int(ce.argmin())
            z = np.exp(np.maximum(-(ce - ce[best]) * self.scale * math.sqrt(n), -700))
            out.append((self.langs[best], float(1 / z.sum()), float(ce[best]), bool(self.strange(ce[best], n, self.langs[best]) > self.reject_at)))
        return out

    def strange(self, ce: float, n: float, lang: str) -> float:
        """Cross-entropy above the language's usual one, in units of its spread, which falls with the root
        of the text's length down to that of the text as a whole."""
        if lang not in self.place:
            return 0.0
        return (ce - self.place[lang]) / (self.spread[lang] * math.sqrt(1 + TYPICAL / n))


#: Characters at which half of a cross-entropy's variance comes from the text's shortness.
TYPICAL = 200


class Table:
    """A worker's rows of log p by language and number of characters, for words seen lately: two
    generations of at most ``limit`` words, so that words that go on occurring stay."""

    def __init__(self, scorer: Scorer, limit: int = 100_000):
        self.scorer, self.limit = scorer, limit
        self.young, self.old = {}, {}
        self.rows = self.old_rows = np.zeros((0, len(scorer.langs) + 1))
        self.n = 0

    def _add(self, words: list[str], rows: np.ndarray) -> None:
        if self.n + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows[: self.n], np.zeros((max(4096, self.n // 2) + len(words), rows.shape[1]))])
        self.rows[self.n : self.n + len(words)] = rows
        self.young.update(zip(words, range(self.n, self.n + len(words))))
        self.n += len(words)

    def _learn(self, missing: set[str]) -> None:
        if len(self.young) + len(missing) > self.limit and self.young:
            self.old, self.old_rows, self.young = self.young, self.rows[: self.n], {}
            self.rows, self.n = np.zeros((0, self.rows.shape[1])), 0
        again = [w for w in missing if w in self.old]
        if again:
            self._add(again, self.old_rows[[self.old[w] for w in again]])
        new = list(missing.difference(again)) if again else list(missing)
        for k in range(0, len(new), 8192):
            some = new[k : k + 8192]
            sums, n = self.scorer.logp(some)
            self._add(some, np.concatenate([sums, n[:, None]], 1))

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """For each text: summed log p by language, and the number of characters scored."""
        out = np.zeros((len(texts), len(self.scorer.langs) + 1))
        if not self.scorer.langs:
            return out
        k = 0
        while k < len(texts):
            lists, size = [], 0
            while k + len(lists) < len(texts) and (size < 60_000 or not lists):
                lists.append(letter_words(texts[k + len(lists)] or ""))
                size += len(lists[-1])
            words = [w for x in lists for w in x] if len(lists) > 1 else lists[0]
            at = np.fromiter(map(self.young.get, words, repeat(-1)), np.int64, len(words))
            lost = np.flatnonzero(at < 0)
            if len(lost):
                before = self.young
                self._learn({words[i] for i in lost.tolist()})
                if self.young is not before:  # a generation ended
                    known, rows = before, self.old_rows
                    keep = np.flatnonzero(at >= 0)
                    vals = np.empty((len(words), out.shape[1]))
                    vals[keep] = rows[at[keep]]
                    vals[lost] = self.rows[[self.young[words[i]] for i in lost.tolist()]]
                else:
                    at[lost] = [self.young[words[i]] for i in lost.tolist()]
                    vals = self.rows[at]
            else:
                vals = self.rows[at]
            n = np.array([len(x) for x in lists])
            some = np.flatnonzero(n)
            if len(some):
                starts = np.cumsum(n) - n
                out[k + some] = np.add.reduceat(vals, starts[some])
            k += len(lists)
        return out


def folds(doc_id: Column, modulus: int = 4) -> Column:
    """Remainder of crc32(doc_id as text); null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % modulus).cast("int")


def _counted(batches):
    """(lang, word, n) of a task's texts; flushed where a task has many distinct words."""
    have: dict[tuple[str, str], int] = {}

    def flush():
        keys = list(zip(*have)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.binary()), pa.array(list(have.values()), pa.int64())], ["lang", "word", "n"])

    for b in bounded(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for w in letter_words(text):
                k = lang, w.encode("utf-8", "surrogatepass")
                have[k] = have.get(k, 0) + 1
            if len(have) > 200_000:
                yield flush()
                have.clear()
    yield flush()


def _fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    """The model of one language's words, in a row for each order."""
    pdf = pdf.sort_values("word")
    model = fit([w.decode("utf-8", "surrogatepass") for w in pdf["word"]], pdf["n"].to_numpy())
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": range(len(model)), "keys": [x[0].tobytes() for x in model], "share": [x[1].tobytes() for x in model], "back": [x[2].tobytes() for x in model]})


def train(docs: DataFrame, test: int = 2, per_language: int = 1500, calibrate: int = 1000, false_reject: float = 0.001) -> Scorer:
    """Fit on a bounded sample of the labelled documents of ``docs`` (doc_id, lang, text) whose fold is
    not ``test``: of each language about ``per_language`` whole documents make its model and about
    ``calibrate`` others calibrate it, chosen by the lowest hashes of doc_id; where there are fewer, they
    are shared out in this proportion. Null lang, text or doc_id, and texts without a letter, are not
    learned from. With no labelled document the scorer knows no language.

    Words are counted and models fitted in executors; the models come to the driver, and so does one
    row of numbers for each calibration document.

    Calibration: the temperature minimises the calibration documents' log loss with Platt's smoothed
    targets. A text is rejected when its cross-entropy, standardised by language and length, is above
    the conformal quantile that a share ``false_reject`` of known documents exceeds; where there are too
    few calibration documents for that share, above the largest of theirs and half as much again.
    """
    lab = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    lab = lab.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(folds(F.col("doc_id")) != test)
    count = {r["lang"]: r["count"] for r in lab.groupBy("lang").count().collect()}  # a row a language
    if not count:
        return Scorer({})
    spark, both = store.prepare(docs.sparkSession), per_language + calibrate
    share = F.try_element_at(F.create_map(*(F.lit(x) for lang, n in sorted(count.items()) for x in (lang, min(1.0, both / n)))), F.col("lang"))
    h = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    some = lab.where(h < share).select("lang", "text", (h < share * (per_language / both)).alias("model"))
    words = some.where("model").select("lang", "text").mapInArrow(_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    models: dict[str, list] = {}
    for r in words.groupBy("lang").applyInPandas(_fitted, "lang string, k int, keys binary, share binary, back binary").collect():  # ORDER + 1 rows a language
        models.setdefault(r["lang"], [None] * (ORDER + 1))[r["k"]] = tuple(np.frombuffer(r[c], t) for c, t in (("keys", np.uint64), ("share", float), ("back", float)))
    out = Scorer(models)
    if not models:
        return out
    shared = spark.sparkContext.broadcast(out)

    def scored(batches):
        table = held(("langid", shared.value.mark), lambda: Table(shared.value))
        for b in bounded(batches):
            got = table.totals(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.tolist(), pa.list_(pa.float64()))], ["lang", "totals"])

    seen = some.where(~F.col("model")).select("lang", "text").mapInArrow(scored, "lang string, totals array<double>").collect()  # about `calibrate` rows a language
    own: dict[str, list[tuple[float, float]]] = {}
    gaps = []
    for lang, totals in seen:
        if lang in models and totals[-1]:
            t = np.array(totals)
            ce, i = -t[:-1] / t[-1], out.langs.index(lang)
            own.setdefault(lang, []).append((float(ce[i]), t[-1]))
            gaps.append((ce - ce.min(), i, math.sqrt(t[-1])))
    out.scale = temperature(gaps)
    for lang, v in own.items():
        out.place[lang] = float(np.median([c for c, _ in v]))
        out.spread[lang] = max(1e-3, 1.4826 * float(np.median([abs(c - out.place[lang]) / math.sqrt(1 + TYPICAL / n) for c, n in v])))
    strange = sorted(out.strange(c, n, lang) for lang, v in own.items() for c, n in v)
    rank = math.ceil((len(strange) + 1) * (1 - false_reject))
    if strange:
        out.reject_at = strange[rank - 1] if rank <= len(strange) else max(8.0, 1.5 * strange[-1])
    shared.unpersist()
    return out


def temperature(gaps: list[tuple[np.ndarray, int, float]]) -> float:
    """The factor on (cross-entropy gap times root of the length) with the least log loss against
    targets smoothed by one count; the loss is convex, so a golden section finds it."""
    if not gaps:
        return 1.0
    z = np.stack([g * r for g, _, r in gaps])
    n, k = z.shape
    target = np.full(z.shape, (1 / (n + 2)) / max(1, k - 1))
    target[np.arange(n), [i for _, i, _ in gaps]] = (n + 1) / (n + 2)

    def loss(log_scale):
        s = z * math.exp(log_scale)
        return float((np.log(np.exp(-np.minimum(s, 700)).sum(1)) + (target * s).sum(1)).sum())

    low, high, g = -10.0, 10.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def predict(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy, rejected (columns of these names are replaced).

    Whole texts; a text that is null or has no letter is ``und`` with score 0 and rejected. With no
    labelled document at all every text is ``und``. Repeated rows get the same answer; an empty table
    gives no rows. lang, source and doc_id are carried, never looked at. Work per text is one lookup
    for each word: the models look back no further than a word's start.
    """
    names = ["lang_pred", "score", "cross_entropy", "rejected"]
    kept = [c for c in docs.columns if c not in names]
    at = kept.index("text")
    shared = store.prepare(docs.sparkSession).sparkContext.broadcast(scorer)  # bounded by per_language and the number of languages

    def run(batches):
        s = shared.value
        table = held(("langid", s.mark), lambda: Table(s))
        for batch in bounded(batches):
            got = list(zip(*s.decide(table.totals(batch.column(at).to_pylist())))) or [()] * 4
            cols = [pa.array(c, t) for c, t in zip(got, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("rejected", "boolean")
    return docs.select(*kept).mapInArrow(run, schema)


def known(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of ``docs``, all columns, that the scorer does not reject (see ``predict``)."""
    at = docs.columns.index("text")
    shared = store.prepare(docs.sparkSession).sparkContext.broadcast(scorer)

    def run(batches):
        s = shared.value
        table = held(("langid", s.mark), lambda: Table(s))
        for batch in bounded(batches):
            keep = [not x[3] for x in s.decide(table.totals(batch.column(at).to_pylist()))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
