"""Operators on small tables against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillguard.llm import components, covertree, fingerprints, langid, lm, minhash, mixing, packing, queries, store, tokens, urls, warc

WORDS = "the a of red blue stone river cloud old new small great walks runs sings over under house tree bird".split()


def text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


BASE = text(1, 120)
TEXTS = [
    (0, BASE), (1, BASE), (2, BASE.upper()), (3, BASE.replace("stone", "rock", 1)), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "One"), (9, "zwei drei"), (10, "é’🙂 ñandú"),
    (11, text(2, 3000)), (12, text(2, 2990)), (13, text(3, 80)), (14, "x" * 5000), (15, "…"), (16, BASE + " tail"), (None, BASE), (None, None), (11, text(2, 3000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if t else None, None if k % 5 == 0 else f"s{k % 3}", 7, "x") for k, (i, t) in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture
def empty(docs):
    return docs.where("false")


@pytest.fixture
def folder(spark):
    return store.scratch(spark, "test")


def union(edges, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark, folder):
    r = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = components.components(spark.createDataFrame(edges, "u long, v long"), folder)
    want = union(edges, {x for e in edges for x in e})
    assert {x: c for x, c in want.items() if x != c} == {g.u: g.component for g in got.collect()}
    assert components.components(spark.createDataFrame([], "u long, v long"), folder + "/none").count() == 0


# --- 1 ---------------------------------------------------------------------------------------------


def test_loser_tree():
    r = np.random.default_rng(3)
    for k in range(12):
        runs = [sorted((str(a), int(b), 1, int(c), "f", 0, 0) for a, b, c in r.integers(0, 9, (r.integers(0, 15), 3))) for _ in range(k)]
        assert [e[:4] for e in warc.loser_tree(runs)] == sorted(e[:4] for x in runs for e in x)


def test_warc(spark, folder):
    html = ["<p>" + "a" * 200, None, "", "<p>" + "a" * 200, "short", "short", "<p>é" + "b" * 300, "<p>" + "a" * 200]
    rows = [(i if i != 7 else None, None if i == 2 else f"http://www.H{i % 2}.org/p?q={i % 3} x", h, 20240101000000 + i % 2, "extra") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, stamp long, digest string").repartition(3)
    runs = warc.write(warc.deduplicated(pages, folder), folder, archive_bytes=600, run_rows=2)
    history = warc.merged(spark, runs, folder, shard_rows=3, fan_in=2)
    got = warc.read(history).collect()
    assert len(got) == len(rows)
    for i, h in enumerate(html[:7]):
        g = next(x for x in got if x.page_id == i)
        data = (h or "").encode()
        assert (g.payload_bytes, g.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (g.record_type, g.refers_to) == (("revisit", 0) if i == 3 else ("response", None))
    order = [(h.url_key, h.stamp, h.page_id is not None, h.page_id or 0) for h in history.orderBy("shard", "place").collect()]
    assert order == sorted(order) and warc.url_key("https://www.A.b/c?d#e") == "b,a)/c?d"
    nothing = store.scratch(spark, "test")
    assert warc.read(warc.merged(spark, warc.write(warc.deduplicated(pages.where("false"), nothing), nothing), nothing)).count() == 0


def test_pieces_of_a_run(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPARSE", 4)
    r = np.random.default_rng(2)
    entries = sorted((f"k{int(a):02d}", int(b), 1, i, "f", 0, 0) for i, (a, b) in enumerate(r.integers(0, 12, (90, 2))))
    path = str(tmp_path / "run")
    warc.write_run(path, entries)
    index = warc.sparse_index(path)
    for cuts in ([], [entries[0][:4]], [("a", 0, 0, 0), ("z", 0, 0, 0)], sorted({entries[i][:4] for i in r.integers(0, 90, 7)}), [e[:4] for e in entries]):
        bounds = list(zip([None, *cuts], [*cuts, None]))
        got = []
        for shard, start, end in warc.pieces(index, cuts):
            got += [(shard, e) for e in warc.read_run(path, start, end, *bounds[shard], buffer=64)]
        assert [e for _, e in got] == entries
        assert all((bounds[s][0] is None or e[:4] >= bounds[s][0]) and (bounds[s][1] is None or e[:4] < bounds[s][1]) for s, e in got)


def test_many_shards_of_many_runs(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "SPARSE", 4)
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), (F.col("id") % 3).cast("string")).alias("url"), F.lit("x").alias("html"), F.lit(20240101000000).alias("stamp")).repartition(4)
    runs = warc.write(warc.deduplicated(pages, folder), folder, run_rows=50)
    history = warc.merged(spark, runs, folder, shard_rows=20)
    got = [(h.url_key, h.stamp, h.page_id) for h in history.orderBy("shard", "place").collect()]
    assert len(got) == 400 and got == sorted(got) and history.select("shard").distinct().count() > 4
    assert warc.merged(spark, runs, folder + "/one", max_shards=1).select("shard").distinct().count() == 1


# --- 2 and 7 -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def whole_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts(whole_ids):
    enc = tokens.Encoder(queries.tokenizer(), limit=50)
    odd = ["İstanbul ΣΑΣ it's. 'S 3.14, a.b! x'.", "a\u0301b\u00a0c\u2003d\u0085e\x1cf", "<|endoftext|> X <|STARTOFTEXT|>", "ＡＢ ﬁ 12,5!! ..", *(t for _, t in TEXTS)]
    for t in odd:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == whole_ids(t), t


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bit_packing(width, tmp_path):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    with open(tmp_path / "f", "wb") as f:
        w = tokens.Writer(f, width, 64)
        for k, i in enumerate(range(0, 1000, 90)):
            w.add(k, ids[i : i + 90])
        w.close()
    with open(tmp_path / "f", "rb") as f:
        r = tokens.Reader(f)
        for a, n in ((0, 1000), (63, 2), (999, 1), (500, 0), (128, 64)):
            assert (r.ids(a, n) == ids[a : a + n]).all()
    assert len(tokens.pack(ids, width)) == -(-1000 * width // 8)


def test_token_files(spark, docs, empty, folder, whole_ids):
    got = tokens.read(spark, tokens.write(docs, folder, queries.tokenizer(), end_id=1, block=128)).collect()
    at = 0
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = whole_ids(t) + [1]
        assert (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in {tuple(g) for g in got}
        at += len(ids)
    assert len(got) == len(TEXTS)
    assert tokens.read(spark, tokens.write(empty, folder + "/e", queries.tokenizer())).count() == 0


def test_best_fit():
    def bins(sizes, capacity, open_bins):
        p = packing.Packer(capacity, open_bins)
        return [p.place(n) for n in sizes], p

    def plain(sizes, capacity, open_bins):
        """The same rule with a list of the open bins."""
        open_, last, out, closed = [], -1, [], 0
        for n in sizes:
            fit = min((b for b in open_ if b[1] >= n), key=lambda b: b[1], default=None)
            if fit is None:
                if len(open_) == open_bins:
                    open_.remove(min(open_, key=lambda b: b[1]))
                    closed += 1
                last += 1
                open_.append(fit := [last, capacity])
            out.append(capacity - fit[1])
            fit[1] -= n
            if not fit[1]:
                open_.remove(fit)
        return out, last + 1, closed

    sizes = np.random.default_rng(1).integers(1, 101, 500).tolist()
    for open_bins in (1, 2, 8, 1000):
        got, p = bins(sizes, 100, open_bins)
        used: dict[int, int] = {}
        for n, (b, off) in zip(sizes, got):
            assert off == used.get(b, 0)
            used[b] = off + n
        assert max(used.values()) <= 100 and ([o for _, o in got], p.bins, p.closed) == plain(sizes, 100, open_bins)
        assert (p.closed > 0) == (open_bins < 1000)
    assert [b for b, _ in bins([60, 70, 30, 40], 100, 2)[0]] == [0, 1, 1, 0]
    assert [b for b, _ in bins([60, 70, 80, 30], 100, 2)[0]] == [0, 1, 2, 0]  # 70 was the fullest and closed


def test_packing(docs, empty, whole_ids):
    got = packing.pack(docs, queries.tokenizer(), capacity=256, look_ahead=7).toPandas()
    assert Counter((None if math.isnan(d) else int(d), s, n, c) for d, s, n, c in zip(got["doc_id"], got["start"], got["length"], got["ids_crc32"])) == Counter(
        (i, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, t in TEXTS for ids in [whole_ids(t) + [0]] for s in range(0, len(ids), 256) for p in [ids[s : s + 256]]
    )
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 256
    assert packing.pack(empty, queries.tokenizer()).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------


def test_lm(docs, empty, folder):
    got = lm.score(docs, folder, chunk_chars=2000).collect()
    fold = lambda i: 2 if i is None else zlib.crc32(str(i).encode()) % 7
    words = lambda t: (t or "").encode().lower().split() + [None]
    count = Counter(w for i, t in TEXTS if fold(i) != 2 for w in words(t))
    n, v = sum(count.values()), len(count)
    want = sorted((i if i is not None else -1, len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in TEXTS for w in [words(t)])
    assert sorted((g.doc_id if g.doc_id is not None else -1, g.n_tokens, g.n_known, round(g.base_score, 6)) for g in got) == want
    assert all(g.train_tokens == n and g.held_out == (fold(g.doc_id) == 2) and g.score < 0 for g in got)
    assert sum(g.score for g in got) > sum(g.base_score for g in got)
    assert lm.score(empty, folder + "/e").count() == 0


def test_lm_scores_are_those_of_the_formula(spark, folder):
    """Counts, buckets, EM and scores from dictionaries; range sizes and chunks do not matter."""
    r = np.random.default_rng(12)
    rows = [(i, " ".join(r.choice(WORDS, r.integers(0, 40), p=np.arange(1, len(WORDS) + 1) / sum(range(len(WORDS) + 1))))) for i in range(90)]
    fold = lambda i: {2: 2, 3: 1}.get(zlib.crc32(str(i).encode()) % 7, 0)  # noqa: E731  learn 0, deleted 1, test 2
    words = lambda t: [None, *t.encode().lower().split(), "end"]

    def counts(folds):
        one, two = Counter(), Counter()
        for i, t in rows:
            if fold(i) in folds:
                w = words(t)
                one.update(w)
                two.update(zip(w, w[1:]))
        total = sum(n for w, n in one.items() if w is not None)
        return one, two, total, len(one) - (None in one)

    def parts(model, h, w):
        one, two, n, _ = model
        return one[h], two[h, w] / max(1, one[h]), one[w] / max(n, 1)

    level = lambda c: 0 if not c else min(lm.BUCKETS - 1, c.bit_length())
    learned = counts({0})
    size = learned[3] + 1
    cell = lambda p: 0 if p <= 0 else int(np.clip(np.round(np.log2(p * size) / lm.STEP) + 40, 0, lm.CELLS - 1)) + 1
    value = lambda x: 0.0 if not x else 2.0 ** ((x - 41) * lm.STEP)
    events = Counter()
    for i, t in rows:
        if fold(i) == 1:
            for h, w in zip(words(t), words(t)[1:]):
                c, p2, p1 = parts(learned, h, w)
                events[level(c), cell(p2), cell(p1)] += 1
    weights, last = [], [0.0, 0.9, 0.1]
    for b in range(lm.BUCKETS):
        own = [((value(x), value(y), 1.0), n) for (k, x, y), n in events.items() if k == b]
        if own:
            last = [0.4, 0.4, 0.2]
            for _ in range(60):
                new = [0.0] * 3
                for p, n in own:
                    g = [a * q for a, q in zip(last, p)]
                    for k in range(3):
                        new[k] += n * g[k] / sum(g)
                last = [x / sum(new) for x in new]
            last = [(x + 1e-9) / (1 + 3e-9) for x in last]
        weights.append(last)
    model = counts({0, 1})
    want = {}
    for i, t in rows:
        s = 0.0
        for h, w in zip(words(t), words(t)[1:]):
            c, p2, p1 = parts(model, h, w)
            l2, l1, l0 = weights[level(c)]
            s += math.log10(l2 * p2 + l1 * p1 + l0 / (model[3] + 1))
        want[i] = s
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, (chunk, span) in enumerate(((300, 8 << 20), (6_000_000, 100), (1000, 40))):
        got = lm.score(df, f"{folder}/{k}", chunk_chars=chunk, range_bytes=span).collect()
        assert len(got) == len(rows) and max(abs(g.score - want[g.doc_id]) for g in got) < 1e-8


def test_weights_sum_to_one_and_follow_the_data():
    c = lm.CELLS + 1
    code = np.array([3 * c * c + 60 * c + 41, 3 * c * c + 0 * c + 45])
    w = lm.expectation_maximisation(code, np.array([90, 10]))
    assert np.allclose(w.sum(1), 1) and w[3, 0] > 0.8
    x = np.array([0, 1, 255, 254, 10**12])
    assert (lm.decode(lm.encode(x), 5) == x).all()


# --- 4 ---------------------------------------------------------------------------------------------


def test_language(spark, empty):
    de, en = "der hund geht über die straße und schläft".split(), "the dog goes over that street and sleeps now".split()
    r = np.random.default_rng(2)
    rows = [(i, " ".join(r.choice(de if i % 2 else en, 40)), "de" if i % 2 else "en", 1) for i in range(120)]
    rows += [(200, None, "en", 1), (201, "123 !!", "en", 1), (202, "", None, 1), (None, "the dog and the street", None, 1), (203, "жизнь прекрасна сегодня как никогда " * 4, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    scorer = langid.train(df)
    got = langid.predict(df, scorer).collect()
    assert all(g.lang_pred == g.lang and 0 <= g.score <= 1 and not g.rejected for g in got if g.doc_id is not None and g.doc_id < 200)
    by = {g.doc_id: g for g in got}
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (200, 201, 202))
    assert by[None].lang_pred == "en" and by[203].rejected and by[203].lang_pred in ("de", "en")
    none = langid.train(df.where("false"))
    assert {g.lang_pred for g in langid.predict(df, none).collect()} == {"und"} and langid.predict(df.where("false"), scorer).count() == 0
    texts = ["the dog", "über die", "", None, "the dog goes", "12", " ".join(de + en)]
    want = langid.Table(scorer).totals(texts)
    for limit in (1, 3, 6):  # generations end in the middle
        table = langid.Table(scorer, limit)
        assert all(np.allclose(table.totals(texts), want) for _ in range(3))
    assert np.allclose(want[0], langid.Table(scorer).totals(["the dog"])[0]) and want[2].sum() == want[3].sum() == want[5].sum() == 0
    assert langid.known(df, scorer).columns == df.columns and {r.doc_id for r in langid.known(df, scorer).collect()} == {*range(120), None}


def plain_kneser_ney(words, floor):
    """The same model from dictionaries of strings, by the textbook's recursion."""
    count = Counter()
    for w, n in words.items():
        s = " " + w + " "
        for i in range(1, len(s)):
            for k in range(1, langid.ORDER + 1):
                if i - k + 1 >= 0:
                    count[k, s[i - k + 1 : i + 1], i - k + 1 == 0] += n
    kinds = {}
    for (k, g, start), n in count.items():
        if k == langid.ORDER or (start and k > 1):
            kinds.setdefault(k, Counter())[g] += n
    for k in range(1, langid.ORDER):
        for g in {g for j, g, _ in count if j == k + 1}:
            kinds.setdefault(k, Counter())[g[1:]] += 1
    # an n-gram of the same string that starts a word and one that does not can't be confused: the first begins with a blank
    out = {}
    for k, c in kinds.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(langid.MOST, max(langid.LEAST, n1 / max(1, n1 + 2 * n2)))
        total, some = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            some[g[:-1]] += 1
        out[k] = c, d, total, some

    def p(context, x):
        k = len(context) + 1
        lower = p(context[1:], x) if k > 1 else floor
        c, d, total, some = out.get(k, (Counter(), 0, Counter(), Counter()))
        if not total[context]:
            return lower
        return max(c[context + x] - d, 0) / total[context] + d * some[context] / total[context] * lower

    return p


def test_kneser_ney_against_dictionaries():
    r = np.random.default_rng(4)
    corpora = {x: Counter({"".join(r.choice(list(letters), r.integers(1, 9))): int(r.integers(1, 5)) for _ in range(150)}) for x, letters in (("a", "abcde"), ("b", "cdefgé"))}
    scorer = langid.Scorer({x: langid.fit(sorted(c), np.array([c[w] for w in sorted(c)])) for x, c in corpora.items()})
    tests = ["abc", "a", "ccdd", "zzz", "éé", "abcdeabcde", *list(corpora["a"])[:20], *list(corpora["b"])[:20]]
    got, n = scorer.logp(tests)
    for i, x in enumerate(scorer.langs):
        p = plain_kneser_ney(corpora[x], scorer.floor)
        for w, g in zip(tests, got[:, i]):
            s = " " + w + " "
            assert abs(g - sum(math.log(p(s[max(0, j - langid.ORDER + 1) : j], s[j])) for j in range(1, len(s)))) < 1e-9
        assert n.tolist() == [len(w) + 1 for w in tests]
        some = set("abcdefgé ")
        for context in (" ", "a", "ab", " c"):
            assert sum(p(context, x) for x in some) <= 1 + 1e-9


def test_calibration():
    r = np.random.default_rng(1)
    gaps = [(np.array([0.0, 0.02]) if r.random() < 0.8 else np.array([0.02, 0.0]), 0, 10.0) for _ in range(2000)]
    assert abs(langid.temperature(gaps) * 0.02 * 10 - math.log(4)) < 0.15  # a posterior of 0.8 where 0.8 are right
    assert 0 < langid.temperature([(np.array([0.0, 1.0]), 0, 10.0)] * 50) < 100  # separable: still inside


def test_rejection_rate(spark):
    r = np.random.default_rng(6)
    syllables = {"x": ["ka", "lo", "mi", "tu"], "y": ["ber", "fin", "gos"]}
    rows = [(i, " ".join("".join(r.choice(syllables[x], r.integers(1, 4))) for _ in range(r.integers(5, 60))), x) for i in range(3000) for x in ["xy"[i % 2]]]
    junk = [(5000 + i, " ".join("".join(r.choice(list("qwzxvjkh"), r.integers(3, 9))) for _ in range(30)), None) for i in range(100)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string").repartition(4)
    scorer = langid.train(df, per_language=400, calibrate=400, false_reject=0.01)
    got = langid.predict(df, scorer).withColumn("test", langid.folds(F.col("doc_id")) == 2).collect()
    clean = [g.rejected for g in got if g.doc_id < 3000 and g.test]
    assert sum(clean) <= 0.03 * len(clean) and all(g.rejected for g in got if g.doc_id >= 5000)
    assert all(g.lang_pred == g.lang for g in got if g.lang)


# --- 5 ---------------------------------------------------------------------------------------------


def plain_chunks(data):
    """Digest -> length, byte by byte: a chunk ends where the gear hash meets its mask."""
    import xxhash

    out, start, h = {}, 0, 0
    for i, c in enumerate(data):
        h = ((h << 1) + int(fingerprints.GEAR[c])) & 0xFFFFFFFF
        size = i + 1 - start
        mask = fingerprints.STRICT if size < fingerprints.NORMAL else fingerprints.LOOSE
        if (size >= fingerprints.SMALLEST and not h & int(mask)) or size == fingerprints.LARGEST or i + 1 == len(data):
            out[xxhash.xxh3_64_intdigest(data[start : i + 1]) >> 16] = size
            start = i + 1
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    least = min(sum(a.values()), sum(b.values()))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return min(1.0, sum(small[d] for d in set(small) & set(large)) / least)


def check_fingerprints(rows, got):
    import xxhash

    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)  # noqa: E731  as Spark's hash orders
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1] or "")))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k] if k else t
        own, ed, then = (plain_chunks(x.encode()) for x in (t, edited, nxt))
        written = lambda c: "".join(f"{d:012x}{n:02x}" for d, n in sorted(c.items()))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(ed), plain_likeness(own, ed), plain_likeness(own, then)))
    assert Counter(map(tuple, got)) == Counter(want)


def test_fingerprints(docs, empty, folder):
    check_fingerprints(TEXTS, fingerprints.compare_with_next(docs, folder).collect())
    assert fingerprints.compare_with_next(empty, folder).count() == 0
    check_fingerprints([TEXTS[0]], fingerprints.compare_with_next(docs.where("doc_id = 0"), folder).collect())


def test_fingerprints_in_many_ranges(spark, folder):
    """Shuffle partitions in the thousands, one id that a third of the rows share, rows that are all alike."""
    rows = [(7 if i % 3 == 0 else i, text(i % 400, 5 + i % 9)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("7", "3000"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            some = df.coalesce(1) if n == "3000" else df
            check_fingerprints(rows, fingerprints.compare_with_next(some, folder).coalesce(4).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        check_fingerprints([(None, "x")] * 50, fingerprints.compare_with_next(spark.createDataFrame([(None, "x")] * 50, "doc_id long, text string"), folder).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_chunks_shift():
    data = text(4, 800)
    a, b = fingerprints.chunks(data), fingerprints.chunks("inserted words first " + data)
    assert fingerprints.likeness(a, b) > 0.95
    for s in (data, "x" * 1000, "é" * 7, "a"):
        ends = fingerprints.boundaries(s.encode())
        sizes = [y - x for x, y in zip([0, *ends], ends)]
        assert sum(sizes) == len(s.encode()) and max(sizes) <= fingerprints.LARGEST and all(x >= fingerprints.SMALLEST for x in sizes[:-1])
    h = fingerprints.rolling(np.frombuffer(data.encode(), np.uint8))
    x = 0
    for i, c in enumerate(data.encode()[:200]):
        x = ((x << 1) + int(fingerprints.GEAR[c])) & 0xFFFFFFFF
        assert x == h[i]


# --- 6 ---------------------------------------------------------------------------------------------


def test_cover_tree(spark, folder):
    r = np.random.default_rng(0)
    x = r.normal(size=(40, 8))
    near = np.repeat(x[:6], 12, 0) + r.normal(size=(72, 8)) * 0.12
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.concatenate([x, near, x[:5], 3 * x[:3]]).tolist())]
    m = len(rows)
    rows += [(m, None), (m + 1, []), (m + 2, [0.0] * 8), (m + 3, [float("nan")] + [1.0] * 7), (m + 4, [None] + [1.0] * 7), (m + 5, [float("inf")] + [1.0] * 7), (m + 6, [1.0, 2.0]), (m + 7, [1e200] * 8), (m + 8, [1.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x")).repartition(3)
    got = {g.vec_id: g for g in covertree.near(df, folder, block=16, pivots=4).collect()}
    ok = {i: np.array(v) / np.linalg.norm(np.array(v) / max(map(abs, v))) / max(map(abs, v)) for i, v in rows if i is not None and i not in range(m, m + 6)}
    pairs = [(i, j) for i in ok for j in ok if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.95]
    assert len(pairs) > 100
    links, comp = Counter(x for p in pairs for x in p), union(pairs, [i for i, _ in rows if i is not None])
    assert len(got) == len(rows)
    for i, c in comp.items():
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], c, c == i)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert covertree.near(df.where("false"), folder + "/e").count() == 0


def test_cover_tree_invariants():
    x = covertree.unit(np.random.default_rng(7).normal(size=(300, 3)))
    depth = Counter()

    def walk(n, level=0):
        depth[level] += 1
        assert (covertree._far(x[n.idx], x[[n.center]]) <= n.radius + 1e-12).all()
        assert sorted(np.concatenate([n.points, *(k.idx for k in n.kids)])) == sorted(n.idx)
        for k in n.kids:
            assert len(k.idx) > 1 and (len(k.idx) <= covertree.LEAF or k.kids or len(k.points))
            walk(k, level + 1)
        if n.kids:  # a net: centres are further apart than half the level, which every radius is below
            far = covertree._far(x[n.at], x[n.at])
            assert min(far[np.triu_indices(len(far), 1)], default=9) > max(k.radius for k in n.kids) - 1e-9

    root = covertree.build(x)
    walk(root)
    assert len(depth) > 2
    for limit in (0.01, 0.3, 1.0):
        i, j = covertree._pairs_within(root, x, root, x, limit, True)
        want = {(a, b) for a, b in zip(*np.nonzero(covertree._far(x, x) <= limit)) if a < b}
        assert {(int(a), int(b)) for a, b in zip(i, j)} == {(int(a), int(b)) for a, b in want} and len(i) == len(want)


def test_cover_tree_prunes():
    r = np.random.default_rng(0)
    x = covertree.unit(np.repeat(r.normal(size=(40, 32)), 30, 0) + r.normal(size=(1200, 32)) * 0.1)
    limit, n = math.sqrt(0.1), len(x)
    for y, same, pairs in ((x, True, n * (n - 1) / 2), (covertree.unit(x[::-1] + r.normal(size=x.shape) * 0.02), False, n * n)):
        found, stats = [], {}
        a = covertree.build(x)
        covertree.dual(a, x, a if same else covertree.build(y), y, limit, found, same, stats)
        want = covertree._far(x, y) <= limit
        assert sum(len(i) for i, _ in found) == (np.triu(want, 1) if same else want).sum() > 1000
        assert stats["products"] < 0.2 * pairs and stats["pruned"] > 0.5 * stats["met"] > 0
    loose = covertree.unit(r.normal(size=(1500, 64)))  # nothing to prune: still no pair twice
    stats, tree = {}, covertree.build(loose)
    covertree.dual(tree, loose, tree, loose, limit, [], True, stats)
    assert stats["products"] < 1.15 * 1500 * 1499 / 2


def test_cover_tree_groups(spark, folder, monkeypatch):
    """Many blocks in several groups, tiny components among them."""
    monkeypatch.setattr(covertree, "GROUP", 2)
    r = np.random.default_rng(8)
    x = np.repeat(r.normal(size=(30, 6)), 10, 0) * 10.0 ** r.integers(-200, 200, (300, 1)) * (1 + r.normal(size=(300, 6)) * 0.05)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(2)
    u = covertree.unit(x)
    want = u @ u.T >= 0.95
    got = {g.vec_id: g for g in covertree.near(df, folder, block=8, pivots=5).collect()}
    comp = union([(i, j) for i, j in zip(*np.nonzero(want))], range(300))
    for i in range(300):
        assert (got[i].n_links, got[i].component_id) == (want[i].sum() - 1, comp[i])


# --- 8 ---------------------------------------------------------------------------------------------


def water(size):
    """Targets of capped water-filling, by the rule's own words: weights 5, 2, 1, no more than 3 times a size."""
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, sum(size.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        for s in over or free:
            target[s] = 3 * size[s] if over else level * weight[s]
            left -= target[s] if over else 0
        free -= over or free
    return target


def test_mixing(spark, docs, empty, folder):
    rows = mixing.repetitions(docs, folder).collect()
    assert len(rows) == len(TEXTS) and mixing.repetitions(empty, folder + "/e").count() == 0
    size = Counter()
    for k, (_, t) in enumerate(TEXTS):
        size[None if k % 5 == 0 else f"s{k % 3}"] += len((t or "").encode().split())
    target = water(size)
    for r in rows:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source]) and 0 <= r.taken <= 3 * r.size
    again = mixing.repetitions(docs.repartition(5), folder + "/again").collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 7 * (F.col("id") % 2)).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") * 37 % 90).cast("int")).alias("text"))
    got = mixing.repetitions(many, folder + "/many").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(g.t - g.g) <= 45 for g in got)
    mixed = mixing.mixed(docs.withColumn("size", F.lit(1)).withColumn("_cut", F.lit(2)), folder + "/m")
    want = Counter({(r.doc_id, r.source, r.size): 0 for r in rows})
    for r in rows:
        want[r.doc_id, r.source, r.size] += r.repeats
    words = F.coalesce(mixing.word_count(F.col("text")), F.lit(0))
    assert Counter(map(tuple, mixed.select("doc_id", "source", words).collect())) == +want


# --- 9 ---------------------------------------------------------------------------------------------


def test_urls(spark, folder):
    rules = queries.URL_RULES
    cases = {
        "http://A.Example.COM/en/7x?q": ("a.example.com", "/en/7x", "example.com/en/7", "allow"), "https://b.com/en/": ("b.com", "/en/", "com/en/", "block"), "x://net/de/8": ("net", "/de/8", "net/de/", "allow"),
        "x://example.net/de/81#z": ("example.net", "/de/81", "example.net/de/8", "block"), "x://xcom/en/1": ("xcom", "/en/1", None, "allow"), None: ("", "", None, "allow"), "no scheme com/en/": ("", "", None, "allow"),
        "x://h?y=/a": ("h", "", None, "allow"), "": ("", "", None, "allow"), "x://ÀB.org/es/": ("Àb.org", "/es/", "org/es/", "block"),
    }
    rows = [(i, u, "z") for i, u in enumerate([*cases, *list(cases)[:2]])] + [(100 + i, f"http://bad{i % 3}.example.xyz/promo/{i}?ad={i}", "z") for i in range(60)] + [(200 + i, f"http://good.example.xyz/{'news' if i % 2 else 'blog'}/{i}", "z") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string").repartition(3)
    labelled = pages.where("page_id >= 100").select("url", (F.col("page_id") < 200).alias("bad"))
    got = {r.page_id: r for r in urls.judge(pages, labelled, rules, folder).collect()}
    assert len(got) == len(rows)
    for i, want in enumerate([*cases.values(), *list(cases.values())[:2]]):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want
    assert all(got[100 + i].verdict == "block" and got[100 + i].rule is None for i in range(60)) and all(got[200 + i].verdict == "allow" for i in range(60))
    assert {r.verdict for r in urls.judge(pages.where("page_id > 99"), labelled.where("false"), rules, folder + "/e").collect()} == {"allow"}
    assert urls.judge(pages.where("false"), labelled, rules, folder + "/n").count() == 0


# --- 10 --------------------------------------------------------------------------------------------


def shingle_set(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, docs, empty, folder, k):
    r = np.random.default_rng(9)
    rows, base = [], text(20, 90).split()
    for i in range(100, 160):  # near copies of one text, many of them near each other only in part
        w = list(base)
        for j in r.integers(0, 90, r.integers(0, 8)):
            w[j] = f"n{r.integers(0, 50)}"
        rows.append((i, " ".join(w)))
    more = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.clusters(docs.select("doc_id", "text", "component_id").unionByName(more.withColumn("component_id", F.lit("q"))), folder, k=k).collect()
    have = [(i, shingle_set(t, k)) for i, t in TEXTS + rows]
    real = [(i, s) for i, s in have if i is not None and s]
    pairs = [(a, b) for x, (a, s) in enumerate(real) for b, t in real[:x] if a != b and 100 * len(s & t) >= 80 * len(s | t)]
    comp = union(pairs, {i for i, _ in have if i is not None})
    want = Counter((i, len(s), comp.get(i), i is not None and comp[i] == i) for i, s in have)
    assert Counter(map(tuple, got)) == want
    assert minhash.clusters(empty, folder + "/e", k=k).count() == 0


def test_hot_half_key_is_spread(spark, folder, monkeypatch):
    """Many near copies that share most half-keys, no two of them linked through the smallest id."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SET_BLOCK", 8)
    r = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(240):
        w = list(base)
        at = int(r.integers(0, 50))
        w[at : at + 3 + i % 7] = [f"n{r.integers(0, 1000)}" for _ in range(3 + i % 7)]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {g.doc_id: g.component_id for g in minhash.clusters(df, folder, k=2, alike=0).collect()}
    sets = [(i, shingle_set(t, 2)) for i, t in rows]
    pairs = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if 100 * len(s & t) >= 80 * len(s | t)]
    assert pairs and got == union(pairs, range(240)) and len(set(got.values())) > 1
    pairs = minhash.block_pairs(spark.createDataFrame([(1, 0, 100, k) for k in range(100)] + [(2, 0, 3, k) for k in range(3)], "h long, pos int, n long, id long").withColumn("main", F.col("id") > 0), 10, ["id"])
    deals = pairs.groupBy("h").agg(F.count("*").alias("pairs"), F.countDistinct("i", "j").alias("keys"), F.max(F.size("x")).alias("most")).collect()
    assert all(d.pairs == d.keys for d in deals) and {d.h: d.pairs for d in deals}[1] > 50 and max(d.most for d in deals) < 40


def test_kept_does_not_drop_another_text_of_the_same_id(spark, folder):
    rows = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (1, "A B C D E F G H"), (2, "a b c d e f g h"), (3, "other words are here now"), (None, "a b c d e f g h")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _gone int, _s1 int").repartition(2)
    out = minhash.kept(df, folder, k=5)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text.lower()) for r in out.collect()) == Counter([(1, "a b c d e f g h"), (1, "p q r s t u v w"), (3, "other words are here now"), (None, "a b c d e f g h")])


def test_kept(docs, folder):
    out = minhash.kept(docs, folder, k=5)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and sorted(i for i in ids if i is not None) == [0, 4, 5, 6, 7, 9, 10, 11, 13, 14, 15] and ids.count(None) == 2


# --- pipeline --------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path, whole_ids):
    """Each stage on what the one before it kept, against brute force; then the whole run."""
    import corpus_pipeline

    de, en = "der hund geht über die straße und schläft heute lang".split(), "the dog goes over that street and sleeps now again".split()
    r = np.random.default_rng(5)
    rows = [(i, " ".join(r.choice(de if i % 2 else en, int(r.integers(20, 90)))), "de" if i % 2 else "en", None if i % 11 == 0 else f"s{i % 4 * (i % 3)}") for i in range(140)]
    rows += [(300 + i, rows[i][1].upper() if i % 2 else rows[i][1] + " dog", rows[i][2], f"s{i % 5}") for i in range(0, 140, 9)]  # near and exact copies
    rows += [rows[0], (400, None, "en", "s1"), (401, "", None, "s1"), (402, "12 ??", "en", None), (403, "жизнь прекрасна сегодня как никогда " * 4, None, "s2"), (404, " ".join(en * 500), "en", "s0")]
    frame = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, lang string, source string, size int, component_id string")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = frame, [Counter(map(tuple, frame.collect()))]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = store.saved(stage(spark, docs, str(tmp_path)), f"{tmp_path}/stage-{k}")
        assert k == 3 or docs.columns == frame.columns
        seen.append(Counter(map(tuple, docs.collect())))
    start, known, alone, mixed, _ = seen
    assert known == Counter({x: n for x, n in start.items() if x[0] not in (400, 401, 402, 403)})
    sets = {x[0]: shingle_set(x[1], 5) for x in known}
    ids = sorted(sets)
    comp = union([(a, b) for i, a in enumerate(ids) for b in ids[:i] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], ids)
    assert alone == Counter({x for x in known if comp[x[0]] == x[0]}) and len(alone) < len(known)
    words = lambda x: len(x[1].encode().split())
    size, taken = Counter(), Counter()
    for x in alone:
        size[x[3]] += words(x)
    for x, n in mixed.items():
        assert x in alone and n <= 3
        taken[x[3]] += n * words(x)
    largest = max(words(x) for x in alone if x[0] != 404)
    assert all(abs(taken[s] - t) <= (largest if s != "s0" else 5000) for s, t in water(size).items())
    want = Counter((x[0], at, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for x, n in mixed.items() for ids in [whole_ids(x[1]) + [0]] for at in range(0, len(ids), 2048) for p in [ids[at : at + 2048]] for _ in range(n))
    for packed in (docs.toPandas(), corpus_pipeline.run(spark, str(tmp_path)).toPandas()):
        assert Counter(zip(packed["doc_id"].tolist(), packed["start"].tolist(), packed["length"].tolist(), packed["ids_crc32"].tolist())) == want
        for _, g in packed.sort_values("offset").groupby("sequence_id"):
            assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 2048


def test_pipeline_of_no_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
