"""Near-duplicate documents by MinHash with tensored banding, candidates verified on full sets.

Two small collections of ``half`` keys, each of ``rows`` minhashes, are computed for a document; the
half * half table keys are all pairs of a first and a second half-key. So half * half tables of
2 * rows minhashes need 2 * half * rows minhashes, about the square root of what separate tables
would need. Two sets of similarity s meet in some table when they agree in at least one half-key of
each collection: with probability (1 - (1 - s^rows)^half)^2, 0.9996 at s = 0.8 for rows 3, half 12.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import store
from .components import components
from .words import bounded, hashes, mix, shingles, split

SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, a array<long>, b array<long>, nibbles array<long>"


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + (np.uint64(seed) << np.uint64(32)))
    return x[:n] | np.uint64(1), x[n:]


def signature(s: np.ndarray, mul: np.ndarray, xor: np.ndarray) -> np.ndarray:
    out = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        out = np.minimum(out, ((s[None, i : i + 2048] ^ xor[:, None]) * mul[:, None]).min(1))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame, k: int, rows: int, half: int, seed: int) -> DataFrame:
    """One row for each document: its set's size and 128-bit hash, its half-keys, and four
    bits of each of 64 minhashes, of which two sets of similarity s share s + (1 - s) / 16 on average."""

    def run(batches):
        words, (mul, xor) = hashes(), _constants(max(64, 2 * half * rows), seed)
        tag = mix(np.arange(2 * half, dtype=np.uint64) + np.uint64(seed))
        for batch in bounded(batches):
            out = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(words.of(split(t)), k)
                if not len(s):
                    out.append((d, 0, None, None, None, None, None))
                    continue
                sig = signature(s, mul, xor)
                key = tag.copy()
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[r : 2 * half * rows : rows])
                key = key.view(np.int64)
                whole = xxhash.xxh3_128_digest(s.tobytes())
                nibbles = ((mix(sig[:64]) & np.uint64(15)).reshape(4, 16) << np.arange(0, 64, 4, dtype=np.uint64)).sum(1, dtype=np.uint64)
                out.append((d, len(s), *np.frombuffer(whole, np.int64).tolist(), key[:half].tolist(), key[half:].tolist(), nibbles.view(np.int64).tolist()))
            c = list(zip(*out)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], ["doc_id", "n_shingles", "s1", "s2", "a", "b", "nibbles"])

    return _rows(docs).mapInArrow(run, SKETCH)


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set) of the documents whose id is in ``ids``."""

    def run(batches):
        words = hashes()
        for batch in bounded(batches):
            sets = [shingles(words.of(split(t)), k).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    return _rows(docs).join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(run, "id long, set binary")


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, folder: str) -> DataFrame:
    """The ``pairs`` (u, v) with 100 * intersection >= percent * union of their full sets."""
    ids = store.saved(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), f"{folder}/ids")
    sets = store.saved(_sets(docs, ids, k), f"{folder}/sets")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = 0
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    both = np.concatenate((a, b))
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                keep.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    with_v = pairs.join(sets.select(F.col("id").alias("v"), F.col("set").alias("y")), "v")
    return with_v.join(sets.select(F.col("id").alias("u"), F.col("set").alias("x")), "u").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def clusters(docs: DataFrame, folder: str, k: int = 5, percent: int = 80, rows: int = 3, half: int = 12, alike: int = 35, seed: int = 7) -> DataFrame:
    """Near-duplicate components of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z lower-cased; a set has its distinct
    k-word shingles, or the whole sequence where there are fewer words. A text that is null or has no
    word has the empty set, links with nothing and is kept. A null doc_id links with nothing and has
    a null component and kept = false. Repeated rows and equal sets share a component. Other
    columns are not read; an empty table gives no rows.

    Equal sets are one representative from here on, so a group of copies costs one row. Half-keys that
    no other representative has are dropped before keys are paired, which loses no table key with
    two members. In each table key members are first compared with the key's smallest id (each member
    with its likeliest leader and its smallest). Then every pair that shares a key but still lies in
    different components is compared, unless its 64 short hashes rule the similarity out (35 of 64
    equal: missed with probability 1e-7 at 0.8). Pairs within a component are not needed and not made.
    """
    sk = store.saved(sketches(docs, k, rows, half, seed), f"{folder}/sketches")
    real = sk.where("doc_id IS NOT NULL AND n_shingles > 0")
    groups = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("nibbles").alias("nibbles"))
    reps = store.saved(groups, f"{folder}/reps")
    links = _links(docs, reps, k, percent, alike, folder)
    comp = components(links, f"{folder}/cc") if links is not None else None
    named = reps.select("s1", "s2", "id")
    if comp is None:
        named = named.withColumn("component_id", F.col("id"))
    else:
        named = named.join(comp.withColumnRenamed("u", "id"), "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component_id"))
    named = store.saved(named.select(F.col("s1").alias("_1"), F.col("s2").alias("_2"), "component_id"), f"{folder}/named")
    out = real.join(named, (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2"))).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(sk.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _same(x: str, y: str):
    """How many of the 64 short hashes agree: four bits of an xor that are all zero."""
    total = F.lit(64)
    for i in range(4):
        z = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        some = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3))
        total = total - F.bit_count(some.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _links(docs, reps, k, percent, alike, folder):
    nibbles = reps.select("id", "nibbles")
    halves = reps.select("id", F.explode("a").alias("h"), F.lit(0).alias("side")).unionByName(reps.select("id", F.explode("b").alias("h"), F.lit(1).alias("side")))
    shared = halves.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    # at most `half` keys a side, so a document's lists are short
    own = halves.join(shared, "h").groupBy("id").agg(F.collect_list(F.when(F.col("side") == 0, F.col("h"))).alias("a"), F.collect_list(F.when(F.col("side") == 1, F.col("h"))).alias("b"))
    keyed = own.select("id", F.explode("a").alias("ha"), "b").select("id", "ha", F.explode("b").alias("hb")).select("id", F.xxhash64("ha", "hb").alias("key"))
    keyed = store.saved(keyed.join(nibbles, "id"), f"{folder}/keyed")
    lead = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "nibbles")).alias("m")).where("n > 1").select("key", "n", F.col("m.id").alias("leader"), F.col("m.nibbles").alias("leader_nibbles"))
    lead = store.saved(lead, f"{folder}/leaders")
    if not lead.take(1):
        return None
    members = store.saved(keyed.join(lead, "key"), f"{folder}/members")
    star = members.where("id <> leader").withColumn("same", _same("nibbles", "leader_nibbles")).where(F.col("same") >= alike)
    best = star.groupBy("id").agg(F.max(F.struct("same", "leader")).alias("x"), F.min("leader").alias("y")).select(F.col("id").alias("u"), F.explode(F.array_distinct(F.array("x.leader", "y"))).alias("v"))
    tried = store.saved(best, f"{folder}/star")
    links = store.saved(verified(docs, tried, k, percent, f"{folder}/v1"), f"{folder}/links1")
    comp = components(links, f"{folder}/cc1").withColumnRenamed("u", "id")
    more = _across(docs, reps, members.select("id").distinct(), comp, k, percent, alike, folder)
    return links.unionByName(store.saved(more, f"{folder}/links2"))


#: Documents in a block when their short hashes are compared, and when their full sets are.
BLOCK, SET_BLOCK = 1024, 64


def block_pairs(rows: DataFrame, size: int, columns: list[str], mains: str = "n") -> DataFrame:
    """Pairs of blocks (h, pos, i, j, x, y) of the rows (h, pos, n, id, main, ...) of each half-key: block i
    of those with ``main`` true against block j of all, about ``size`` rows each. ``n`` counts a
    half-key's rows, column ``mains`` those with ``main`` true (or bounds them). Rows are dealt to
    blocks by a hash of the id and blocks, not rows, are sent once for each block they meet; the
    blocks' numbers are part of the join's key, so the pairs of one half-key with any number of
    members lie in many tasks.
    """
    of = lambda c: F.greatest(F.ceil(F.col(c) / size).cast("int"), F.lit(1))
    own = lambda c: F.pmod(F.xxhash64("id"), of(c)).cast("int")
    block = F.collect_list(F.struct(*columns))
    xs = rows.where("main").groupBy("h", "pos", own(mains).alias("i"), of("n").alias("_met")).agg(block.alias("x"))
    ys = rows.groupBy("h", own("n").alias("j"), of(mains).alias("_met")).agg(block.alias("y"))
    met = F.explode(F.sequence(F.lit(0), F.col("_met") - 1))
    return xs.withColumn("j", met).drop("_met").join(ys.withColumn("i", met).drop("_met"), ["h", "i", "j"]).select("h", "pos", "i", "j", "x", "y")


def _sides(rows: DataFrame) -> DataFrame:
    """``rows`` (h, component, ...) of the half-keys that several components share, with n (the half-key's
    rows), main (whether outside its largest component) and mains (how many are)."""
    by_part = rows.groupBy("h", "component").agg(F.count("*").alias("c"))
    top = by_part.groupBy("h").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    top = top.select("h", "n", (F.col("n") - F.col("m.c")).alias("mains"), F.col("m.component").alias("_top"))
    return rows.join(top, "h").withColumn("main", F.col("component") != F.col("_top")).drop("_top")


def _across(docs, reps, some, comp, k, percent, alike, folder):
    """Links between components, whole: pairs that share a first half-key, which all table keys' pairs do.

    A half-key's members outside its largest component are compared with all its members, block
    against block, so that neither a join nor a task makes the pairs as rows. Short hashes name the
    documents with a likely partner; the full sets of these alone are then compared in blocks, again
    those outside the largest component with all. A pair is taken up in the first half-key that it
    shares.
    """
    base = reps.join(some, "id", "left_semi").join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "a", "nibbles")
    rows = base.select("*", F.posexplode("a").alias("pos", "h"))
    rows = store.saved(_sides(rows), f"{folder}/across")
    half = len(rows.select("a").first()["a"]) if rows.take(1) else 0
    if not half:
        return docs.sparkSession.createDataFrame([], "u long, v long")
    names = ["id", "component", *(f"a{i}" for i in range(half)), *(f"n{i}" for i in range(4))]
    flat = lambda df, *more: df.select("h", "pos", "n", "main", "mains", "id", "component", *(F.col("a")[i].alias(f"a{i}") for i in range(half)), *(F.col("nibbles")[i].alias(f"n{i}") for i in range(4)), *more)

    def met(df, size, *more):
        return block_pairs(df, size, [*names, *more], "mains").select("h", "pos", "x", "y")

    tile = 256

    def columns(value):
        s = value.values
        return {n: s.field(i) for i, n in enumerate(x.name for x in s.type)}

    def mask(x, y, pos):
        """Which pairs lie in different components, are alike, and share no earlier half-key."""
        n = len(x["id"])
        if n > tile:
            return np.concatenate([mask({k: v.slice(i, tile) for k, v in x.items() if k != "set"}, y, pos) for i in range(0, n, tile)])
        col = lambda c, n: c[n].to_numpy()
        ok = col(x, "component")[:, None] != col(y, "component")[None]
        same = np.full(ok.shape, 64, np.int64)
        for i in range(4):
            z = (col(x, f"n{i}")[:, None] ^ col(y, f"n{i}")[None]).view(np.uint64)
            z = (z | (z >> np.uint64(1)) | (z >> np.uint64(2)) | (z >> np.uint64(3))) & np.uint64(0x1111111111111111)
            same -= np.bitwise_count(z)
        ok &= same >= alike
        for i in range(pos):
            if not ok.any():
                break
            ok &= col(x, f"a{i}")[:, None] != col(y, f"a{i}")[None]
        return ok

    def likely(batches):
        for b in batches:
            hs, ids = [], []
            for h, pos, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                x, y = columns(x), columns(y)
                ok = mask(x, y, pos)
                if ok.any():
                    found = np.unique(np.concatenate((x["id"].to_numpy()[ok.any(1)], y["id"].to_numpy()[ok.any(0)])))
                    hs += [h] * len(found)
                    ids += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ids, pa.int64())], ["h", "id"])

    def exact(batches):
        for b in batches:
            us, vs = [], []
            for pos, x, y in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
                x, y = columns(x), columns(y)
                ok = mask(x, y, pos)
                if not ok.any():
                    continue
                sx = [np.frombuffer(v.as_buffer(), np.uint64) for v in x["set"]]
                sy = [np.frombuffer(v.as_buffer(), np.uint64) for v in y["set"]]
                nx, ny = np.array([len(v) for v in sx]), np.array([len(v) for v in sy])
                ok &= (100 * np.minimum(nx[:, None], ny[None]) >= percent * np.maximum(nx[:, None], ny[None]))
                for i in np.flatnonzero(ok.any(1)).tolist():
                    js = np.flatnonzero(ok[i])
                    # one sorted search for all partners of a document
                    both = np.concatenate([sy[j] for j in js])
                    at = np.minimum(np.searchsorted(sx[i], both), len(sx[i]) - 1)
                    ends = np.cumsum(ny[js])
                    common = np.add.reduceat((sx[i][at] == both).astype(np.int64), ends - ny[js])
                    hit = js[100 * common >= percent * (nx[i] + ny[js] - common)]
                    us += [x["id"][i].as_py()] * len(hit)
                    vs += y["id"].to_numpy()[hit].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    named = store.saved(met(flat(rows), BLOCK).mapInArrow(likely, "h long, id long").distinct(), f"{folder}/likely")
    ids = store.saved(named.select("id").distinct(), f"{folder}/likely-ids")
    sets = store.saved(_sets(docs, ids, k), f"{folder}/likely-sets")
    left = _sides(store.saved(flat(rows).drop("n", "main", "mains").join(named, ["h", "id"]), f"{folder}/likely-rows"))
    return met(left.join(sets, "id"), SET_BLOCK, "set").mapInArrow(exact, "u long, v long").distinct()


def kept(docs: DataFrame, folder: str, **options) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id. Of rows that
    share that doc_id and a shingle set one stays; rows that share the id alone are different
    documents and stay each. A row without doc_id, or whose text has no word, stays. All columns are
    kept, whatever their names; an empty table gives no rows."""
    c = clusters(docs, folder, **options)
    own, gone, again = (_unused(docs.columns, x) for x in ("_id", "_gone", "_again"))
    rows = docs.withColumn(own, F.col("doc_id").cast("long"))
    lost = store.saved(c.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(gone)).distinct(), f"{folder}/gone")
    out = rows.join(lost, F.col(own) == F.col(gone), "left_anti")
    many = store.saved(c.where("kept AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again)), f"{folder}/again")
    if not many.take(1):
        return out.drop(own)
    k, (s1, s2) = options.get("k", 5), (_unused(docs.columns, x) for x in ("_s1", "_s2"))
    at = out.columns.index("text")

    def hashed(batches):
        words = hashes()
        for batch in bounded(batches):
            sets = [shingles(words.of(split(t)), k) for t in batch.column(at).to_pylist()]
            both = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(both[:, 0]), pa.array(both[:, 1])], names=[*batch.schema.names, s1, s2])

    twice = out.join(many, F.col(own) == F.col(again), "left_semi")
    twice = twice.mapInArrow(hashed, out.schema.add(s1, "long").add(s2, "long")).dropDuplicates([own, s1, s2])
    return out.join(many, F.col(own) == F.col(again), "left_anti").unionByName(twice.drop(s1, s2)).drop(own)


def _unused(columns: list[str], name: str) -> str:
    have = {c.lower() for c in columns}
    while name in have:
        name += "_"
    return name
