"""Exact threshold pairs of embeddings by cover trees and dual traversal.

Equal vectors are one point. Points are sorted by their nearest pivot and cut into blocks; each
block is a cover tree whose levels halve the radius. Two trees are walked together: a pair of nodes
whose centres are further apart than the threshold plus both covering radii is dropped with all its
pairs. Blocks, and groups of blocks, are the levels above and are pruned in the same way unread.
"""

from __future__ import annotations

import math
import pickle
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import store

LEAF = 24
#: Rows of a product of centres that is formed at once.
TILE = 128


class Node:
    """Points ``idx`` within ``radius`` of the point ``center``. Below it: ``kids``, nodes of two points or
    more, and ``points``, its children that are one point; a leaf has points alone."""

    __slots__ = ("center", "radius", "idx", "points", "kids", "at", "radii")

    def __init__(self, center: int, radius: float, idx: np.ndarray):
        self.center, self.radius, self.idx = center, radius, idx
        self.below(idx, [])

    def below(self, points: np.ndarray, kids: list) -> None:
        self.points, self.kids = points, kids
        self.at = np.concatenate((points, np.array([k.center for k in kids], np.int64)))
        self.radii = np.array([k.radius for k in kids])


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def build(x: np.ndarray, idx: np.ndarray | None = None, level: float = 2.0) -> Node:
    """Cover tree of unit vectors. Each node's children are a net of half its level's radius: centres
    are further apart than that, and every point is within it of one. Levels go on halving down to
    single points or to leaves of at most LEAF points."""
    idx = np.arange(len(x)) if idx is None else idx
    node = Node(int(idx[0]), float(_far(x[idx], x[idx[:1]]).max()), idx)
    if len(idx) <= LEAF and level < 2.0 or len(idx) == 1 or node.radius < 1e-9:
        return node
    while level / 2 >= node.radius:
        level /= 2
    points, kids, rest = [], [], idx
    least = 1 - level * level / 8
    while len(rest):
        near = x[rest] @ x[rest[0]] >= least
        near[0] = True
        if near.sum() == 1:
            points.append(rest[0])
        else:
            kids.append(build(x, rest[near], level / 2))
        rest = rest[~near]
    node.below(np.array(points, np.int64), kids)
    return node


def dual(a: Node, x: np.ndarray, b: Node, y: np.ndarray, limit: float, found: list, same: bool = False, stats: dict | None = None) -> None:
    """Append arrays (i, j) of candidate pairs of points, i of ``x`` and j of ``y``; in one tree (``same``)
    each pair once. A pair of nodes is dropped with all its pairs of points when its centres are
    further apart than ``limit`` plus both covering radii. ``stats`` gets the numbers of products
    formed, of node pairs met, and of those pruned.
    """
    stack = [(a, b, same)]
    nearest = 1 - limit * limit / 2
    products = met = pruned = 0
    while stack:
        a, b, own = stack.pop()
        p, q = len(a.points), len(b.points)
        ra, rb = np.concatenate((np.zeros(p), a.radii)), np.concatenate((np.zeros(q), b.radii))
        # of each kid of a, or of b: the points of the other side that it has to be compared with
        near_a: dict[int, list] = {}
        near_b: dict[int, list] = {}
        xa, yb = x[a.at], y[b.at]
        tile = TILE if own else 4 * TILE
        for s in range(0, len(a.at), tile):
            e, c = min(s + tile, len(a.at)), s if own else 0
            cos = xa[s:e] @ yb[c:].T
            products += cos.size
            if own:  # this tile's own square: each pair once, a node's pair with itself among them
                k = np.arange(s, e)
                cos[:, : e - s][(k[:, None] > k) | ((k[:, None] == k) & (k < p))] = -9.0
            rows, cols = max(0, min(p, e) - s), max(0, q - c)
            plain = np.flatnonzero(cos[:rows, :cols] >= nearest)
            if len(plain):
                found.append((a.points[plain // cols + s], b.points[plain % cols + c]))
            if rows and c + cols < len(b.at):  # points of a and kids of b
                close = cos[:rows, cols:] >= _bound(limit + rb[c + cols :])
                met, pruned = met + close.size, pruned + close.size - int(close.sum())
                for m in np.flatnonzero(close.any(0)).tolist():
                    (near_a if own else near_b).setdefault(c + cols + m - q, []).append(a.points[np.flatnonzero(close[:, m]) + s])
            if s + rows < e:  # kids of a and all of b
                close = cos[rows:] >= _bound(limit + ra[s + rows : e, None] + rb[c:])
                met, pruned = met + close.size, pruned + close.size - int(close.sum())
                for k in np.flatnonzero(close.any(1)).tolist():
                    kid, some = s + rows + k - p, np.flatnonzero(close[k])
                    points = some[some < cols]
                    if len(points):
                        near_a.setdefault(kid, []).append(b.points[points + c])
                    for m in (some[len(points) :] + c - q).tolist():
                        if own and m == kid:
                            stack.append((a.kids[kid], a.kids[kid], True))
                        elif not b.kids[m].kids:
                            near_a.setdefault(kid, []).append(b.kids[m].points)
                        else:
                            stack.append((a.kids[kid], b.kids[m], False))
        for k, some in near_a.items():
            stack.append((a.kids[k], _loose(np.concatenate(some)), False))
        for m, some in near_b.items():
            stack.append((_loose(np.concatenate(some)), b.kids[m], False))
    if stats is not None:
        for k, v in (("products", products), ("met", met), ("pruned", pruned)):
            stats[k] = stats.get(k, 0) + v


def _bound(far: np.ndarray) -> np.ndarray:
    """The least cosine of vectors no further apart than this."""
    return 1 - np.minimum(2.0001, far) ** 2 / 2


def _loose(points: np.ndarray) -> Node:
    return Node(int(points[0]), 2.0, points)


def _pairs_within(a: Node, x, b: Node, y, limit, same):
    found: list = []
    dual(a, x, b, y, limit, found, same)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = (np.concatenate(v) for v in zip(*found))
    if same:  # nodes of one tree met in either order
        i, j = np.minimum(i, j), np.maximum(i, j)
    return i, j


def confirmed(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of raw vectors have at least this cosine, in double precision."""
    out = np.empty(len(i), bool)
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        out[k : k + (1 << 16)] = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= cosine
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest point reachable from each of n points, by hooking and pointer jumping."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], low)
        np.minimum.at(new, lab[j], low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


# --- blocks in shared files ----------------------------------------------------------------------


def scaled(raw: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, exactly, so that its largest component is near one: no
    square overflows or vanishes."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1))[1][:, None])


def _write_block(path: str, ids, mult, raw: np.ndarray) -> None:
    with store.Target(path) as f:
        f.write(struct.pack("<QQ", *raw.shape) + np.array(ids, "<i8").tobytes() + np.array(mult, "<i8").tobytes() + raw.astype("<f8").tobytes() + pickle.dumps(build(unit(raw))))


class Block:
    def __init__(self, path: str):
        with store.opened(path) as f:
            n, d = struct.unpack("<QQ", f.read(16))
            self.ids, self.mult = np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(8 * n), "<i8")
            self.raw = np.frombuffer(f.read(8 * n * d), "<f8").reshape(n, d)
            self.tree: Node = pickle.loads(f.read())  # built once, when the block was written
        # bounds and products in single precision, with a margin; pairs are confirmed in double
        self.unit = unit(self.raw).astype(np.float32)


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


META = "block string, n long, dim int, center binary, radius double"


def _blocks(pivots: dict, folder: str, size: int):
    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        ids, mult, raw, dim = [], [], [], None

        def flush():
            nonlocal k
            path = f"{folder}/blocks/block-{part:06d}-{k:05d}.bin"
            k += 1
            x = scaled(np.array(raw, np.float64))
            _write_block(path, ids, mult, x)
            u = unit(x)
            c = u.mean(0)
            c = c / n if (n := math.sqrt((c * c).sum())) > 1e-12 else u[0]
            out = (path, len(ids), x.shape[1], c.tobytes(), float(_far(u, c[None]).max()))
            ids.clear(), mult.clear(), raw.clear()
            return out

        rows = []
        for b in batches:
            for d, i, m, e in zip(*(b.column(c).to_pylist() for c in ("dim", "id", "mult", "embedding"))):
                if ids and (d != dim or len(ids) >= size):
                    rows.append(flush())
                dim = d
                ids.append(i), mult.append(m), raw.append(e)
        if ids:
            rows.append(flush())
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.float64()))], [x.split()[0] for x in META.split(", ")])

    return run


def _nearest(pivots: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            place, far = [], []
            for e in b.column(b.schema.get_field_index("embedding")).to_pylist():
                p = pivots.get(len(e))
                if p is None:
                    place.append(-1), far.append(0.0)
                    continue
                f = _far(unit(np.array([e], np.float64)), p)[0]
                place.append(int(f.argmin())), far.append(float(f.min()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int32()), pa.array(far, pa.float64())], names=[*b.schema.names, "pivot", "far"])

    return run


#: Blocks in a group, the level above blocks.
GROUP = 512


def _grouped(folder: str):
    """Groups of neighbouring blocks: a file with the blocks' names, centres and radii, and a row."""

    def run(batches):
        part, k, have = TaskContext.get().partitionId(), 0, []

        def flush():
            nonlocal k
            path = f"{folder}/groups/group-{part:06d}-{k:05d}.bin"
            k += 1
            centres = np.stack([np.frombuffer(r["center"]) for r in have])
            radii = np.array([r["radius"] for r in have])
            with store.Target(path) as f:
                f.write(pickle.dumps(([r["block"] for r in have], centres, radii)))
            c = centres.mean(0)
            c = c / n if (n := math.sqrt((c * c).sum())) > 1e-12 else centres[0]
            out = (path, have[0]["block"], have[0]["dim"], len(have), c.tobytes(), float((_far(centres, c[None])[:, 0] + radii).max()))
            have.clear()
            return out

        rows = []
        for b in batches:
            for r in b.to_pylist():
                if have and (len(have) == GROUP or r["dim"] != have[0]["dim"]):
                    rows.append(flush())
                have.append(r)
        if have:
            rows.append(flush())
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in GROUPS.split(", ")])

    return run


GROUPS = "path string, first string, dim int, n long, center binary, radius double"


def _group(path: str):
    with store.opened(path) as f:
        return pickle.loads(f.read())


def _walk(shared, total: int, cosine: float):
    """Each block against itself and half of the others, those round the circle after it: groups that the
    bound excludes are not read, blocks that it excludes neither."""
    limit = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-4

    def run(batches):
        groups = shared.value
        for batch in batches:
            for path, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, cs, rs = _group(path)
                base, dim = next((g[1], g[2]) for g in groups if g[0] == path)
                k, name, center, radius = base + place, names[place], cs[place], rs[place]
                own = Block(name)
                for gp, first, gdim, n, gc, gr in groups:
                    if gdim != dim or math.sqrt(max(0.0, 2 - 2 * float(center @ gc))) > limit + radius + gr:
                        continue
                    others, oc, orad = _group(gp)
                    m = first + np.arange(n)
                    s = (m - k) % total
                    mine = (2 * s < total) | ((2 * s == total) & (m > k))
                    close = np.sqrt(np.maximum(0.0, 2 - 2 * (oc @ center))) <= limit + radius + orad
                    for i in np.flatnonzero(mine & (close | (s == 0))).tolist():
                        same = first + i == k
                        if (got := _compared(own, own if same else Block(others[i]), same, limit, cosine)) is not None:
                            yield got

    return run


def _compared(own: Block, other: Block, same: bool, limit: float, cosine: float):
    """One row for each vector with links: how many, and the smallest vector it reaches by these."""
    i, j = _pairs_within(own.tree, own.unit, other.tree, other.unit, limit, same)
    ok = confirmed(own.raw, i, other.raw, j, cosine)
    i, j = i[ok], j[ok]
    if not len(i):
        return None
    ids = own.ids if same else np.concatenate([own.ids, other.ids])
    mult = own.mult if same else np.concatenate([own.mult, other.mult])
    j = j + (0 if same else len(own.ids))
    links = np.bincount(i, weights=mult[j], minlength=len(ids)) + np.bincount(j, weights=mult[i], minlength=len(ids))
    root = _roots(len(ids), i, j)
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(links[some].astype(np.int64), pa.int64()), pa.array(ids[root[some]], pa.int64())], ["id", "links", "root"])


def near(vectors: DataFrame, folder: str, cosine: float = 0.95, block: int = 2048, pivots: int = 256) -> DataFrame:
    """All rows of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links are pairs with at least this cosine in double precision, whatever else the rows hold. A
    vector that is null, empty or zero, or holds a null or non-finite component, links with nothing;
    so do vectors of different length, and a row without vec_id (component null, kept false). Equal
    vectors link with each other; repeated rows count each. An empty table gives no rows. Other
    columns are not read.

    A task holds two blocks; it sends one row for each vector with links, never a pair. Pivots (a
    bounded sample) only order the points, so their choice does not change a result.
    """
    from .components import components

    spark = vectors.sparkSession
    e = F.col("embedding")
    fine = e.isNotNull() & F.col("vec_id").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(e, lambda x: x != 0)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    base = base.withColumn("fine", F.coalesce(fine, F.lit(False)))
    keyed = base.where("fine").withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    points = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    points = store.saved(points, f"{folder}/points")
    n = points.count()
    none = base.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = none
    if n:
        sample: dict[int, list] = {}
        for r in points.orderBy("k1", "k2").limit(pivots).select("dim", "embedding").collect():
            sample.setdefault(r["dim"], []).append(r["embedding"])
        pv = {d: unit(np.array(v, np.float64)) for d, v in sample.items()}
        placed = points.select("id", "mult", "dim", "embedding").mapInArrow(_nearest(pv), "id long, mult long, dim int, embedding array<double>, pivot int, far double")
        ranged = placed.repartitionByRange(max(1, -(-n // block)), "dim", "pivot", "far", "id").sortWithinPartitions("dim", "pivot", "far", "id")
        meta = store.saved(ranged.mapInArrow(_blocks(pv, folder, 2 * block), META), f"{folder}/meta")
        ordered = meta.repartitionByRange(max(1, -(-n // (block * GROUP))), "block").sortWithinPartitions("block")
        found = store.saved(ordered.mapInArrow(_grouped(folder), GROUPS), f"{folder}/group-list")
        groups, total = [], 0
        for r in found.orderBy("first").collect():  # a row for about GROUP * block vectors
            groups.append((r["path"], total, r["dim"], r["n"], np.frombuffer(r["center"]), r["radius"]))
            total += r["n"]
        shared = spark.sparkContext.broadcast(groups)
        tasks = found.select("path", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("place")).repartition(min(4 * store.parts(spark), max(1, total)))
        got = store.saved(tasks.mapInArrow(_walk(shared, total, cosine), "id long, links long, root long"), f"{folder}/links")
        comp = components(got.select(F.col("id").alias("u"), F.col("root").alias("v")), f"{folder}/cc").withColumnRenamed("u", "id")
        links = got.groupBy("id").agg(F.sum("links").alias("links"))
        named = points.select("k1", "k2", "id", "mult").join(links, "id", "left").join(comp, "id", "left")
        named = store.saved(named.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), f"{folder}/named")
        out = keyed.select("vec_id", "k1", "k2").join(named, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2"))).select("vec_id", "n_links", "component_id").unionByName(none)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
