"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import store


def _forest(batches):
    """Spanning forest of the edges of one partition, in blocks of bounded size.

    Fewer edges with the same components reach the shuffles."""
    import pandas as pd

    for pdf in batches:
        up: dict[int, int] = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        rows = [(x, r) for x in up if (r := root(x)) != x]
        yield pd.DataFrame(rows, columns=["u", "v"], dtype="int64")


def _star(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star; both take minima by a partial aggregate and an equi-join."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    low2 = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(low2, "u")
    return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, folder: str, rounds: int = 60) -> DataFrame:
    """``edges``: columns u, v (long). Returns (u, component) with the smallest id reachable, for
    every vertex that is not itself the smallest of its component. Null ends and loops are ignored.

    Every round is written to ``folder``; the number of rounds grows with the logarithm of the
    longest path, not with the size of a component. No edge comes to the driver.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, seen = store.saved(edges.mapInPandas(_forest, "u long, v long"), f"{folder}/edges-0"), None
    for k in range(1, rounds + 1):
        now = store.saved(_star(now), f"{folder}/edges-{k}")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select("u", F.col("v").alias("component"))
        seen = mark
    raise RuntimeError(f"no fixed point after {rounds} rounds")
