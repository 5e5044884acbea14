"""Mixing sources to target weights by capped water-filling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import store

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float, folder: str, share: float = 1.0) -> DataFrame:
    """``sources`` (source, source_size) -> and weight, target, total_target.

    Sources are numbered by code point, null last, and get ``weights`` in turn. Water-filling: with
    level x a source's target is min(x * weight, cap * size). Each round clamps every source above
    its cap and reshares what is left by weight among the others, until none is above; only a
    round's three sums come to the driver.
    """
    spark = sources.sparkSession
    n = store.parts(spark)
    # numbers without a window over all sources: ordered ranges, a running number in each
    ranged = sources.repartitionByRange(n, F.col("source").isNull(), "source").select("*", F.spark_partition_id().alias("_range"))
    ranged = store.saved(ranged, f"{folder}/ranged")
    base, first = {}, 0
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():  # a row a range
        base[r["_range"]] = first
        first += r["count"]
    if not base:
        return sources.select("*", F.lit(0.0).alias("weight"), F.lit(0.0).alias("target"))
    starts = spark.createDataFrame(list(base.items()), "_range int, _base long")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1
    numbered = ranged.withColumn("_k", rank).join(F.broadcast(starts), "_range")  # at most n rows
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("_base") + F.col("_k")) % len(weights) + 1).cast("int"))
    table = store.saved(numbered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(cap)).alias("_cap")), f"{folder}/weighed")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, clamped = 0.0, -1
    over = F.lit(False)
    while True:
        r = table.agg(F.sum(F.when(over, F.col("_cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if r[2] == clamped or not r[1]:
            break
        clamped = r[2]
        level = (total - r[0]) / r[1]
        over = F.col("weight") * F.lit(level) > F.col("_cap")
    return table.select("source", "source_size", "weight", F.when(over, F.col("_cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _fill(rows: DataFrame, need: DataFrame, buckets: int, nearest: bool, folder: str):
    """Words up to each source's need, in the order of bucket and hash. ``need``: (_s, _need).

    Sums by source and bucket show the bucket where the need runs out; its rows alone are ordered one
    by one. Returns (_s, _cut, _short): all rows in buckets before _cut are taken and _short words of
    the cut bucket; and that bucket's rows with their decision _more.
    """
    sums = store.saved(rows.groupBy("source", "_b").agg(F.sum("size").alias("words")), f"{folder}/sums")
    run = F.sum("words").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # at most `buckets` rows a source
    cuts = sums.withColumn("_before", F.coalesce(run, F.lit(0))).join(need, F.col("source").eqNullSafe(F.col("_s"))).where("_before < _need AND _need <= _before + words")
    cuts = store.saved(cuts.select(F.col("source").alias("_c"), F.col("_b").alias("_cut"), (F.col("_need") - F.col("_before")).alias("_short")), f"{folder}/cuts")
    none = F.when(F.col("_need") > 0, buckets).otherwise(-1)
    cuts = need.join(cuts, F.col("_s").eqNullSafe(F.col("_c")), "left").select("_s", F.coalesce("_cut", none).alias("_cut"), "_short")
    order = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.join(cuts, F.col("source").eqNullSafe(F.col("_s"))).where("_b = _cut").withColumn("_sum", F.sum("size").over(order))
    edge = edge.withColumn("_more", (F.col("_sum") - (F.col("size") / 2 if nearest else F.lit(0)) <= F.col("_short")).cast("int"))
    return cuts, store.saved(edge.select("doc_id", "source", "size", "_h", "_short", "_more"), f"{folder}/edge")


def _plan(docs: DataFrame, folder: str, weights: tuple[float, ...], cap: float, seed: int, buckets: int):
    """Sizes of all rows, the plan by source, and the rows of the buckets where a need runs out."""
    rows = store.saved(_keyed(docs.select("doc_id", "source", "text"), seed, buckets).drop("text"), f"{folder}/sizes")
    by_source = store.saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap, folder), f"{folder}/targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = by_source.withColumn("_whole", F.floor(rate).cast("int")).withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size")).withColumnRenamed("source", "_s")
    cut, edge = _fill(rows, plan.select("_s", "_need"), buckets, False, f"{folder}/first")
    used = edge.groupBy("source").agg((F.first("_short") - F.coalesce(F.sum(F.when(F.col("_more") == 1, F.col("size"))), F.lit(0))).alias("_left")).withColumnRenamed("source", "_c")
    left = cut.join(used, F.col("_s").eqNullSafe(F.col("_c")), "left").select("_s", "_cut", F.coalesce("_left", F.lit(0.0)).alias("_left"))
    left = store.saved(left, f"{folder}/left")
    # what a large document at the cut would have overshot is filled with smaller ones from behind it
    later = rows.join(left, F.col("source").eqNullSafe(F.col("_s"))).where(_small()).select(*rows.columns)
    cut2, edge2 = _fill(later, left.select("_s", F.col("_left").alias("_need")), buckets, True, f"{folder}/second")
    cut2 = cut2.select(F.col("_s").alias("_c"), F.col("_cut").alias("_cut2"))
    plan = plan.join(left.withColumnRenamed("_s", "_l"), F.col("_s").eqNullSafe(F.col("_l"))).join(cut2, F.col("_s").eqNullSafe(F.col("_c")))
    plan = store.saved(plan.drop("_l", "_c", "_need"), f"{folder}/plan")
    # rows alike in doc_id, source, size and hash can't be told apart later and share one decision
    both = edge.unionByName(edge2).groupBy("doc_id", "source", "size", "_h").agg(F.min("_more").alias("_more"))
    return rows, plan, store.saved(both.select(F.col("doc_id").alias("_d"), F.col("source").alias("_src"), F.col("size").alias("_n"), F.col("_h").alias("_hh"), "_more"), f"{folder}/edges")


def _small() -> Column:
    return (F.col("_b") > F.col("_cut")) & (F.col("size") > 0) & (F.col("size") * 2 <= F.col("_left"))


def _keyed(docs: DataFrame, seed: int, buckets: int) -> DataFrame:
    h = F.xxhash64(F.col("doc_id").cast("long"), F.length("text"), F.lit(seed))
    return docs.withColumn("size", word_count(F.col("text").cast("string"))).withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))


def _decided(keyed: DataFrame, plan: DataFrame, edge: DataFrame) -> DataFrame:
    """Adds repeats. Rows outside the cut buckets need the plan alone."""
    known = keyed.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    at_cut = (F.col("_b") == F.col("_cut")) | ((F.col("_b") == F.col("_cut2")) & _small())
    inner = known.where(~at_cut).withColumn("_more", ((F.col("_b") < F.col("_cut")) | ((F.col("_b") < F.col("_cut2")) & _small())).cast("int"))
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_src")) & (F.col("size") == F.col("_n")) & F.col("_h").eqNullSafe(F.col("_hh"))
    near = known.where(at_cut).join(edge, on).drop("_d", "_src", "_n", "_hh")
    return inner.unionByName(near).withColumn("repeats", F.col("_whole") + F.col("_more"))


def repetitions(docs: DataFrame, folder: str, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 17, buckets: int = 1024) -> DataFrame:
    """Mix ``docs`` (doc_id, source, text): doc_id, size, source, source_size, target, repeats, taken.

    A source with rate r = target / source_size takes each document floor(r) times, and a seeded
    sample once more: documents in the order of a hash of doc_id, text length and seed, up to the
    remaining words; what then is left over is filled with documents of at most half of it. The
    hash's range is cut into ``buckets``; sums by source and bucket give the bucket where the
    remainder runs out, and that bucket alone is ordered row by row. So no task holds a source.
    Reruns agree.

    Null text: size 0. Null source: a source of its own, last. A document of size 0, and every
    document of a source without words, is taken 0 words. Repeated rows count each; rows alike in
    doc_id, source, size and text length share one decision. An empty table gives no rows. Columns besides
    these three are not read.
    """
    rows, plan, edge = _plan(docs, folder, weights, cap, seed, buckets)
    out = _decided(rows, plan, edge)
    return out.select("doc_id", "size", "source", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(docs: DataFrame, folder: str, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 17, buckets: int = 1024) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (not at all for 0)."""
    _, plan, edge = _plan(docs, folder, weights, cap, seed, buckets)
    # the table's columns travel in a struct, so that none clashes with those of the plan
    keyed = _keyed(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", F.struct("*").alias("_row")), seed, buckets).drop("text")
    out = _decided(keyed, plan, edge).where("repeats > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("_row.*")
