"""URL filtering by association rules, with fixed host and path rules before them; no Python on executors."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from . import store

BAD = "y:block"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or none: empty."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(raw, upper, upper.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct items of a URL: scheme, each host label, the registered suffix, path segments without
    digits, the last segment's extension, query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("[0-9]"))
    keys = F.filter(F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    one = lambda p, c: F.filter(F.array(F.concat(F.lit(p), c)), lambda x: x != p)
    parts = [
        one("s:", F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        one("d:", F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise("")),
        F.transform(segments, lambda x: F.concat(F.lit("p:"), x)),
        one("e:", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)),
        F.transform(keys, lambda x: F.concat(F.lit("q:"), x)),
    ]
    return F.array_distinct(F.filter(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in parts)), lambda x: x.isNotNull()))


def mine(labelled: DataFrame, folder: str, min_support: float, min_confidence: float, min_count: int) -> DataFrame:
    """Rules from ``labelled`` (url, bad boolean): antecedent, confidence, support, n, verdict.

    FP-growth over each URL's tokens with its label as one more item; rules whose consequent is the
    label survive with ``min_support`` (a share of rows), ``min_count`` rows and ``min_confidence``.
    A rule is dropped when a shorter one with no less confidence covers it.
    """
    both = labelled.where("url IS NOT NULL AND bad IS NOT NULL").select(host(F.col("url")).alias("h"), path(F.col("url")).alias("p"), "url", "bad")
    items = both.select(F.concat(tokens(F.col("h"), F.col("p"), F.col("url")), F.array(F.when(F.col("bad"), BAD).otherwise("y:allow"))).alias("items"))
    items = store.saved(items, f"{folder}/items")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=store.parts(labelled.sparkSession)).fit(items)
    freq = store.saved(model.freqItemsets, f"{folder}/itemsets")
    ante = F.array_sort(F.filter("items", lambda x: ~x.startswith("y:")))
    with_label = freq.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(ante.alias("antecedent"), F.col("freq").alias("n_bad"))
    without = freq.where(~F.exists("items", lambda x: x.startswith("y:"))).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("n"))
    rules = with_label.join(without, "antecedent").withColumn("confidence", F.col("n_bad") / F.col("n")).where((F.col("confidence") >= min_confidence) & (F.col("n_bad") >= min_count))
    rules = store.saved(rules.select("antecedent", "confidence", "n", "n_bad"), f"{folder}/rules")
    # a more general rule shares a token with the one it covers: an inverted index, not all pairs
    a = rules.select(F.explode("antecedent").alias("t"), F.col("antecedent").alias("short"), F.col("confidence").alias("c"))
    b = rules.select(F.explode("antecedent").alias("t"), F.col("antecedent").alias("long"), F.col("confidence").alias("k"))
    covered = a.join(b, "t").where((F.size("short") < F.size("long")) & (F.col("c") >= F.col("k")) & (F.size(F.array_except("short", "long")) == 0)).select(F.col("long").alias("antecedent")).distinct()
    return store.saved(rules.join(covered, "antecedent", "left_anti"), f"{folder}/pruned")


def mined_blocks(urls: DataFrame, rules: DataFrame, folder: str) -> DataFrame:
    """Distinct (url, confidence) that some rule blocks. Index: each rule under its rarest token, so
    a URL meets a rule once, when it has that token; the other tokens are then looked up in the URL.
    """
    counts = rules.select(F.explode("antecedent").alias("t")).groupBy("t").agg(F.count("*").alias("uses"))
    rarest = rules.select("antecedent", "confidence", F.explode("antecedent").alias("t")).join(counts, "t").groupBy("antecedent", "confidence").agg(F.min(F.struct("uses", "t")).alias("m"))
    index = store.saved(rarest.select("antecedent", "confidence", F.col("m.t").alias("t")), f"{folder}/index")
    some = urls.where("url IS NOT NULL").select("url", tokens(host(F.col("url")), path(F.col("url")), F.col("url")).alias("tokens"))
    hits = some.select("url", "tokens", F.explode("tokens").alias("t")).join(index, "t").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct<rule, verdict>; null when none fits. ``rules``: (verdict,
    host, path) on the driver; each fits its host and all subdomains where the path starts with its own."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], folder: str, min_support: float = 0.002, min_confidence: float = 0.6, min_count: int = 20) -> DataFrame:
    """``pages`` with host, path, rule, verdict, confidence.

    The longest fixed rule decides; else a mined rule blocks; else the URL is allowed. A null URL or
    one without ``://`` has empty host and path, fits no rule and is allowed when no token rule hits
    it. Repeated URLs get the same verdict; a URL that a third of all rows share is judged once.
    Columns of ``pages`` are kept, but for clashing names, which this function's own replace.
    An empty label table mines nothing.
    """
    own = ["host", "path", "rule", "verdict", "confidence"]
    kept = [c for c in pages.columns if c not in own]
    mined = labelled.where("url IS NOT NULL AND bad IS NOT NULL").take(1)
    base = pages.select(*kept).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("_f", fixed_rule(F.col("host"), F.col("path"), rules))
    if mined:
        open_urls = base.where("_f IS NULL").select("url").distinct()
        found = mined_blocks(open_urls, mine(labelled, folder, min_support, min_confidence, min_count), folder)
        found = store.saved(found.select(F.col("url").alias("_u"), "confidence"), f"{folder}/found")
        base = base.join(found, F.col("url") == F.col("_u"), "left").drop("_u")
    else:
        base = base.withColumn("confidence", F.lit(None).cast("double"))
    verdict = F.coalesce(F.col("_f.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return base.select(*kept, "host", "path", F.col("_f.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("_f").isNull(), F.col("confidence")).alias("confidence"))
