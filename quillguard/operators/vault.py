"""Reversible dictionary of tokens: assignment, decoding, sealing."""

from __future__ import annotations

import base64
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import canonical, wire
from ..functions.kernel import Kernel, Scope
from ..functions.patterns import Detector, detectors
from ..shipping import ship

#: A private-use character that frames local marks.
MARK = "\ue000"
SCHEMA = "kind string, n long, token string, value string"
FOUND = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("found", T.ArrayType(T.StructType([T.StructField(c, t) for c, t in (("i", T.IntegerType()), ("kind", T.StringType()), ("token", T.StringType()), ("value", T.StringType()))]))),
])


def split_token(token: Column) -> tuple[Column, Column]:
    """Kind and number of a token, split at its last underscore."""
    return F.regexp_extract(token, r"^(.+)_(\d+)$", 1), F.regexp_extract(token, r"^(.+)_(\d+)$", 2).try_cast("long")


def assign(pairs: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """Dictionary for ``pairs`` (kind, value, ord, i): known pairs keep their token, new ones are numbered
    within their kind by first appearance, after the highest number so far. Returns the whole vault."""
    first = pairs.groupBy("kind", "value").agg(F.min(F.struct("ord", "i")).alias("at"))
    if vault is not None:
        first = first.join(vault.select("kind", "value"), ["kind", "value"], "left_anti")
    # numbers by kind and bucket of appearance, so that a frequent kind is not one task's window
    cut = first.withColumn("b", F.floor(F.col("at.ord") / 65536))
    sizes = cut.groupBy("kind", "b").agg(F.count("*").alias("size"))
    before = sizes.select("kind", "b", F.coalesce(F.sum("size").over(Window.partitionBy("kind").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("kind", "b").orderBy("at"))
    new = cut.withColumn("own", own).join(before, ["kind", "b"])
    if vault is not None:
        new = new.join(vault.groupBy("kind").agg(F.max("n").alias("top")), "kind", "left")
    n = F.col("before") + F.col("own") + (F.coalesce("top", F.lit(0)) if vault is not None else F.lit(0))
    new = new.withColumn("n", n.cast("long")).select("kind", "n", F.concat("kind", F.lit("_"), F.col("n").cast("string")).alias("token"), "value")
    return new if vault is None else vault.select("kind", "n", "token", "value").unionByName(new)


def _detect(kernel: Kernel):
    @F.pandas_udf(FOUND)
    def detect(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            local: dict[tuple[str, str], str] = {}

            def number(kind, value, local=local):
                # a mark no text has, so that values and tokens of the text itself can't be taken for one
                return local.setdefault((kind, value), f"{MARK}{kind}_{len(local)}{MARK}")

            scope = Scope(assign=number)
            out = None if t is None else kernel.redact(t, scope)
            rows.append((out, scope.counts, [{"i": i, "kind": k, "token": m, "value": v} for i, ((k, v), m) in enumerate(local.items())]))
        return pd.DataFrame(rows, columns=["text", "counts", "found"])

    return detect


def redact_global(df: DataFrame, order: str, column: str = "text", pack: list[Detector] | None = None, vault: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Redact with numbers that hold for all rows: (``df`` with redacted and counts, the vault).

    Detection runs once in parallel with local marks; distinct values are numbered by (``order``, place in
    the text); marks are then replaced through a join on the row. Values that hold an earlier stage's
    token are numbered after it and stored with its final form, as a sequential pass would store them.
    ``order`` is a unique number of the row.
    """
    ship(df.sparkSession)
    kernel = Kernel(pack if pack is not None else detectors())
    hit = df.withColumn("_d", _detect(kernel)(F.col(column)))
    rows = hit.select(F.col(order).alias("ord"), F.explode("_d.found").alias("f")).select("ord", "f.*").persist()
    known = vault
    # kinds with values that hold earlier tokens are numbered after all others, in stage order
    nesting = {r["kind"] for r in rows.where(F.col("value").contains(MARK)).select("kind").distinct().collect()}
    kinds = list(dict.fromkeys(d.kind for d in kernel.pack))
    passes = [[k for k in kinds if k not in nesting], *([k] for k in kinds if k in nesting)]
    done = None  # (ord, token, final)
    for some in passes:
        own = rows.where(F.col("kind").isin(some))
        if done is not None:
            nested = own.where(F.col("value").contains(MARK)).join(done.select("ord", F.col("token").alias("t"), "final"), "ord").where(F.col("value").contains(F.col("t")))
            fixed = nested.groupBy("ord", "i", "value").agg(F.aggregate(F.collect_list(F.struct("t", "final")), F.first("value"), lambda acc, x: F.replace(acc, x["t"], x["final"])).alias("v"))
            own = own.join(fixed.select("ord", "i", "v"), ["ord", "i"], "left").select("ord", "i", "kind", "token", F.coalesce("v", "value").alias("value"))
        known = assign(own, known)
        final = own.join(known.select("kind", "value", F.col("token").alias("final")), ["kind", "value"]).select("ord", "token", "final")
        done = final if done is None else done.unionByName(final)
    marks = done.groupBy("ord").agg(F.map_from_entries(F.collect_list(F.struct("token", "final"))).alias("_m"))  # a row's own values
    out = hit.join(marks, F.col(order) == F.col("ord"), "left").drop("ord")
    parts, found = F.split("_d.text", f"{MARK}[A-Z_]+[0-9]+{MARK}", -1), F.regexp_extract_all("_d.text", F.lit(f"({MARK}[A-Z_]+[0-9]+{MARK})"), F.lit(1))
    text = F.array_join(F.zip_with(parts, F.concat(F.transform(found, lambda t: F.coalesce(F.try_element_at("_m", t), t)), F.array(F.lit(""))), lambda p, t: F.concat(p, t)), "")
    return out.withColumn("redacted", F.when(F.col("_m").isNull(), F.col("_d.text")).otherwise(text)).withColumn("counts", F.col("_d.counts")).drop("_d", "_m"), known


def reveal(df: DataFrame, vault: DataFrame, column: str = "text", into: str = "revealed", map_limit: int = 100_000) -> DataFrame:
    """Replace known tokens once; unknown ones stay. A vault of at most ``map_limit`` entries travels as one
    map; a larger one is joined by token, and a text is put together again from its parts."""
    inner = r"\[([A-Z]+_[0-9]+)\]"
    parts, tokens = F.split(column, r"\[[A-Z]+_[0-9]+\]", -1), F.regexp_extract_all(column, F.lit(inner), F.lit(1))
    glue = lambda values: F.array_join(F.zip_with(parts, F.concat(values, F.array(F.lit(""))), lambda p, t: F.concat(p, t)), "")
    if vault.limit(map_limit + 1).count() <= map_limit:
        m = vault.agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_v"))
        return df.crossJoin(F.broadcast(m)).withColumn(into, glue(F.transform(tokens, lambda t: F.coalesce(F.try_element_at("_v", t), F.concat(F.lit("["), t, F.lit("]")))))).drop("_v")
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    used = keyed.select("_row", F.posexplode(tokens).alias("p", "token")).join(vault.select("token", "value"), "token", "left")
    values = used.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("value", F.concat(F.lit("["), "token", F.lit("]"))).alias("v")))), lambda x: x["v"]).alias("_t"))
    return keyed.join(values, "_row", "left").withColumn(into, F.coalesce(glue(F.col("_t")), F.col(column))).drop("_row", "_t")


def reveal_bodies(df: DataFrame, vault: DataFrame, column: str = "body", into: str = "revealed", map_limit: int = 100_000) -> DataFrame:
    """Reveal in every string of JSON bodies and write them canonically, so that values stay escaped. A
    body that is not JSON stays. A vault of at most ``map_limit`` entries travels to the workers; of a
    larger one each body gets the entries it names, by a join on the token."""
    import regex

    ship(df.sparkSession)
    token = r"\[([A-Z]+_[0-9]+)\]"

    def one(body, known):
        try:
            node = canonical.loads(body or "")
        except (ValueError, RecursionError):
            return body
        return canonical.dumps(wire.every_string(node, lambda s: regex.sub(token, lambda m: known.get(m[1], m[0]), s)))

    pairs = vault.select("token", "value")
    some = pairs.limit(map_limit + 1).collect()
    if len(some) <= map_limit:
        shared = df.sparkSession.sparkContext.broadcast({r["token"]: r["value"] for r in some})

        @F.pandas_udf("string")
        def apply(bodies: pd.Series) -> pd.Series:
            return bodies.map(lambda b: one(b, shared.value))

        return df.withColumn(into, apply(F.col(column)))

    @F.pandas_udf("string")
    def with_own(bodies: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([one(b, k if k is not None else {}) for b, k in zip(bodies, known)])

    keyed = df.withColumn("_row", F.xxhash64(F.col(column)))  # bodies that are alike name the same tokens
    used = keyed.select("_row", F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(token), F.lit(1)))).alias("token")).distinct()
    own = used.join(pairs, "token").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_known"))
    return keyed.join(own, "_row", "left").withColumn(into, with_own(F.col(column), F.col("_known"))).drop("_row", "_known")


# --- sealing ---------------------------------------------------------------------------------------


def decode_key(data: bytes) -> bytes:
    """32 bytes: base64, or raw."""
    try:
        raw = base64.b64decode(data.strip(), validate=True)
        if len(raw) == 32:
            return raw
    except ValueError:
        pass
    if len(data) == 32:
        return data
    raise ValueError("vault key must be 32 bytes (raw or base64)")


def load_key(encoded: str = "", keyfile: str = "") -> bytes | None:
    """The encoded key before the file; None without either."""
    if encoded:
        return decode_key(encoded.encode())
    return decode_key(Path(keyfile).read_bytes()) if keyfile else None


def seal(vault: DataFrame, key: bytes) -> DataFrame:
    """One row: the vault as a JSON map under AES-256-GCM (nonce, text, tag)."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "value"))))
    return vault.agg(F.aes_encrypt(F.to_json(entries), F.lit(key), F.lit("GCM")).alias("sealed"))


def unseal(sealed: DataFrame, key: bytes) -> DataFrame:
    """The vault back from ``sealed``; a wrong key is an error."""
    plain = F.try_aes_decrypt("sealed", F.lit(key), F.lit("GCM")).cast("string")
    text = F.when(plain.isNull(), F.raise_error(F.lit("the vault does not open with this key"))).otherwise(plain)
    rows = sealed.select(F.explode(F.from_json(text, "map<string,string>")).alias("token", "value"))
    kind, n = split_token(F.col("token"))
    return rows.select(kind.alias("kind"), n.alias("n"), "token", "value")


def save(vault: DataFrame, key: bytes, path: str) -> None:
    """Write the sealed vault at once and only for its owner."""
    data, to = bytes(seal(vault, key).first()["sealed"]), Path(path)
    part = to.with_name(to.name + ".part")
    part.touch(0o600)
    part.write_bytes(data)
    part.replace(to)


def load(spark: SparkSession, key: bytes, path: str) -> DataFrame:
    """The vault at ``path``; empty when there is none."""
    if not Path(path).exists():
        return spark.createDataFrame([], SCHEMA)
    return unseal(spark.createDataFrame([(Path(path).read_bytes(),)], "sealed binary"), key)


__all__ = ["assign", "decode_key", "load", "load_key", "redact_global", "reveal", "reveal_bodies", "save", "seal", "split_token", "unseal"]
