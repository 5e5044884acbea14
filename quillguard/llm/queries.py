"""Thin queries over the operators, one for each, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import covertree, fingerprints, langid, lm, minhash, mixing, packing, store, tokens, urls, warc

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return store.prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc_history(spark, sf_dir):
    """Pages have no capture time of their own: a second a page from a fixed day on."""
    folder = store.scratch(spark, "op1")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col("page_id"), F.lit(0))), "yyyyMMddHHmmss").cast("long")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", stamp.alias("stamp"))
    runs = warc.write(warc.deduplicated(pages, folder), folder)
    records = warc.read(warc.merged(spark, runs, folder))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packed_tokens(spark, sf_dir):
    manifest = tokens.write(table(spark, sf_dir, "documents"), store.scratch(spark, "op2"), tokenizer(), end_id=1)
    return tokens.read(spark, manifest)


def op3_deleted_interpolation(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"), store.scratch(spark, "op3"), is_table=True)


def op4_kneser_ney(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    held = F.coalesce(langid.folds(F.col("doc_id")) == 2, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op5_chunk_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"), store.scratch(spark, "op5"))


def op6_cover_tree(spark, sf_dir):
    return covertree.near(table(spark, sf_dir, "embeddings"), store.scratch(spark, "op6"), cosine=0.95)


def op7_best_fit(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), capacity=2048, end_id=0)


def op8_water_filling(spark, sf_dir):
    r = mixing.repetitions(table(spark, sf_dir, "documents"), store.scratch(spark, "op8"))
    return r.select("doc_id", "size", "source", "source_size", "target", "repeats", "taken")


def op9_url_rules(spark, sf_dir):
    """A page's path ends in the number of the document it shows; that document's label is the URL's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.try_to_number(F.regexp_extract(urls.path(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1), F.lit("9" * 18)).cast("long")
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.withColumn("doc_id", number).join(labels, "doc_id").select("url", "bad")
    return urls.judge(pages, labelled, URL_RULES, store.scratch(spark, "op9"))


def op10_tensored_minhash(spark, sf_dir):
    return minhash.clusters(table(spark, sf_dir, "documents"), store.scratch(spark, "op10"), k=2, percent=80)


QUERIES = {f.__name__: f for f in (op1_warc_history, op2_packed_tokens, op3_deleted_interpolation, op4_kneser_ney, op5_chunk_fingerprints, op6_cover_tree, op7_best_fit, op8_water_filling, op9_url_rules, op10_tensored_minhash)}
_REACH = """reach AS (SELECT id AS u, id AS c FROM ids UNION SELECT l.v, r.c FROM reach r JOIN (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links) l ON l.u = r.u)"""

#: SQL of the operators that SQL can express on the small tables; tests hold the others against brute force.
ORACLE: dict[str, str] = {
    "op1_warc_history": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON f.d = p.d""",
    "op6_cover_tree": f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), ids AS (SELECT vec_id AS id FROM v),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95), {_REACH}
SELECT id AS vec_id, CAST((SELECT count(*) FROM links WHERE x = id OR y = id) AS BIGINT) AS n_links, min(c) AS component_id, min(c) = id AS kept FROM ids JOIN reach ON u = id GROUP BY id""",
    "op10_tensored_minhash": f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda t: t <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w), ids AS (SELECT doc_id AS id FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s), pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * k >= 80 * (len(a.s) + len(b.s) - k)), {_REACH}
SELECT id AS doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, min(c) AS component_id, min(c) = id AS kept FROM ids JOIN reach ON u = id JOIN s ON s.doc_id = id GROUP BY id""",
}
