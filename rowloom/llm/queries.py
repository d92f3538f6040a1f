"""One query per corpus operator: production parameters, whole tables, the contract's digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import bpe, ctw, language_id, media, packing, quality, secrets, simhash, token_counts, warc
from rowloom.llm.common import doc_crc, materialise

CAPACITY, END_ID, TOKEN_LIMIT = 1024, 2, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_json() -> str:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_json(), capacity=CAPACITY, end_id=END_ID)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    return warc.archive(pages).select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fits_4096: code points of the longest prefix within the limit, from the prefix table of a text beyond it."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), budgets=(TOKEN_LIMIT,))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (doc_crc() % 7 == 2).alias("held_out"), (doc_crc() % 7 != 2).alias("in_training"))
    return ctw.score(docs, "in_training", carry=("doc_id", "held_out")).drop("in_training")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.shown(F.col("base_spans")), 256).alias("base_sha256"), secrets.shown(F.col("spans")).alias("spans"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is stored as a picture inside a page of the whole text; the page's sequence is put together again around what the stored picture holds.

    position, n_items, chars_before and chars_after place the picture among the page's text runs.
    """
    # rows that repeat a doc_id are pages of their own
    docs = table(spark, sf_dir, "documents").select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("doc"), "text")
    stored = materialise(media.store(docs), "media")
    paged = media.pages(docs, key="doc").select(F.col("doc").withField("n_bytes", F.col("n_bytes")).alias("doc"), "page")
    sequences = materialise(media.outline(media.parse(paged, key="doc", column="page")), "sequences")
    found = media.resolve(media.references(sequences, key="doc"), media.features(stored), stored.count())
    whole = media.assemble(sequences, found, key="doc")
    chars = lambda keep: F.aggregate(F.filter("items", keep), F.lit(0).cast("bigint"), lambda n, i: n + F.coalesce(i["chars"], F.lit(0)))
    shown = whole.withColumn("n_items", F.size("items")).select("doc", "n_items", "items", F.explode(F.filter("items", lambda i: i["digest"].isNotNull())).alias("i"))
    return shown.select(
        "doc.doc_id", "doc.n_bytes", "i.media.payload_bytes", F.col("i.digest").alias("payload_sha256"), "i.media.tail_crc32", "i.media.media_bytes", "i.media.media_sha256", "i.media.feature", "i.position", "i.caption",
        "n_items", chars(lambda x: x["position"] < F.col("i.position")).alias("chars_before"), chars(lambda x: x["position"] > F.col("i.position")).alias("chars_after"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", doc_crc() % 5 == 0)
    fitted = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.identify(docs, fitted, keep=("doc_id", "held_out"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_context_tree_weighting": op4_context_tree_weighting,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_media_columns": op9_media_columns,
    "op10_language_id": op10_language_id,
}

#: The rules of the secret scan, written out for SQL on their own: kind, place in the list, pattern, group whose length counts, least and greatest length.
_KINDS = r"""
    ('assign', 1, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6, 2147483647),
    ('access', 2, 'AKIA[A-Z0-9]+', 0, 20, 2147483647),
    ('hex', 3, '[0-9a-f]+', 0, 24, 2147483647),
    ('weak_id', 4, 'AKIA[A-Z0-9]+', 0, 8, 19),
    ('weak_key', 5, '[A-Za-z0-9+/]+', 0, 20, 2147483647),
    ('weak_hex', 6, '[0-9a-f]+', 0, 16, 23),
    ('endpoint', 7, 'https?://[A-Za-z0-9.-]+', 0, 10, 2147483647)"""

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
    """,
    "op8_secret_scan": f"""
        WITH k(kind, rank, pattern, grp, low, high) AS (VALUES {_KINDS}),
        t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        a AS (SELECT doc_id, kind, rank, low, high, regexp_extract_all(text, pattern, 0) AS ms, regexp_extract_all(text, pattern, CASE WHEN grp = 2 THEN 2 ELSE 0 END) AS vs, string_split_regex(text, pattern) AS sp FROM t, k WHERE regexp_matches(text, pattern)),
        m AS (SELECT doc_id, kind, rank, low, high, generate_subscripts(ms, 1) AS i, unnest(ms) AS match, unnest(vs) AS val, unnest(list_slice(sp, 1, len(ms))) AS gap FROM a),
        placed AS (SELECT *, CAST(sum(length(gap) + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM m),
        s AS (SELECT doc_id, kind, rank, e - length(match) AS s, e FROM placed WHERE length(val) BETWEEN low AND high AND (kind <> 'weak_key' OR (regexp_matches(match, '[A-Z]') AND regexp_matches(match, '[a-z]') AND regexp_matches(match, '[0-9]')))),
        w AS (
            SELECT x.doc_id, x.kind, x.rank, x.s, x.e FROM s x JOIN s y ON y.doc_id = x.doc_id AND y.s >= x.s - 256 AND y.s < x.e + 256 AND (y.e <= x.s OR y.s >= x.e)
            WHERE x.kind LIKE 'weak%' GROUP BY ALL
            HAVING CASE WHEN x.kind = 'weak_id' THEN bool_or(y.kind IN ('weak_key', 'weak_hex', 'hex', 'assign')) AND bool_or(y.kind = 'endpoint') ELSE bool_or(y.kind IN ('access', 'weak_id')) END
        ),
        base AS (SELECT * FROM s WHERE rank <= 3),
        every AS (SELECT * FROM base UNION ALL SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
        shown AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank <= 3) AS b,
            count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM every GROUP BY 1)
        SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN shown USING (doc_id)
    """,
}
