"""The operators of this package as queries, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from proxyspark.llm import (
    decontaminate,
    extract,
    langid,
    merkle,
    minhash,
    packing,
    quality,
    secret_scan,
    substrings,
    tokenfiles,
    topk,
    warc,
    whitening,
)
from proxyspark.llm.common import table


def held_out(doc_id: str = "doc_id"):
    """Documents that language profiles never learn from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def op1_minhash(spark, sf_dir):
    return minhash.link(table(spark, sf_dir, "documents"))


def op2_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return langid.predict(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op4_packing(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), path, 1))


def op5_secrets(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("redacted")


def op6_substrings(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_warc(spark, sf_dir):
    return warc.archive(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_tokenfiles(spark, sf_dir):
    return tokenfiles.token_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op9_decontaminate(spark, sf_dir):
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_extract(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "pages"))


def op11_merkle(spark, sf_dir):
    return merkle.verify(table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0)).select("query_id", "rank", "vec_id", "score")


QUERIES = {f.__name__: f for f in (
    op1_minhash, op2_langid, op3_quality, op4_packing, op5_secrets, op6_substrings, op7_warc, op8_tokenfiles,
    op9_decontaminate, op10_extract, op11_merkle, op12_whitening, op13_topk)}

SQL = {
    "op7_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                          sha1(coalesce(html, '')) AS payload_digest FROM pages),
             r AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN last <> page_id THEN last END AS refers_to
        FROM p LEFT JOIN r USING (payload_digest)""",
    "op13_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
