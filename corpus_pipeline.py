"""From documents to packed training sequences, a stage at a time.

Each stage takes the documents that the one before kept and returns documents
again (the last one: packed pieces); its result is written and read back, so a
stage starts from files whatever happens to the executors of the one before.

- language: documents in which no language can be told (no text, no letter) go;
- near_duplicates: of each group of near-duplicates the smallest id stays;
- decontaminate: documents that hold a window of a benchmark item go;
- secrets: the secrets in a text are replaced, the document stays;
- pack: whole documents become pieces placed in sequences of 4096 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from proxyspark.llm import decontaminate, langid, minhash, packing, secret_scan
from proxyspark.llm.common import cut, table

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark, docs, sf_dir):
    """Rejects what is ``und``; profiles come from the labelled documents themselves.

    Every row is judged by its own text, whatever its id; NULL and letterless texts go.
    """
    profiles = langid.learn(docs.select("doc_id", "text", "lang"))
    told = langid.predict(docs.where("text IS NOT NULL"), profiles, carry=_COLUMNS[1:])
    return told.where(F.col("lang_pred") != langid.UNKNOWN).select(_COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """Keeps the smallest id of each component; rows that repeat an id are one document
    and stay together. A row without an id is in no component and goes."""
    kept = minhash.link(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(_COLUMNS)


def decontaminate_(spark, docs, sf_dir):
    """Drops the rows whose text holds a benchmark window, whatever their id."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), carry=_COLUMNS[1:])
    return found.where("NOT contaminated").select(_COLUMNS)


def secrets(spark, docs, sf_dir):
    """Replaces the secrets of each row's own text and counts its characters anew."""
    found = secret_scan.scan(docs, carry=["lang", "source", "n_chars"])
    n_chars = F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n_chars.cast("long").alias("n_chars"))


def pack(spark, docs, sf_dir):
    """Pieces of at most 4096 ids, each with its sequence and its place there."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1))


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate_),
    ("secrets", secrets), ("pack", pack)]

#: Near-duplicates need a closure and the tokenizer a library: not for SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
