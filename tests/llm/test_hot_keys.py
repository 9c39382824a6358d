"""Languages and payloads that many rows share, and the rank-order distance restated."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from proxyspark.llm import langid, warc


def plain_profile(text, top=langid.PROFILE):
    """Grams of a text by falling count, ties by their code points."""
    letters = [c.lower() if c.isalpha() else " " for c in f" {text} "]
    letters = [c for i, c in enumerate(letters) if c != " " or not i or letters[i - 1] != " "]
    counts = Counter(c for c in letters if c != " ")
    counts.update("".join(letters[i:i + 2]) for i in range(len(letters) - 1))
    counts.update("".join(letters[i:i + 3]) for i in range(len(letters) - 2) if letters[i + 1] != " ")
    code = lambda gram: sum(ord(c) << 21 * k for k, c in enumerate(reversed(gram)))
    return [code(g) for g in sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]]


def plain_prediction(text, profiles, top=langid.PROFILE):
    own = plain_profile(text, top)
    if not own:
        return langid.UNKNOWN, 0.0
    cost = {
        name: sum(abs(p.index(g) - r) if g in p else top for r, g in enumerate(own)) for name, p in profiles.items()}
    best = min(sorted(cost), key=cost.get)
    return best, 1 - cost[best] / (len(own) * top)


def test_prediction_is_the_least_out_of_place_distance(spark, docs_of):
    rng = random.Random(5)
    alphabets = {"a": "abcde fgh", "b": "cdefgh ijk", "c": "äöü abc ß"}
    text = lambda name, n: "".join(rng.choice(alphabets[name]) for _ in range(n))
    rows = [(i, text(name, rng.choice([3, 30, 400])), name) for i, name in enumerate("abc" * 15)]
    rows += [(100, "a", "a"), (101, "12 34", "b"), (102, "", "c"), (103, None, "c"), (104, "zz zz zz", None)]
    docs = docs_of(rows)
    profiles = langid.learn(docs.select("doc_id", "text", "lang"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, profiles).collect()}
    for doc_id, words, *_ in rows:
        name, score = plain_prediction(words or "", profiles)
        assert got[doc_id][0] == name and abs(got[doc_id][1] - score) < 1e-12, doc_id


def test_sampling_by_parts_keeps_the_least_of_the_whole(spark, docs_of):
    """One language in nearly every row: the sample is the same however the table is cut."""
    docs = docs_of([(i, f"{'xyz'[i % 3] * (i % 7 + 1)} w{i}", "en" if i % 50 else "de") for i in range(3_000)])
    plain = docs.select("doc_id", "text", "lang")
    one = langid.learn(plain.coalesce(1), sample=40)
    assert langid.learn(plain.repartition(23), sample=40) == one
    assert set(one) == {"en", "de"}
    first = [r["doc_id"] for r in plain.where("lang = 'en'").orderBy(F.xxhash64("doc_id"), "doc_id").limit(40).collect()]
    assert langid.learn(plain.where((F.col("lang") == "de") | F.col("doc_id").isin(first)), sample=40) == one


def test_copies_of_one_page_and_empty_pages(spark):
    page = "<p>" + "copy " * 400 + "</p>"
    html = {i: page if i % 3 == 0 else ("" if i % 3 == 1 else f"{i} " * 300) for i in range(600)}
    rows = [(i, "u", h) for i, h in html.items()] + [(None, "u", page), (597, "u", page), (9_000, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = [(r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive(spark, pages).collect()]
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(i, sha(h), "revisit" if h == page and i != 597 else "response", 597 if h == page and i != 597 else None)
            for i, _, h in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for rows in ([], [(1, None, None)]):
        assert warc.archive(spark, spark.createDataFrame(rows, pages.schema)).count() == len(rows)


def test_language_portions_stay_small():
    import pyarrow as pa

    from proxyspark.llm import langid

    texts = ["word " * 2_000 for _ in range(90)] + [None, "x " * 400_000, "end"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = [p["text"] for p in langid.portions([batch])]
    assert [t for p in parts for t in p] == texts
    # A portion ends with the text that fills it; of those before it none is long.
    assert max(sum(len(t or "") for t in p[:-1]) for p in parts) < 250_000
