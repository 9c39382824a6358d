"""Finding search by words and by vector similarity.

Word search reads a token table: one row per (finding, field, position). Kind,
explanation and recommendation carry falling weights in a lightly stemmed form
without stop words; every alphanumeric run also counts, unstemmed, with the
lowest weight, so part of a host name matches. Stemming strips common English
endings only, so ranks approximate a full text engine's.
"""

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxyspark import fixed
from proxyspark.functions.text import split_words
from proxyspark.operators.access import visible_uploads
from proxyspark.operators.scope import Caller, clamp

STEMMED, SPLIT = "stemmed", "split"
# Endings cut from words of more than three letters, step by step; within a step
# the first that fits: (endings, ending that is exempt, letters cut, put back).
_STEPS = [
    [(["ies"], None, 3, "y")],
    [(["sses", "shes", "ches", "xes", "zes"], None, 2, "")],
    [(["s"], "ss", 1, "")],
    [(["ing"], None, 3, ""), (["ed"], None, 2, "")],
]


def _stem_text(word: str) -> str:
    for step in _STEPS:
        for endings, exempt, cut, back in step:
            if len(word) > 3 and word.endswith(tuple(endings)) and not (exempt and word.endswith(exempt)):
                word = word[:-cut] + back
                break
    return word


def with_stems(df: DataFrame, column: str) -> DataFrame:
    """Cut the endings of ``column``, one projection per step, so no step's
    expression is repeated inside the next."""
    for step in _STEPS:
        word = F.col(column)
        out = word
        for endings, exempt, cut, back in reversed(step):
            ends = reduce(lambda a, b: a | b, [word.endswith(e) for e in endings])
            if exempt:
                ends = ends & ~word.endswith(exempt)
            shorter = F.concat(F.left(word, F.length(word) - cut), F.lit(back))
            out = F.when((F.length(word) > 3) & ends, shorter).otherwise(out)
        df = df.withColumn(column, out)
    return df


def build_finding_index(findings: DataFrame, id_col: str = "id") -> DataFrame:
    """Token rows (finding_id, form, field, pos, token, weight)."""
    fields = [f for f in fixed.SEARCH_WEIGHTS if f in findings.columns]
    parts = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), F.coalesce(F.col(f), F.lit("")).alias("text"))
        for f, w in fixed.SEARCH_WEIGHTS.items() if f in fields
    ])).alias("p")
    # Words are a column before they are exploded: a field beside its words in one
    # expression would be copied, with its whole text, into every word's row.
    listed = findings.select(F.col(id_col).alias("finding_id"), parts).select(
        "finding_id", "p.field", "p.weight", split_words(F.col("p.text")).alias("words"))
    # An inner explode would have every text split once more, to tell which have words.
    words = listed.select("finding_id", "field", "weight", F.posexplode_outer("words").alias("pos", "token")).where("token IS NOT NULL")
    stop = F.col("token").isin(fixed.STOP_WORDS)
    forms = F.explode(F.when(stop, F.array(F.lit(SPLIT))).otherwise(F.array(F.lit(STEMMED), F.lit(SPLIT)))).alias("form")
    stems = with_stems(words.withColumn("_stem", F.col("token")), "_stem").select("*", forms)
    stemmed = F.col("form") == STEMMED
    return stems.select(
        "finding_id", "form", "field", "pos", F.when(stemmed, F.col("_stem")).otherwise(F.col("token")).alias("token"),
        F.when(stemmed, F.col("weight")).otherwise(F.lit(fixed.SPLIT_WEIGHT)).alias("weight"))


@dataclass
class Query:
    """A web-style query: OR of groups; a group needs all its words and
    phrases and none of its excluded ones. ``words`` is the plain form."""

    groups: list[dict] = field(default_factory=list)
    words: list[str] = field(default_factory=list)


def parse_query(text: str) -> Query:
    """``"a phrase"``, ``or`` and ``-word``; a short string, read on the driver."""
    if not 1 <= len(text.strip()) <= fixed.QUERY_CHARS:
        raise ValueError(f"query must have 1 to {fixed.QUERY_CHARS} characters")
    words = re.findall("[a-z0-9]+", text.lower())
    group = {"all": [], "phrases": [], "none": []}
    groups = [group]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text.lower()):
        if word == "or" and not minus:
            group = {"all": [], "phrases": [], "none": []}
            groups.append(group)
            continue
        found = re.findall("[a-z0-9]+", phrase or word)
        terms = [(i, _stem_text(w)) for i, w in enumerate(found) if w not in fixed.STOP_WORDS]
        if not terms:
            continue
        if len(terms) == 1 or not phrase and not minus:
            group["none" if minus else "all"] += [t for _, t in terms]
        else:
            group["none" if minus else "phrases"].append(tuple(terms) if not minus else terms[0][1])
    return Query([g for g in groups if any(g.values())], words)


def search_findings_text(index: DataFrame, findings: DataFrame, query: str, n: int | None = None,
                         id_col: str = "id") -> DataFrame:
    """Findings matching the query, best first, from those given.

    Pass only findings the caller may see. The index is read with a literal
    token filter; one row per finding and query word is all that is gathered.
    """
    parsed = parse_query(query)
    stems = sorted({t for g in parsed.groups for t in g["all"] + g["none"]}
                   | {t for g in parsed.groups for p in g["phrases"] for _, t in p})
    words = sorted(set(parsed.words))
    wanted = (
        ((F.col("form") == STEMMED) & F.col("token").isin(stems))
        | ((F.col("form") == SPLIT) & F.col("token").isin(words))
    )
    hits = index.where(wanted)
    has = {}
    aggs = []
    for form, tokens in ((STEMMED, stems), (SPLIT, words)):
        for t in tokens:
            name = f"_{form}_{t}"
            has[form, t] = F.col(name) > 0
            is_it = (F.col("form") == form) & (F.col("token") == t)
            aggs.append(F.coalesce(F.max(F.when(is_it, F.col("weight"))), F.lit(0.0)).alias(name))
    scored = hits.groupBy("finding_id").agg(*aggs)
    phrases = sorted({p for g in parsed.groups for p in g["phrases"]})
    for i, phrase in enumerate(phrases):
        scored = scored.join(_phrase_hits(index, phrase).withColumn(f"_p{i}", F.lit(True)), "finding_id", "left")

    def all_of(tests):
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out

    match = all_of([has[SPLIT, w] for w in words]) if words else F.lit(False)
    negative_only = False
    for g in parsed.groups:
        tests = [has[STEMMED, t] for t in g["all"]] + [~has[STEMMED, t] for t in g["none"]]
        tests += [F.coalesce(F.col(f"_p{phrases.index(p)}"), F.lit(False)) for p in g["phrases"]]
        match = match | all_of(tests)
        negative_only = negative_only or not (g["all"] or g["phrases"])
    rank = F.lit(0.0)
    for form, t in has:
        rank = rank + F.col(f"_{form}_{t}")
    base = findings.withColumnRenamed(id_col, "finding_id")
    joined = base.join(scored, "finding_id", "left" if negative_only else "inner")
    filled = joined.na.fill(0.0, [f"_{f}_{t}" for f, t in has])
    confidence = [F.desc("confidence")] if "confidence" in findings.columns else []
    return (
        filled.where(match).withColumn("rank", F.round(rank, 6))
        .orderBy(F.desc("rank"), *confidence, "finding_id").limit(clamp(n, fixed.SEARCH_LIMIT))
        .select(*base.columns, "rank")
    )


def visible_findings(findings: DataFrame, analyses: DataFrame, uploads: DataFrame, grants: DataFrame,
                     caller: Caller, now) -> DataFrame:
    """Findings of uploads the caller may see, with their run and upload.

    Both joins are equi-joins on the run and the upload; visibility is settled
    on uploads first, so no finding of another organization is ever read on.
    """
    seen = visible_uploads(caller, uploads, grants, now).select(F.col("id").alias("upload_id"), "filename")
    runs = analyses.select(F.col("id").alias("analysis_id"), "upload_id").join(seen, "upload_id")
    return findings.join(runs, "analysis_id")


def search_visible_text(index: DataFrame, findings: DataFrame, analyses: DataFrame, uploads: DataFrame,
                        grants: DataFrame, caller: Caller, now, query: str, n: int | None = None) -> DataFrame:
    """Word search over what the caller may see; the best of those, not those of the best."""
    return search_findings_text(index, visible_findings(findings, analyses, uploads, grants, caller, now), query, n)


def search_visible_vector(vectors: DataFrame, findings: DataFrame, analyses: DataFrame, uploads: DataFrame,
                          grants: DataFrame, caller: Caller, now, query: list[float], n: int | None = None) -> DataFrame:
    """Vector search over what the caller may see. ``vectors`` has finding_id
    and embedding."""
    seen = visible_findings(findings, analyses, uploads, grants, caller, now).withColumnRenamed("id", "finding_id")
    return search_findings_vector(vectors.join(seen, "finding_id"), query, n)


def _phrase_hits(index: DataFrame, phrase: tuple) -> DataFrame:
    """Findings holding the words at the phrase's relative positions."""
    tokens = F.col("token")
    starts = None
    for offset, token in phrase:
        value = F.when(tokens == token, F.array(F.lit(offset)))
        starts = value if starts is None else F.concat(F.coalesce(starts, F.array().cast("array<int>")),
                                                      F.coalesce(value, F.array().cast("array<int>")))
    at = index.where((F.col("form") == STEMMED) & tokens.isin([t for _, t in phrase])).select(
        "finding_id", "field", "pos", F.explode(starts).alias("offset"))
    return (
        at.groupBy("finding_id", "field", (F.col("pos") - F.col("offset")).alias("start"))
        .agg(F.count_distinct("offset").alias("k")).where(F.col("k") == len(phrase))
        .select("finding_id").distinct()
    )


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to a literal query vector, evaluated in the JVM."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a * b), F.lit(0.0), add)
    own = F.sqrt(F.aggregate(F.transform(vector, lambda a: a.cast("double") * a), F.lit(0.0), add))
    return F.try_divide(dot, own * F.lit(norm))


def search_findings_vector(vectors: DataFrame, query: list[float], n: int | None = None,
                           id_col: str = "finding_id") -> DataFrame:
    """Nearest findings by cosine similarity, among those given (exact)."""
    return (
        vectors.withColumn("rank", cosine(F.col("embedding"), query)).drop("embedding")
        .orderBy(F.desc("rank"), id_col).limit(clamp(n, fixed.SEARCH_LIMIT))
    )


def search_many(vectors: DataFrame, queries: dict[str, list[float]], n: int | None = None,
                id_col: str = "finding_id") -> DataFrame:
    """Several query vectors in one pass over the vectors.

    Each task keeps its best few per query before anything is shuffled.
    """
    ranks = F.explode(F.array(*[
        F.struct(F.lit(name).alias("query"), cosine(F.col("embedding"), q).alias("rank"))
        for name, q in queries.items()])).alias("s")
    order = Window.partitionBy("query").orderBy(F.desc("rank"), id_col)
    return (
        vectors.select(id_col, ranks).select(id_col, "s.query", "s.rank")
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= clamp(n, fixed.SEARCH_LIMIT))
    )


def has_embeddings(vectors: DataFrame, org_id: str) -> DataFrame:
    """One row: does the organization have any stored vector."""
    one = vectors.where(F.col("org_id") == F.lit(org_id)).limit(1)
    return one.agg((F.count(F.lit(1)) > 0).alias("has_embeddings"))


def embed_findings(texts: DataFrame, embedder=None, dims: int = fixed.EMBED_DIMS) -> DataFrame:
    """Vectors from a user-supplied Pandas UDF (text column -> array<float>).

    Without one the result is empty. Inputs are cut to the provider's limit;
    vectors of the wrong size are left out, see ``rejected_vectors``.
    """
    return _embedded(texts, embedder).where(F.size("embedding") == dims)


def rejected_vectors(texts: DataFrame, embedder=None, dims: int = fixed.EMBED_DIMS) -> DataFrame:
    """The other side of ``embed_findings``: texts whose vector is missing or
    of the wrong size, with that size (NULL where there is none)."""
    return _embedded(texts, embedder).where(
        F.col("embedding").isNull() | (F.size("embedding") != dims)
    ).withColumn("size", F.when(F.col("embedding").isNotNull(), F.size("embedding"))).drop("embedding")


def _embedded(texts: DataFrame, embedder) -> DataFrame:
    cut = texts.withColumn("content", F.left("content", F.lit(fixed.EMBED_CHARS)))
    if embedder is None:
        return cut.withColumn("embedding", F.lit(None).cast("array<float>")).where(F.lit(False))
    return cut.withColumn("embedding", embedder(F.col("content")).cast("array<float>"))
