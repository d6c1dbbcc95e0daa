"""Keyword search: postings, BM25, name tiers, substring search. Every query of a batch is answered by one plan."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import split_identifier
from siftwell.runtime import balanced, materialize

K1, B = 1.2, 0.75
#: Patterns that one scan matches as substrings (they become literals of its plan); more patterns take more scans.
SUBSTRINGS = 500
#: Words of a batch up to which they are broadcast; more are joined by shuffles.
WORDS = 100_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _terms(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """doc, len, term: one row for each token."""
    x = df.select(F.col(key).alias("doc"), tokens(F.concat_ws(" ", *fields)).alias("_t"))
    # the length is taken before the rows are exploded, or it would be computed for each of them anew
    return x.select("doc", F.size("_t").alias("len"), "_t").select("doc", "len", F.explode("_t").alias("term"))


def postings(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """doc, term, tf, len: the inverted index of the given text columns. Documents without a token have no rows.

    To be written once (see ``index``) and read by every batch of queries.
    """
    return _terms(df, key, *fields).groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def stats(df: DataFrame, *fields: str) -> DataFrame:
    """One row: n documents and their average length in tokens."""
    n = F.regexp_count(F.lower(F.concat_ws(" ", *fields)), F.lit(r"[\p{L}\p{N}]+"))
    return df.agg(F.count("*").alias("n_docs"), F.avg(n).alias("avg_len"))


def _words(terms: DataFrame) -> DataFrame:
    """Distinct words of a batch (a stored table) and their first two characters; broadcast if they are few enough."""
    words = terms.select("qterm").distinct().withColumn("_p", F.substring("qterm", 1, 2))
    return F.broadcast(words) if terms.count() <= WORDS else words


def scan(df: DataFrame, key: str, fields: list[str], terms: DataFrame, prefix: bool = True) -> DataFrame:
    """query_id, qterm, doc, tf, len: as ``matches`` on the postings of ``df``, without an index.

    Tokens that no query asks for are left out where they are read, so that only hits are grouped.
    """
    words = _words(terms)
    each = _terms(df, key, *fields)
    if prefix:
        each = each.withColumn("_p", F.substring("term", 1, 2)).join(words, "_p").where(F.expr("startswith(term, qterm)"))
    else:
        each = each.withColumnRenamed("term", "qterm").join(words.select("qterm"), "qterm")
    return each.groupBy("qterm", "doc").agg(F.count("*").alias("tf"), F.first("len").alias("len")).join(terms, "qterm")


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """query_id, qterm: distinct parts of a query, identifiers split, of more than one character."""
    words = F.filter(F.split(F.regexp_replace(text, "[\"']", ""), r"\s+"), lambda w: w != "")
    parts = F.flatten(F.transform(words, split_identifier))
    low = F.flatten(F.transform(parts, tokens))
    return queries.select("query_id", F.explode(F.array_distinct(F.filter(low, lambda t: F.length(t) > 1))).alias("qterm"))


def matches(index: DataFrame, terms: DataFrame, prefix: bool = True) -> DataFrame:
    """query_id, qterm, doc, tf, len: postings whose term is, or begins with, a query's term. The join is on the first two characters."""
    if not prefix:
        return index.join(terms.withColumnRenamed("qterm", "term"), "term").withColumnRenamed("term", "qterm")
    hits = index.withColumn("_p", F.substring("term", 1, 2)).join(_words(terms), "_p").where(F.expr("startswith(term, qterm)"))
    hits = hits.groupBy("qterm", "doc").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))
    return hits.join(terms, "qterm")


def ranked(hits: DataFrame, corpus: DataFrame, terms: DataFrame, all_terms: bool = False) -> DataFrame:
    """query_id, doc, score (BM25) of the hits of ``scan`` or ``matches``. ``all_terms``: every term has to match."""
    hits = materialize(hits)
    df = hits.select("qterm", "doc").distinct().groupBy("qterm").agg(F.count("*").alias("df"))
    n_docs, avg_len = corpus.first()
    scored = hits.join(df, "qterm")
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avg_len)))
    out = scored.groupBy("query_id", "doc").agg(F.sum(idf * tf).alias("score"), F.count("*").alias("_hits"))
    if all_terms:
        out = out.join(terms.groupBy("query_id").agg(F.count("*").alias("_all")), "query_id").where("_hits = _all")
    return out.select("query_id", "doc", "score")


def bm25(index: DataFrame, corpus: DataFrame, queries: DataFrame, text: str = "text", prefix: bool = True, all_terms: bool = False) -> DataFrame:
    """query_id, doc, score from stored postings. ``prefix``: a term also matches what begins with it."""
    terms = materialize(query_terms(queries, text))
    return ranked(matches(index, terms, prefix), corpus, terms, all_terms)


def bm25_scan(df: DataFrame, key: str, fields: list[str], queries: DataFrame, text: str = "text", prefix: bool = True, all_terms: bool = False) -> DataFrame:
    """query_id, doc, score straight from the texts: two scans, and a shuffle of the hits alone."""
    terms, df = materialize(query_terms(queries, text)), balanced(df.select(key, *dict.fromkeys(fields)))
    return ranked(scan(df, key, fields, terms, prefix), stats(df, *fields), terms, all_terms)


def top(df: DataFrame, n: int, by: str = "query_id", score: str = "score", tie: str = "doc") -> DataFrame:
    """The ``n`` best rows of each query, with their rank from 1; ties go to the lesser key."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def exact_name(entities: DataFrame, queries: DataFrame, text: str = "text") -> DataFrame:
    """query_id, doc: entities whose name is the query, case aside."""
    q = queries.select("query_id", F.lower(F.trim(text)).alias("_k"))
    return entities.select(F.col("id").alias("doc"), F.lower("name").alias("_k")).join(q, "_k").select("query_id", "doc").distinct()


def qualified_suffix(entities: DataFrame, queries: DataFrame, text: str = "text") -> DataFrame:
    """query_id, doc: entities whose qualified name ends with ``::`` and the query, case aside."""
    q = queries.select("query_id", F.lower(F.trim(text)).alias("_k"))
    parts = F.split(F.lower("qualified_name"), "::")
    tails = F.transform(F.sequence(F.lit(2), F.size("_p")), lambda i: F.array_join(F.slice("_p", i, F.size("_p")), "::"))
    e = entities.select(F.col("id").alias("doc"), parts.alias("_p")).where(F.size("_p") > 1).select("doc", F.explode(tails).alias("_k"))
    return e.join(q, "_k").select("query_id", "doc").distinct()


def substrings(df: DataFrame, key: str, fields: list[str], patterns: dict[object, str]) -> DataFrame:
    """query_id, doc: rows in which a pattern occurs in one of the fields, case aside. No join: the patterns are literals, SUBSTRINGS to a scan."""
    given = list(patterns.items())
    parts = []
    for i in range(0, max(1, len(given)), SUBSTRINGS):
        hits = [
            F.when(F.greatest(*[F.coalesce(F.instr(F.lower(f), p.lower()), F.lit(0)) for f in fields] + [F.lit(0)]) > 0, F.lit(q))
            for q, p in given[i : i + SUBSTRINGS]
        ]
        found = F.array_compact(F.array(*hits)) if hits else F.array()
        parts.append(df.select(F.explode(found).alias("query_id"), F.col(key).alias("doc")))
    return reduce(DataFrame.unionByName, parts)


def all_terms(df: DataFrame, key: str, field: str, query: str) -> DataFrame:
    """Rows that hold every term of the query (split at white space, ``_`` and ``-``), case aside."""
    terms = F.filter(F.split(F.lit(query.lower()), r"[\s_-]+"), lambda t: t != "")
    return df.where((F.size(terms) > 0) & F.forall(terms, lambda t: F.instr(F.lower(field), t) > 0)).select(F.col(key).alias("doc"))


def tiered(entities: DataFrame, queries: DataFrame, limit: int, compat: bool = False) -> DataFrame:
    """query_id, doc, tier, score, rank: exact name (1.0), qualified suffix (0.95), full text, and substring (0.3) where
    none of these finds anything; each entity by its first tier.

    Full text scores r / (1 + r) of its BM25 score r, or 1 / (1 + r) with ``compat``, which falls with relevance.
    Blank queries find nothing here. The queries of a batch without hits are read by the driver, as their texts become literals.
    """
    q = materialize(queries.where(F.trim("text") != "").select("query_id", "text"))
    fields = ["name", "content", "summary"]
    # rounded, so that scores that differ by rounding alone are ties
    r = bm25_scan(entities, "id", fields, q).withColumn("score", F.round("score", 9))
    fts = F.lit(1.0) / (1 + F.col("score")) if compat else F.col("score") / (1 + F.col("score"))
    none = F.lit(0.0)
    hits = (
        exact_name(entities, q).select("query_id", "doc", F.lit(1).alias("tier"), F.lit(1.0).alias("score"), none.alias("bm25"))
        .unionByName(qualified_suffix(entities, q).select("query_id", "doc", F.lit(2).alias("tier"), F.lit(0.95).alias("score"), none.alias("bm25")))
        .unionByName(r.select("query_id", "doc", F.lit(3).alias("tier"), fts.alias("score"), F.col("score").alias("bm25")))
    )
    hits = materialize(hits)
    bare = q.join(hits.select("query_id").distinct(), "query_id", "left_anti").collect()
    if bare:
        like = substrings(entities, "id", fields, {x["query_id"]: x["text"].strip() for x in bare})
        hits = hits.unionByName(like.select("query_id", "doc", F.lit(4).alias("tier"), F.lit(0.3).alias("score"), none.alias("bm25")))
    first = hits.groupBy("query_id", "doc").agg(F.min(F.struct("tier", (-F.col("bm25")).alias("b"), "score")).alias("x"))
    order = Window.partitionBy("query_id").orderBy("x.tier", "x.b", "doc")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "doc", "x.tier", "x.score", "rank")


#: Steps of the stemmer below: (pattern of the ending, what replaces it, least measure of what is before), fixed values of Porter (1980).
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def porter(word: str) -> str:
    """Stem of a lower-cased English word (Porter, 1980)."""
    if len(word) < 3:
        return word

    def consonant(w: str, i: int) -> bool:
        return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not consonant(w, i - 1))

    def shape(w: str) -> str:
        return "".join("c" if consonant(w, i) else "v" for i in range(len(w)))

    def measure(w: str) -> int:
        return sum(a + b == "vc" for a, b in zip(shape(w), shape(w)[1:]))

    def cvc(w: str) -> bool:
        return len(w) > 2 and shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted((x.split(":") for x in table.split()), key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[: -len(end)] + new if measure(w[: -len(end)]) else w
                break
    for end in sorted(_STEP4.split(), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


def stemmed(df: DataFrame, column: str) -> DataFrame:
    """Replaces the terms of a postings or query-term table by their stems and adds up tf where there is one."""
    @F.pandas_udf("string")
    def stem(s: pd.Series) -> pd.Series:
        known = {w: porter(w) for w in s.dropna().unique()}
        return s.map(known)

    words = df.select(column).distinct().withColumn("_s", stem(column))
    out = df.join(words, column).drop(column).withColumnRenamed("_s", column)
    if "tf" in df.columns:
        return out.groupBy("doc", column).agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))
    return out.distinct()
