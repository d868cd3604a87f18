"""Which rules a change calls for: keyword evidence and TF-IDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..shared import cut

#: A rule without a keyword hit is cited from this cosine on.
MIN_SCORE = 0.15
TOP_K = 3
#: Rule vectors of up to so many terms are broadcast (some 50 bytes each).
BROADCAST_TERMS = 500_000
#: Tokens, and cells of queries and rules, that a worker holds at once.
SLICE_TOKENS, SLICE_CELLS = 200_000, 2_000_000


def terms(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf): occurrences of each token."""
    return docs.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(counted: DataFrame, key: str) -> DataFrame:
    """(term, df, idf), smoothed: ln((1 + N) / (1 + df)) + 1."""
    n = counted.select(key).distinct().agg(F.count("*"))
    by_term = counted.groupBy("term").agg(F.count("*").alias("df")).withColumn("n", n.scalar())
    return by_term.select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(counted: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) of unit length; terms without a weight count as rare (1.0)."""
    weighed = counted.join(_small(weights.select("term", "idf")), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key"))).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def scores(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, rule_id, score): cosines of unit vectors that share a term. queries: (query_id, term, weight);
    rules: (rule_id, term, weight)."""
    r = _small(rules.withColumnRenamed("weight", "rule_weight"))
    return queries.join(r, "term").groupBy("query_id", "rule_id").agg(F.round(F.sum(F.col("weight") * F.col("rule_weight")), 6).alias("score"))


def keyword_hits(query_terms: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, rule_id, hits): keywords of a rule that share a token with the query. query_terms: (query_id, term);
    keywords: (rule_id, keyword, term)."""
    found = query_terms.select("query_id", "term").join(_small(keywords), "term").select("query_id", "rule_id", "keyword").distinct()
    return found.groupBy("query_id", "rule_id").agg(F.count("*").alias("hits"))


def matches(queries: DataFrame, text: str, rules: DataFrame, weights: DataFrame, keywords: DataFrame, by: str = "query_id", floor: float = MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """(by, rule_id, score) and (by, rule_id, hits), what scores() and keyword_hits() give and top_rules() needs of it: of queries
    alone, scores of floor and more or of rules with a hit; of sets of queries (by), each rule's best score and all its hits.

    queries: query_id, by, text; rules: (rule_id, term, weight); weights: (term, idf); keywords: (rule_id, keyword, term).
    Texts aren't shuffled: up to BROADCAST_TERMS the rules go to the tasks, which score a slice of queries against all of them.
    Above, and for ids that several rows share (their texts are one query), terms are joined.
    """
    one = by == "query_id"
    ids = queries.groupBy("query_id").count().where("count > 1 or query_id is null").select("query_id")
    shared, sizes = cut(ids, "shared-ids"), [d.count() for d in (rules, weights, keywords)]
    if sum(sizes) <= BROADCAST_TERMS:
        alone = queries.where("query_id is not null").join(shared, "query_id", "left_anti") if shared.count() else queries
        rest = queries.join(shared.withColumnRenamed("query_id", "__id"), F.col("query_id").eqNullSafe(F.col("__id")), "left_semi") if shared.count() else None
        kind = dict(queries.dtypes)[by]
        named = rules.select("rule_id").union(keywords.select("rule_id")).distinct().orderBy("rule_id").toArrow()["rule_id"].combine_chunks()
        score = _scorer(named, *[d.toArrow() for d in (rules, weights, keywords)], one, floor)
        made = alone.select(F.col(by).alias("by"), tokens(F.col(text)).alias("tokens")).mapInArrow(score, f"by {kind}, rule int, score double, hits long")
        names = F.broadcast(queries.sparkSession.createDataFrame(pa.table({"rule": pa.array(range(len(named)), pa.int32()), "rule_id": named})))
        if not one:
            made = made.groupBy("by", "rule").agg(F.max("score").alias("score"), F.sum("hits").alias("hits"))
        told = cut(made.join(names, "rule").select(F.col("by").alias(by), "rule_id", F.round("score", 6).alias("score"), "hits"), "matches")
        scored, hits = told.where("score > 0").select(by, "rule_id", "score"), told.where("hits > 0").select(by, "rule_id", "hits")
    else:
        rest, scored, hits = queries, None, None
    if rest is not None:
        found = cut(terms(rest, "query_id", F.col(text)), "query-terms")
        more, met = scores(vectors(found, weights, "query_id"), rules), keyword_hits(found, keywords)
        if not one:
            sets = rest.select("query_id", by)
            more, met = more.join(sets, "query_id").select(by, "rule_id", "score"), met.join(sets, "query_id").select(by, "rule_id", "hits")
        scored, hits = (more, met) if scored is None else (scored.unionByName(more), hits.unionByName(met))
        if not one:
            scored, hits = scored.groupBy(by, "rule_id").agg(F.max("score").alias("score")), hits.groupBy(by, "rule_id").agg(F.sum("hits").alias("hits"))
    return scored, hits


def _postings(terms: pa.Array, known: pa.Array, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where each known term's rows begin, and the columns in that order."""
    place = pc.index_in(terms, known).to_numpy(zero_copy_only=False)
    order = np.argsort(place, kind="stable")
    return np.searchsorted(place[order], np.arange(len(known) + 1)), *[c[order] for c in columns]


def _spread(begins: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries with a term: the entry and the posting, of every posting of its term."""
    n = begins[term + 1] - begins[term]
    entry = np.repeat(np.arange(len(term)), n)
    return entry, np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + begins[term][entry]


def _scorer(named: pa.Array, rules: pa.Table, weights: pa.Table, keywords: pa.Table, one: bool, floor: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Maps batches of (by, tokens) to (by, rule, score, hits); rule is the place in named."""
    flat = {name: t[name].combine_chunks() for t in (rules,) for name in ("rule_id", "term", "weight")}
    known = pc.unique(pa.chunked_array([weights["term"].combine_chunks(), flat["term"], keywords["term"].combine_chunks()]))
    idf = np.ones(len(known) + 1)  # the last is for terms of no rule
    idf[pc.index_in(weights["term"].combine_chunks(), known).to_numpy(zero_copy_only=False)] = weights["idf"].to_numpy()
    place = lambda ids: pc.index_in(ids.combine_chunks(), named).to_numpy(zero_copy_only=False).astype(np.int64)
    begins, rule, weight = _postings(flat["term"], known, place(rules["rule_id"]), flat["weight"].to_numpy(zero_copy_only=False))
    word_begins, word_rule, word = _postings(keywords["term"].combine_chunks(), known, place(keywords["rule_id"]), keywords["keyword"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64))
    width, n_words = max(1, len(named)), int(word.max(initial=0)) + 1

    def scored(by: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        n, coded = len(lists), lists.flatten().dictionary_encode()
        size = max(1, len(coded.dictionary))
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        cell, tf = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        term = pc.fill_null(pc.index_in(coded.dictionary, known), len(known)).to_numpy(zero_copy_only=False).astype(np.int64)
        query, term = cell // size, term[cell % size] if len(cell) else cell
        x = tf * idf[term]
        norm = np.sqrt(np.bincount(query, x * x, n))
        held = term < len(known)
        query, term, x = query[held], term[held], x[held] / norm[query[held]]
        entry, at = _spread(begins, term)
        score = np.bincount(query[entry] * width + rule[at], x[entry] * weight[at], n * width)
        entry, at = _spread(word_begins, term)
        met = np.unique((query[entry] * width + word_rule[at]) * n_words + word[at]) // n_words
        hits = np.bincount(met, minlength=n * width)
        if one:
            kept = np.flatnonzero((hits > 0) | (score >= floor - 1e-6))
            return _rows(by.take(pa.array(kept // width)), kept % width, score[kept], hits[kept])
        groups = by.dictionary_encode(null_encoding="encode")
        of = groups.indices.to_numpy(zero_copy_only=False)
        best, total = np.zeros((len(groups.dictionary), width)), np.zeros((len(groups.dictionary), width), np.int64)
        np.maximum.at(best, of, score.reshape(n, width))
        np.add.at(total, of, hits.reshape(n, width))
        kept = np.flatnonzero((best.ravel() > 0) | (total.ravel() > 0))
        return _rows(groups.dictionary.take(pa.array(kept // width)), kept % width, best.ravel()[kept], total.ravel()[kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by, lists = batch.column(0), batch.column(1)
            ends, start = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), 0
            while start < len(lists):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, min(int(np.searchsorted(ends, done + SLICE_TOKENS, "right")), start + max(1, SLICE_CELLS // width)))
                yield scored(by.slice(start, stop - start), lists.slice(start, stop - start))
                start = stop

    return run


def _rows(by: pa.Array, rule: np.ndarray, score: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([by, pa.array(rule, pa.int32()), pa.array(score, pa.float64()), pa.array(hits, pa.int64())], names=["by", "rule", "score", "hits"])


def top_rules(scored: DataFrame, hits: DataFrame, by: str = "query_id", k: int = TOP_K, floor: float = MIN_SCORE) -> DataFrame:
    """(by, rule_id, rank, score, has_keyword): the k best, keyword hits before cosines, ties by rule_id; rules without
    a hit need a score of floor."""
    both = scored.join(hits, [by, "rule_id"], "full").select(by, "rule_id", F.coalesce("score", F.lit(0.0)).alias("score"), (F.coalesce("hits", F.lit(0)) > 0).alias("has_keyword"))
    order = Window.partitionBy(by).orderBy(F.desc("has_keyword"), F.desc("score"), "rule_id")
    return both.where(F.col("has_keyword") | (F.col("score") >= floor)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def signature(rules: DataFrame, key: str, text: str) -> DataFrame:
    """One row: 16 hex digits that change with any rule's id or text, whatever the rules' order. Rules are hashed one by
    one, the digests' eight words of 32 bits are summed (so no task holds all of them), and the sums hashed again."""
    each = rules.select(F.sha2(F.concat_ws("\n", F.col(key).cast("string"), F.col(text)), 256).alias("d"))
    words = [F.sum(F.conv(F.substring("d", i, 8), 16, 10).cast("long")) for i in range(1, 65, 8)]
    return each.agg(F.substring(F.sha2(F.concat_ws(",", *[w.cast("string") for w in words]), 256), 1, 16).alias("signature"))
