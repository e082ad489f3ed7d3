"""Ranked lexical search by accumulator-limited term-at-a-time evaluation (operator 12).

The queries are a stated set; the documents are searched where they lie.

1. Every document is cut into terms once and becomes a row of postings: its
   length and, for the terms that occur in some query, how often they occur.
2. Aggregates over the rows give N, L, each term's document frequency (hence its
   weight) and the largest impact that it has on any document.
3. Each task inverts its rows, ``block_docs`` at a time, and takes every query's
   terms rarest first.  While a document that has none of the terms so far could
   still reach the k-th best score (the bounds of the remaining terms together
   are not below the k-th best partial score), a term gives accumulators to all
   its documents; after that it only updates the documents that have one, and
   those are updated to the end, so that their scores are exact.  The k-th best
   score of earlier blocks counts as well.
4. The tasks' best documents of each query are ranked together.

A small part of the documents (``SEED_PART``) is searched first; its k-th best
scores are the bounds that the rest starts from, so that a task over the rest
returns few rows, however many tasks there are.

Queries are taken in blocks of at most ``max_terms`` different terms; a block's
terms and thresholds are what is sent to the tasks, so their size is bounded
whatever the number of queries.

Defined results: a document or query without terms (null, empty) takes no part;
repeated rows are documents of their own, and repeated queries are answered
each; equal scores go by ascending doc_id, a null doc_id last; equal scores of
equal doc_ids in any order; an empty table gives an empty result; of the tables
only doc_id and text, item_id and text are read, so other names can't clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopfloor.session import shared_dir

from .common import LOWER, UPPER, own_columns, table

_LOWER = str.maketrans(UPPER, LOWER)
_TERMS = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")

#: One document in so many is searched first.
SEED_PART = 64
#: Stands for a null doc_id where scores tie.
LAST_ID = np.iinfo(np.int64).max

POSTINGS = "doc_id long, n long, terms array<int>, freqs array<int>, seed int"
BEST = "query int, doc_id long, score long"


def terms_of(text: str | None) -> list[str]:
    return _TERMS.findall((text or "").translate(_LOWER))


def query_blocks(items: DataFrame, max_terms: int) -> Iterator[list[tuple]]:
    """(item_id, set of terms) of the queries, in blocks of at most ``max_terms``
    different terms (or one query)."""
    block, seen = [], set()
    for row in items.select("item_id", "text").toLocalIterator():
        terms = set(terms_of(row.text))
        if block and len(seen | terms) > max_terms:
            yield block
            block, seen = [], set()
        if terms:
            block.append((row.item_id, terms))
            seen |= terms
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """A row for each document with terms: doc_id, n (its terms), and number and
    frequency of those of ``vocabulary``; ``seed`` is 1 for the part searched first."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = known.value
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                terms = terms_of(text)
                if terms:
                    held = Counter(i for i in map(ids.get, terms) if i is not None)
                    rows.append((doc_id, len(terms), np.fromiter(held.keys(), np.int32, len(held)),
                                 np.fromiter(held.values(), np.int32, len(held)), 0))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "terms", "freqs", "seed"])
            out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
            yield out

    seed = F.when(F.pmod(F.monotonically_increasing_id(), F.lit(SEED_PART)) == 0, 1).otherwise(0)
    return docs.select("doc_id", "text").mapInPandas(cut, POSTINGS).withColumn("seed", seed)


def impacts(freqs: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence of a term in a document of ``n`` terms scores, before the weight."""
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return (1_000_000_000 * freqs) // (1000 * freqs + 20 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _flat(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, term and frequency of each posting of a batch of rows."""
    sizes = b["terms"].map(len).to_numpy(np.int64)
    join = lambda c: np.concatenate(b[c].to_list()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(b)), sizes), join("terms"), join("freqs")


def term_statistics(rows: DataFrame, n_docs: int, n_terms: int, vocabulary: int) -> DataFrame:
    """term, df and top (largest impact) of each term, summed up in each task first."""
    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, top = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
        for b in batches:
            row, term, freq = _flat(b)
            df += np.bincount(term, minlength=vocabulary)
            np.maximum.at(top, term, impacts(freq, b["n"].to_numpy(np.int64)[row], n_docs, n_terms))
        held = np.flatnonzero(df)
        yield pd.DataFrame({"term": held, "df": df[held], "top": top[held]})

    return (rows.select("n", "terms", "freqs").mapInPandas(stats, "term int, df long, top long")
            .groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top")))


class Block:
    """Some documents, inverted: the documents and impacts of each term."""

    def __init__(self, doc_ids, n, row, term, freq, n_docs, n_terms):
        self.doc_ids = doc_ids
        order = np.argsort(term, kind="stable")
        self.docs = row[order]
        self.impact = impacts(freq[order], n[self.docs], n_docs, n_terms)
        held, starts = np.unique(term[order], return_index=True)
        bounds = np.append(starts, len(order)).tolist()
        self.ends = {t: (bounds[i], bounds[i + 1]) for i, t in enumerate(held.tolist())}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        at = self.ends.get(term)
        return None if at is None else (self.docs[at[0]:at[1]], self.impact[at[0]:at[1]])


def evaluate(block: Block, query: list[tuple[int, int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and exact scores of the block's documents that can be among the ``k`` best.

    ``query``: term, weight and bound (weight times largest impact) of its terms,
    rarest first; ``least``: a score that k documents are known to reach."""
    scores = np.zeros(len(block.doc_ids), np.int64)
    remaining = sum(bound for _, _, bound in query)
    creating, created = True, 0
    for term, w, bound in query:
        if creating:
            kth = least
            if created >= k:
                kth = max(kth, int(np.partition(scores, -k)[-k]))
            creating = remaining >= kth  # a tie may still win by its doc_id
        found = block.of(term)
        if found is not None:
            docs, impact = found
            if creating:
                scores[docs] += w * impact
                created = int(np.count_nonzero(scores))
            else:
                with_one = scores[docs] > 0
                scores[docs[with_one]] += w * impact[with_one]
        remaining -= bound
    rows = np.flatnonzero(scores >= max(least, 1))
    return rows, scores[rows]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(rows: DataFrame, queries: list[list[tuple]], least: list[int], n_docs: int, n_terms: int, k: int,
            block_docs: int) -> DataFrame:
    """Each task's best documents of every query."""
    sent = rows.sparkSession.sparkContext.broadcast((queries, least))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, known = sent.value
        least_now = list(known)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]

        def run(parts):
            b = pd.concat(parts, ignore_index=True)
            ids = b["doc_id"].astype("Int64").fillna(LAST_ID).to_numpy(np.int64)
            block = Block(ids, b["n"].to_numpy(np.int64), *_flat(b), n_docs, n_terms)
            for q, query in enumerate(asked):
                at, scores = evaluate(block, query, k, least_now[q])
                if len(at):
                    best[q] = _best(np.append(best[q][0], ids[at]), np.append(best[q][1], scores), k)
                    if len(best[q][1]) == k:
                        least_now[q] = max(least_now[q], int(best[q][1][-1]))

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= block_docs:
                run(held)
                held, n = [], 0
        if held:
            run(held)
        for q, (ids, scores) in enumerate(best):
            if len(ids):
                yield pd.DataFrame({"query": q, "doc_id": pd.array(ids, "Int64").astype(object), "score": scores}).replace(
                    {"doc_id": {LAST_ID: None}})

    return rows.select("doc_id", "n", "terms", "freqs").mapInPandas(search, BEST)


def _ranked(best: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(spark: SparkSession, docs: DataFrame, block: list[tuple], id_type: str, k: int, block_docs: int) -> DataFrame | None:
    vocabulary = sorted(set().union(*(terms for _, terms in block)))
    number = {t: i for i, t in enumerate(vocabulary)}
    path = shared_dir(spark, "postings") + "/data"
    postings(docs, vocabulary).write.partitionBy("seed").parquet(path)
    rows = spark.read.schema(POSTINGS).parquet(path)
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    stats = {r.term: (r.df, r.top) for r in term_statistics(rows, n_docs, n_terms, len(vocabulary)).collect()}
    queries = []
    for _, terms in block:
        held = sorted((t for t in map(number.get, terms) if t in stats), key=lambda t: (stats[t][0], t))
        weights = [(t, weight(n_docs, stats[t][0])) for t in held]
        queries.append([(t, w, w * stats[t][1]) for t, w in weights])

    first = _search(rows.filter("seed = 1"), queries, [1] * len(queries), n_docs, n_terms, k, block_docs)
    first_best = _ranked(first, k).select("query", "doc_id", "score").collect()  # at most k rows a query of the block
    count = Counter(r.query for r in first_best)
    least = [1] * len(queries)
    for r in first_best:
        if count[r.query] == k:
            least[r.query] = min(r.score, least[r.query]) if least[r.query] > 1 else r.score
    rest = _search(rows.filter("seed = 0"), queries, least, n_docs, n_terms, k, block_docs)
    ranked = _ranked(rest.unionByName(spark.createDataFrame([tuple(r) for r in first_best], BEST)), k)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"query int, item_id {id_type}")
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")


@own_columns("doc_id", "text")
def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, max_terms: int = 200_000, block_docs: int = 4096) -> DataFrame:
    """The ``k`` documents of highest score above 0 of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    found = [_search_block(spark, docs, b, kind, k, block_docs) for b in query_blocks(items, max_terms)]
    none = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, [df for df in found if df is not None], none)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of ``documents`` for each item of ``benchmark``."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS u, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT u, doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM docs),
q AS (
  SELECT DISTINCT i, item_id, term FROM (
    SELECT row_number() OVER () AS i, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL)),
post AS (
  SELECT term, u, doc_id, n, count(*) AS tf FROM (SELECT u, doc_id, n, unnest(t) AS term FROM docs)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM post, total GROUP BY term),
scored AS (
  SELECT q.i, q.item_id, post.u, post.doc_id,
         sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN post ON post.term = q.term JOIN w ON w.term = q.term, total GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0)
WHERE rank <= 50
"""
