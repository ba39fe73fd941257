"""Batched hybrid retrieval: dense and lexical legs fused by reciprocal rank.

Every operator takes a whole query set.  Per-query top-k is ``row_number() <= k``,
which Spark prunes inside each task before the shuffle, so one query matching
most of the corpus never lands in one task unpruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import BROADCAST_ROWS, checked_broadcast, durable
from .stats import chunk_count, smoothed_idf

# Fixed values.
RRF_K = 60
SEED_DELTA = 0.25
CONFIDENCE_FLOOR = 0.010

QUERY_BLOCK = 1024          # query vectors one task multiplies at a time
WIDE_BLOCK = 16_384         # query vectors one cogrouped task holds where there are many
SLICE_ROWS = 50_000         # corpus vectors one cogrouped task holds
SIMILARITIES = 8_000_000    # of them, at a time
MATCHED = 2_000_000         # cells of chunks and queries a task scores at a time


def chunk_filter(chunks: DataFrame, eval_layer: str | None = None, eval_tag: str | None = None) -> DataFrame:
    """Optional equality filters; they precede ranking, so they change ranks."""
    if eval_layer is not None:
        chunks = chunks.where(F.col("eval_layer") == eval_layer)
    if eval_tag is not None:
        chunks = chunks.where(F.col("eval_tag") == eval_tag)
    return chunks


def top_per_query(rows: DataFrame, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    window = W.partitionBy("query_id").orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


# --- dense leg ---------------------------------------------------------------


def _unit_rows(vectors) -> np.ndarray:
    matrix = np.asarray(list(vectors), dtype=np.float64)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    length[length == 0] = 1.0
    return matrix / length


def _best_of_block(ids, corpus: np.ndarray, query_ids, queries: np.ndarray, k: int) -> pd.DataFrame:
    ids = np.asarray(ids, dtype=object)
    asked, rows, scores = [], [], []
    step = max(1, SIMILARITIES // max(1, len(ids)))
    for j, query_id in enumerate(query_ids):
        if j % step == 0:
            sims = np.round(corpus @ queries[j : j + step].T, 6) + 0.0
        column = sims[:, j % step]
        near = np.arange(len(ids))
        if len(ids) > k:
            near = np.flatnonzero(column >= -np.partition(-column, k - 1)[k - 1])
        order = sorted(near, key=lambda i: (-column[i], ids[i]))[:k]
        asked += [query_id] * len(order)
        rows += [ids[i] for i in order]
        scores += column[order].tolist()
    return _dense_frame(asked, rows, scores)


def _dense_frame(asked: list, rows: list, scores: list) -> pd.DataFrame:
    return pd.DataFrame({
        "query_id": pd.Series(asked, dtype="int64"), "chunk_id": pd.Series(rows, dtype=object),
        "similarity": pd.Series(scores, dtype="float64"),
    })


_DENSE_SCHEMA = "query_id bigint, chunk_id string, similarity double"


def dense_candidates(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Partial top-k per task of cosine similarity, exact after the final rank.

    A query set within ``QUERY_BLOCK`` rides along with the scan of the corpus;
    a larger one meets the corpus block by block through a cogrouped shuffle.
    """
    wanted = queries.where(F.col("query_vector").isNotNull()).select("query_id", "query_vector")
    head = wanted.limit(QUERY_BLOCK + 1).collect()
    if len(head) <= QUERY_BLOCK:
        if not head:
            return queries.sparkSession.createDataFrame([], _DENSE_SCHEMA)
        block = queries.sparkSession.sparkContext.broadcast(
            ([r.query_id for r in head], _unit_rows(r.query_vector for r in head))
        )

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_ids, matrix = block.value
            for batch in batches:
                if len(batch):
                    yield _best_of_block(batch.chunk_id, _unit_rows(batch.vector), query_ids, matrix, k)

        return vectors.select("chunk_id", "vector").mapInPandas(scan, _DENSE_SCHEMA)
    return dense_candidates_blocked(wanted, vectors, k)


def dense_candidates_blocked(
    queries: DataFrame, vectors: DataFrame, k: int,
    query_block: int = QUERY_BLOCK, slice_rows: int = SLICE_ROWS, wide_block: int = WIDE_BLOCK,
) -> DataFrame:
    """Every block of queries meets every slice of the corpus in one task.

    A vector is sent once for each block or slice of the other side, so blocks are no
    smaller than ``wide_block`` once there are enough of them to keep all cores busy.
    """
    asked = queries.count() * 2
    slices = max(1, -(-vectors.count() * 2 // slice_rows))
    busy = min(-(-asked // query_block), -(-2 * queries.sparkSession.sparkContext.defaultParallelism // slices))
    blocks = max(1, busy, -(-asked // wide_block))
    left = queries.select(
        "query_id", "query_vector",
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
    )
    right = vectors.select(
        "chunk_id", "vector",
        F.pmod(F.xxhash64("chunk_id"), F.lit(slices)).cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )

    def multiply(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return _dense_frame([], [], [])
        return _best_of_block(c.chunk_id, _unit_rows(c.vector), q.query_id, _unit_rows(q.query_vector), k)

    return (
        left.groupBy("slice", "block")
        .cogroup(right.groupBy("slice", "block"))
        .applyInPandas(multiply, _DENSE_SCHEMA)
    )


def dense_leg(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    near = dense_candidates(queries, vectors, k)
    return top_per_query(near, k, F.col("similarity").desc(), F.col("chunk_id"), rank="dense_rank")


# --- matching against all queries ----------------------------------------------


def _held(parts: DataFrame) -> DataFrame:
    """Matched terms (chunk_id, sentence, term, weight) as one row per chunk."""
    return parts.groupBy("chunk_id").agg(F.collect_list(F.struct("sentence", "term", "weight")).alias("cells"))


def _weights(weighted: DataFrame) -> list | None:
    """Rows (query_id, term, idf, mass) of a query set small enough to ride along."""
    head = weighted.select("query_id", "term", "idf", "mass").limit(BROADCAST_ROWS + 1).collect()
    return head if len(head) <= BROADCAST_ROWS else None


class _Matcher:
    """The queries that hold each term, as slices of two arrays."""

    def __init__(self, weighted: list):
        place = {q: i for i, q in enumerate(dict.fromkeys(r.query_id for r in weighted))}
        slot = {t: i for i, t in enumerate(dict.fromkeys(r.term for r in weighted))}
        self.ids, self.terms, self.n = list(place), pa.array(slot, pa.string()), len(place)
        term, query = np.array([slot[r.term] for r in weighted], int), np.array([place[r.query_id] for r in weighted], int)
        order = np.argsort(term, kind="stable")
        self.query, self.idf = query[order], np.array([r.idf for r in weighted])[order]
        self.count = np.bincount(term, minlength=len(slot))
        self.first = np.cumsum(self.count) - self.count
        self.mass = np.ones(self.n)
        self.mass[query] = [r.mass for r in weighted]

    def sums(self, group: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Per group and query the weighted idf of the terms they share."""
        some = self.count[code]
        at = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some - self.first[code], some)
        cell = np.repeat(group, some) * self.n + self.query[at]
        return np.bincount(cell, np.repeat(weight, some) * self.idf[at], n * self.n).reshape(n, self.n)

    def best(self, row: np.ndarray, sentence: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Per row and query the best sum of any of the row's sentences."""
        best = np.zeros((n, self.n))
        order = np.lexsort((sentence, row))
        row, sentence, code, weight = row[order], sentence[order], code[order], weight[order]
        opens = np.append(True, (row[1:] != row[:-1]) | (sentence[1:] != sentence[:-1]))[: len(row)]
        group, starts = np.cumsum(opens) - 1, np.flatnonzero(opens)
        work = np.cumsum(np.add.reduceat(self.count[code], starts) + self.n) if len(starts) else np.zeros(0, int)
        ends = np.append(starts, len(row))
        at = 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + MATCHED, "right")))
            piece = slice(ends[at], ends[stop])
            sums = self.sums(group[piece] - at, code[piece], weight[piece], stop - at)
            of = row[starts[at:stop]]
            rows = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            best[of[rows]] = np.maximum(best[of[rows]], np.maximum.reduceat(sums, rows, axis=0))
            at = stop
        return best


def scored_everywhere(held: DataFrame, weighted: list, id_type: str, share: bool = False, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that shares a term with a query.

    The score is the best sum of idf * weight over the terms any one sentence shares,
    with ``share`` a share of the query's mass.  A task holds MATCHED cells of chunks and
    queries at once.  With ``k`` what can't be among a query's best is left out.
    """
    if not weighted:
        return held.sparkSession.createDataFrame([], f"query_id {id_type}, chunk_id string, score double")
    shared = held.sparkSession.sparkContext.broadcast(_Matcher(weighted))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ids, step = pa.array(m.ids, arrow_id), max(1, MATCHED // m.n)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = batch.slice(start, step)
                cells = rows["cells"]
                row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
                flat = cells.flatten()
                term, sentence, weight = (flat.field(c) for c in ("term", "sentence", "weight"))
                code = pc.index_in(term, m.terms)
                known = code.is_valid().to_numpy(zero_copy_only=False)
                best = m.best(row[known], sentence.to_numpy()[known], code.drop_null().to_numpy(), weight.to_numpy()[known], len(cells))
                found = best > 0
                if k is not None and len(best) > k:      # rounding to six places may lift a score
                    found &= best >= -np.partition(-best, k - 1, axis=0)[k - 1] - 1e-6
                chunk, query = np.nonzero(found)
                score = best[chunk, query] / m.mass[query] if share else best[chunk, query]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(query)), rows["chunk_id"].take(pa.array(chunk)), pa.array(score)], ["query_id", "chunk_id", "score"]
                )

    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    return held.mapInArrow(scan, f"query_id {id_type}, chunk_id string, score double")


# --- lexical leg -------------------------------------------------------------


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(T.folded_keywords(F.col("query"))).alias("term"))


def term_counts(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk_id, term, tf) for wanted terms only; others die before the shuffle.

    Kept in the checkpoint folder: document frequencies, candidates and scores
    all come from these few rows, so the texts are scanned once.
    """
    return durable(
        chunks.select("chunk_id", F.explode(T.folded_words(F.col("text"))).alias("term"))
        .join(checked_broadcast(wanted.select("term").distinct()), "term", "left_semi")
        .groupBy("chunk_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def lexical_leg(
    queries: DataFrame, chunks: DataFrame, k: int, require_all: bool = True, counts: DataFrame | None = None
) -> DataFrame:
    """Ranked lexical hits, score = sum of idf * (1 + ln tf) over query terms.

    With ``require_all`` a chunk must hold every query term: candidates come from
    the postings of each query's rarest term, the other terms are then looked up.
    ``counts`` takes the ``term_counts`` of the query set when already at hand.
    """
    asked = query_terms(queries)
    counts = term_counts(chunks, asked) if counts is None else counts
    weights = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = asked.join(weights, "term").withColumn(
        "idf", smoothed_idf(F.col("df"), chunk_count(chunks))
    )
    score = F.round(F.sum(F.col("idf") * (F.log(F.col("tf")) + 1)), 6).alias("score")
    if require_all:
        needed = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
        rarest = known.groupBy("query_id").agg(
            F.min_by("term", F.struct("df", "term")).alias("term")
        )
        candidates = rarest.join(counts, "term").select("query_id", "chunk_id")
        matched = candidates.join(known, "query_id").join(counts, ["chunk_id", "term"])
        scored = (
            matched.groupBy("query_id", "chunk_id")
            .agg(score, F.count(F.lit(1)).alias("matched"))
            .join(needed, "query_id")
            .where(F.col("matched") == F.col("n_terms"))
        )
    else:
        few = _weights(known.withColumn("mass", F.lit(1.0)))
        if few is None:
            scored = known.join(counts, "term").groupBy("query_id", "chunk_id").agg(score)
        else:
            held = _held(counts.select("chunk_id", F.lit(0).alias("sentence"), "term", (F.log(F.col("tf")) + 1).alias("weight")))
            scored = scored_everywhere(held, few, dict(queries.dtypes)["query_id"], k=k).withColumn("score", F.round("score", 6))
    ranked = top_per_query(scored, k, F.col("score").desc(), F.col("chunk_id"), rank="sparse_rank")
    return ranked.select("query_id", "chunk_id", "score", "sparse_rank")


# --- fusion and floors -------------------------------------------------------


def reciprocal(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + rank), F.lit(0.0))


def fuse(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """Full-outer fusion as one union and one aggregate; top k by (-rrf, id)."""
    none = F.lit(None).cast("int")
    both = dense.select("query_id", "chunk_id", "dense_rank", none.alias("sparse_rank")).unionByName(
        sparse.select("query_id", "chunk_id", none.alias("dense_rank"), "sparse_rank")
    )
    fused = both.groupBy("query_id", "chunk_id").agg(
        F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank")
    )
    scored = fused.withColumn(
        "rrf_score", F.round(reciprocal(F.col("dense_rank")) + reciprocal(F.col("sparse_rank")), 9)
    )
    return top_per_query(scored, k, F.col("rrf_score").desc(), F.col("chunk_id"))


def retrieve(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 15, require_all: bool = True,
    counts: DataFrame | None = None,
) -> DataFrame:
    return fuse(dense_leg(queries, vectors, k), lexical_leg(queries, chunks, k, require_all, counts), k)


def within_delta(hits: DataFrame, delta: float = SEED_DELTA, score: str = "rrf_score") -> DataFrame:
    """Keep hits within ``delta`` of the query's best; no-op when delta <= 0."""
    if delta <= 0:
        return hits
    best = F.max(score).over(W.partitionBy("query_id"))
    return hits.withColumn("_best", best).where(F.col(score) >= F.col("_best") - delta).drop("_best")


def confidence_status(queries: DataFrame, hits: DataFrame, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """One row per query: its top score and why it is refused, if it is."""
    best = hits.groupBy("query_id").agg(F.max("rrf_score").alias("top_score"))
    low = (F.lit(floor) > 0) & (F.col("top_score") < floor)
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id",
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        F.when(F.col("top_score").isNull() | low, F.lit("low_confidence")).alias("refusal_reason"),
    )


def with_text(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fetch the text of a few ranked rows: ids travel to the scan, not text to them."""
    return chunks.select("chunk_id", "text").join(checked_broadcast(rows), "chunk_id")


def rerank(hits: DataFrame) -> DataFrame:
    """Order hits(query, text) by best keyword share of any sentence, then id.

    A query without keywords keeps its fused order.
    """
    keys = F.col("keys")     # a column of its own: a lambda would parse the query per sentence
    scored = hits.withColumn("keys", T.keywords(F.col("query"))).withColumn(
        "sentence_score", F.round(T.best_sentence_score(F.col("text"), keys), 9)
    )
    order = W.partitionBy("query_id").orderBy(
        F.col("sentence_score").desc(),
        F.when(F.size(keys) == 0, F.col("rank")),
        F.col("chunk_id"),
    )
    return scored.withColumn("rank", F.row_number().over(order)).drop("keys")


def drop_irrelevant(hits: DataFrame) -> DataFrame:
    """Drop zero-score hits unless all of a query's hits are zero."""
    best = F.max("sentence_score").over(W.partitionBy("query_id"))
    return (
        hits.withColumn("_best", best)
        .where((F.col("sentence_score") > 0) | (F.col("_best") <= 0))
        .drop("_best")
    )


# --- IDF-weighted relevance --------------------------------------------------


def weighted_query_terms(queries: DataFrame, chunks: DataFrame, holders: DataFrame | None = None) -> DataFrame:
    """Query terms the corpus knows, with idf and the query's total mass.

    ``holders`` are distinct (chunk_id, term) rows of the query terms, the
    ``term_counts`` of the query set by default.
    """
    asked = query_terms(queries)
    holders = term_counts(chunks, asked) if holders is None else holders
    df = (
        holders.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", smoothed_idf(F.col("df"), chunk_count(chunks)))
    )
    return asked.join(df, "term").withColumn(
        "mass", F.sum("idf").over(W.partitionBy("query_id"))
    )


def relevance_of(members: DataFrame, weighted: DataFrame) -> DataFrame:
    """Relevance of given (query_id, chunk_id, text) rows, 0 when nothing matches."""
    parts = members.select(
        "query_id", "chunk_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence", "body")
    ).select("query_id", "chunk_id", "sentence", F.explode(T.terms(F.col("body"))).alias("term"))
    return _best_share(parts.join(checked_broadcast(weighted), ["query_id", "term"]))


def relevance_everywhere(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Relevance of every chunk that matches any query at all, in one text scan.

    A chunk's matched terms come as one row, which is scored against all queries
    where it lies (``matching``): queries share their common terms, so a join on
    terms would make far more rows than there are chunks and queries to match.
    """
    wanted = checked_broadcast(query_terms(queries).select("term").distinct())
    held = durable(_held(
        chunks.select("chunk_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence", "body"))
        .select("chunk_id", "sentence", F.explode(T.terms(F.col("body"))).alias("term"), F.lit(1.0).alias("weight"))
        .join(wanted, "term", "left_semi")
    ))
    holders = held.select("chunk_id", F.explode(F.array_distinct("cells.term")).alias("term"))
    weighted = weighted_query_terms(queries, chunks, holders)
    few = _weights(weighted)
    if few is None:
        return _best_share(held.select("chunk_id", F.inline("cells")).join(weighted, "term"))
    return scored_everywhere(held, few, dict(queries.dtypes)["query_id"], share=True).select(
        "query_id", "chunk_id", F.round("score", 6).alias("relevance")
    )


def _best_share(matches: DataFrame) -> DataFrame:
    return (
        matches.groupBy("query_id", "chunk_id", "sentence")
        .agg(F.sum("idf").alias("matched"), F.max("mass").alias("mass"))
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.max(F.col("matched") / F.col("mass")), 6).alias("relevance"))
    )
