"""Exact top-k by integer inner product: term-at-a-time accumulation, partition selection, merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and candidates that meet in one task, about; candidates that a dense score array holds.
QUERIES = 4096
CANDIDATES = 8192
BLOCK = 4096
#: Candidate parts whose best are merged at once.
MERGED = 64


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null where the vector is null or holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def rows_of(column: pa.ListArray) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def postings(vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For every component number that is not zero somewhere: the rows that have it and its weights there."""
    width = max((len(v) for v in vectors), default=0)
    dense = np.zeros((width, len(vectors)), np.int64)
    for i, v in enumerate(vectors):
        dense[: len(v), i] = v
    out = {}
    for term in range(width):
        at = np.flatnonzero(dense[term])
        if len(at):
            out[term] = (slice(None) if len(at) == len(vectors) else at, dense[term][at])
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, in that order."""
    at = np.arange(len(scores))
    if len(at) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        sure = np.flatnonzero(scores > edge)
        tied = np.flatnonzero(scores == edge)
        need = k - len(sure)
        if need < len(tied):
            tied = tied[np.argpartition(ids[tied], need - 1)[:need]]
        at = np.concatenate((sure, tied))
    return at[np.lexsort((ids[at], -scores[at]))]


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", weight_col: str = "w") -> DataFrame:
    """(query_id, rank, vec_id, score): for every query the k rows of vectors with the highest inner products.

    Both tables hold an id and an array of longs, whose missing components count as zero. A row is not its own candidate:
    rows that share the query's id are left out; other rows of equal vectors all count, ties go to the smaller id and then
    stand side by side. Repeated rows of one query id ask once (of differing vectors, the smallest in order). Null ids and
    null vectors take no part. Fewer than k candidates give all; no rows give none. Products and sums are 64-bit integers.

    Queries are dealt into parts of a bounded size, and candidates as well; each pair of parts is one unit of work, whose
    number grows with queries times candidates as the exhaustive search does. Within it, every query's non-zero components
    are taken one by one: each scatters its weighted postings into a dense array of scores. Every task keeps the k best of
    a query, and a last step merges them.
    """
    asked = queries.where(F.col(id_col).isNotNull() & F.col(weight_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(weight_col).alias("w"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(weight_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(weight_col).alias("w"))
    n_queries, n_rows = asked.count(), rows.count()
    q_parts, c_parts = max(1, -(-n_queries // QUERIES)), max(1, -(-n_rows // CANDIDATES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = asked.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_parts)).cast("int").alias("q"), each(c_parts).alias("c"), F.lit(True).alias("asks"), "id", "w")
    dealt = rows.select(each(q_parts).alias("q"), F.pmod(F.xxhash64("id", "w"), F.lit(c_parts)).cast("int").alias("c"), F.lit(False).alias("asks"), "id", "w")
    met = spread.union(dealt).repartitionById(q_parts * c_parts, F.col("q") * c_parts + F.col("c")).sortWithinPartitions("q", "c", F.desc("asks"), "id")  # a task each

    def scored(batches):
        pair, q_ids, q_terms, found = None, [], [], {}

        def told():
            out = [(q, *x, pair[1] // MERGED) for q, (ids, scores) in found.items() for x in zip(ids.tolist(), scores.tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score", "part"])

        def block(ids, own):
            lists = postings(own)
            for q, terms in zip(q_ids, q_terms, strict=True):
                scores = np.zeros(len(ids), np.int64)
                for term, weight in terms:
                    if term in lists:
                        at, weights = lists[term]
                        scores[at] += weight * weights
                other = np.flatnonzero(ids != q)
                at = other[best(scores[other], ids[other], k)]
                had = found.get(q)
                new = (ids[at], scores[at]) if had is None else (np.concatenate((had[0], ids[at])), np.concatenate((had[1], scores[at])))
                top = best(new[1], new[0], k)
                found[q] = new[0][top], new[1][top]

        for batch in batches:
            if not batch.num_rows:
                continue
            q, c, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero((np.diff(q) != 0) | (np.diff(c) != 0) | (asks[1:] != asks[:-1])) + 1
            cuts = [0, *cuts.tolist(), len(q)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if pair != (q[a], c[a]):
                    yield from told()
                    pair, q_ids, q_terms, found = (q[a], c[a]), [], [], {}
                own = rows_of(batch.column(4).slice(a, b - a))
                if asks[a]:
                    q_ids += ids[a:b].tolist()
                    q_terms += [[(t, v[t]) for t in np.flatnonzero(v).tolist()] for v in own]
                else:
                    for i in range(0, b - a, BLOCK):
                        block(ids[a + i : min(a + i + BLOCK, b)], own[i : i + BLOCK])
        yield from told()

    near = met.mapInArrow(scored, "query_id long, vec_id long, score long, part long")
    if c_parts > MERGED:  # else a query's best of many parts would all meet in one window
        near = near.withColumn("rank", F.expr("row_number() over (partition by query_id, part order by score desc, vec_id)")).where(F.col("rank") <= k)
    ranked = near.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k nearest of all rows for every row whose vec_id is divisible by `every`."""
    rows = embeddings.select("vec_id", quantised(F.col("embedding")).alias("w")).where("w is not null and vec_id is not null")
    return search(rows.where(F.col("vec_id") % every == 0), rows, k)
