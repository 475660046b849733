"""Exact top-k inner products by MaxScore over shards.

Vectors are quantised to integers, floor(``SCALE`` * x).  A term is a dimension;
its posting list in a shard holds the shard's values of that dimension.  The
bound of a term for a query is the largest product that the list can add
(from its greatest and least value).  Terms are ordered by how far bound and
least product lie apart.  Candidates are taken ``CHUNK`` at a time; with a query's
threshold (its k-th best score so far, which rises on the way) and the suffix
sums of bounds, its terms split into essential ones, whose postings are traversed
for every candidate, and non-essential ones, probed only for candidates that
partial score plus remaining bounds leaves competitive (ties included).  Each
(shard, block of queries) yields at most k rows per query; they are merged by a
ranking window.

Candidates go in shards, queries in blocks of at most about ``TILE`` bytes each,
and every block meets every shard: the stated query set against all rows, in
tiles of bounded size, none of them broadcast.

Defined cases: empty tables give empty results; vectors that are null or hold a null or a non-finite component
take no part, nor do null ids; vectors of different lengths are compared as if
filled up with zeros; ties go to the smaller id; a repeated id is a candidate for other ids'
queries once per row, and a repeated query id answers once; scores beyond 64 bits saturate; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE, K = 1024, 10
#: Bytes of a shard's candidates and of a block's queries; rows of a shard if it could be spread over more cores.
TILE, SHARD = 32 << 20, 8192
#: Candidates between two looks at the thresholds, and terms between two looks at a candidate.
CHUNK, STEP = 1024, 8


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v array<double>): whole numbers; rows that take no part are gone."""
    raw = vectors.select(vectors[id_column].alias("id"), vectors[vector_column].cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a double is a long and saturates
    return raw.where(fine).select("id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")).alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def max_score(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best of one shard; matrices of whole numbers whose sums are exact in doubles."""
    most, least = rows.max(0), rows.min(0)
    order = np.argsort(-(most - least) * np.abs(queries).max(0), kind="stable")  # one order for the block, so that its postings are read together
    queries, rows, most, least = queries[:, order], np.ascontiguousarray(rows[:, order]), most[order], least[order]
    n, width = queries.shape
    bounds = np.maximum(queries * most, queries * least)
    remaining = np.concatenate([np.cumsum(bounds[:, ::-1], 1)[:, ::-1], np.zeros((n, 1))], 1)  # what terms from t on add at most
    usual = np.concatenate([np.zeros((n, 1)), np.cumsum(queries * rows.mean(0), 1)], 1)  # what an average candidate has up to term t
    scores, found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    for start in range(0, len(rows), CHUNK):
        part, own = rows[start : start + CHUNK], ids[start : start + CHUNK]
        thresholds = scores[:, -1]  # they rise from chunk to chunk
        # essential: the terms without which the others could still lift an average candidate to the query's threshold
        out = usual + remaining < thresholds[:, None]
        split = np.where(out.any(1), out.argmax(1), width)
        split = np.minimum(-(-split // STEP) * STEP, width)
        for s in np.unique(split).tolist():
            asked = np.flatnonzero(split == s)
            partial = queries[asked, :s] @ part[:, :s].T
            competitive = (partial + remaining[asked, s, None] >= thresholds[asked, None]) & (query_ids[asked, None] != own)
            for i, q in enumerate(asked.tolist()):
                alive = np.flatnonzero(competitive[i])
                score, t = partial[i, alive], s
                while t < width and len(alive):
                    stop = min(t + STEP, width)  # probe a few terms, then drop what can no longer compete
                    score = score + part[alive, t:stop] @ queries[q, t:stop]
                    t = stop
                    keep = score + remaining[q, t] >= thresholds[q]
                    alive, score = alive[keep], score[keep]
                if len(alive):
                    both, names = np.concatenate([scores[q], score]), np.concatenate([found[q], own[alive]])
                    best = _best(both, names, k)
                    scores[q], found[q] = both[best], names[best]
    real = np.isfinite(scores)
    return np.repeat(query_ids, k).reshape(n, k)[real], found[real], scores[real]


def _exactly(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> list[tuple[int, int, int]]:
    """The same with Python's integers, for values whose sums doubles can't hold."""
    out = []
    whole = [[int(x) for x in v] for v in rows["v"]]
    for query, vector in zip(queries["id"], queries["v"], strict=True):
        own = [int(x) for x in vector]
        scores = [(-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in zip(rows["id"], whole, strict=True) if i != query]
        out += [(query, i, min(max(-s, -(2**63)), 2**63 - 1)) for s, i in sorted(scores)[:k]]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score); ``is_query`` is a condition on ``id``."""
    rows = quantised(vectors, id_column, vector_column, scale)
    total, asked, width = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    fits = max(1, TILE // (8 * max(1, width or 1)))
    shards, blocks = max(1, -(-total // fits), min(-(-total // SHARD), vectors.sparkSession.sparkContext.defaultParallelism)), max(1, -(-asked // fits))
    spread = F.xxhash64("id", F.lit(5))
    queries = rows.where(is_query).dropDuplicates(["id"]).withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    candidates = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(6)), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        found: tuple = ([], [], [])
        if len(asked) and len(given):
            width = max(map(len, [*asked["v"], *given["v"]]))
            q, r = _matrix(asked["v"], width), _matrix(given["v"], width)
            if width * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(r).max(initial=0)) < 2**52:
                found = max_score(q, asked["id"].to_numpy(), r, given["id"].to_numpy(), k)
            else:
                found = tuple(zip(*_exactly(asked, given, k), strict=True)) or found
        return pd.DataFrame({"query_id": np.asarray(found[0], np.int64), "vec_id": np.asarray(found[1], np.int64), "score": np.asarray(found[2]).astype(np.int64)})

    # both sides of a cell are bounded, whatever the size of the table
    found = queries.groupBy("shard", "block").cogroup(candidates.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
