"""Exact vector search of a stated query set against all vectors, in blocks of queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import retrieval
from corpusmill.operators.retrieval import ROWS
from corpusmill.runtime import settle


#: Queries per block at most, besides MATRIX_CELLS numbers.
BLOCK = 100_000


def _matrix(column) -> np.ndarray:
    """Unit vectors of a list column without nulls; zero vectors stay zero."""
    n = len(column)
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def top_k(queries: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k most similar other vectors of each query, ties by id.

    A block of queries is a matrix of at most MATRIX_CELLS cells, the most that reaches the driver at a time and is
    broadcast; each block is one scan of the vectors, in which every task keeps k per query, so little is shuffled.  The bests of a
    block are written before the next one starts.  Null vectors match nothing; vectors of another length are an error.
    """
    spark = vectors.sparkSession
    of = lambda df: df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    every, asked = of(vectors), of(queries)
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    n_blocks = max(-(-n // BLOCK), -(-n * max(width, 1) // retrieval.MATRIX_CELLS))
    parts = None
    for i in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == i).toArrow().combine_chunks()
        ids = block.column("id").to_numpy()
        shared = spark.sparkContext.broadcast((ids, _matrix(block.column("v").combine_chunks())))

        def run(batches, shared=shared):
            q_ids, q = shared.value
            add, rows = retrieval._keep_best(k, len(q_ids))
            for batch in batches:
                for s in range(0, batch.num_rows, ROWS):
                    part = batch.slice(s, ROWS)
                    found = part.column("id").to_numpy()
                    scores = np.round(_matrix(part.column("v")) @ q.T, 9)
                    add(found, np.where(found[:, None] == q_ids[None, :], -np.inf, scores))
            at, found, scores = rows()
            yield retrieval._best_batch(at, found, scores)

        names = spark.createDataFrame(list(enumerate(ids.tolist())), "at int, query_id long")
        best = every.mapInArrow(run, retrieval._BEST).join(F.broadcast(names), "at").select("query_id", "id", "score")  # one block of queries
        if n_blocks > 1:
            best = settle(best, "best-of-block")
            shared.unpersist()
        parts = best if parts is None else parts.unionByName(best)
    return retrieval.top_per_query(parts, k)
