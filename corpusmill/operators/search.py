"""Exact similarity search over a table of unit vectors, metadata by key, and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SearchConfig
from ..functions.vectors import dot

QUERY_BLOCK = 1024


def search_one(index: DataFrame, query: list[float], k: int = SearchConfig.recall_k, id_col="chunk_id", vector_col="embedding") -> DataFrame:
    """score and id of the ``k`` nearest; ties by id. Planned as a top-k without a full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return index.select(F.col(id_col), dot(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def search_many(index: DataFrame, queries: DataFrame, k: int = SearchConfig.recall_k, id_col="chunk_id", vector_col="embedding", query_id="query_id", query_vec="query_vec") -> DataFrame:
    """query_id, id, score and rank of the ``k`` nearest to every query, exactly; ties by id.

    The stated queries are read in blocks of QUERY_BLOCK; each block is broadcast to the index's partitions,
    which multiply matrices and send their ``k`` best a query, so what is shuffled is queries * k a partition
    and not queries * index. A loop step is one block whatever the size of either side."""
    blocks = _query_blocks(queries, query_id, query_vec)
    spark = index.sparkSession
    id_type, q_type = index.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    schema = f"{query_id} {q_type}, {id_col} {id_type}, score double"
    parts = []
    for ids, matrix in blocks:
        shared = spark.sparkContext.broadcast((ids, matrix))
        parts.append(index.select(id_col, vector_col).mapInArrow(_nearest(shared, k, id_col, query_id), schema))
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), F.col(id_col))
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _query_blocks(queries: DataFrame, query_id: str, query_vec: str) -> Iterator[tuple[list, np.ndarray]]:
    ids: list = []
    rows: list = []
    for r in queries.select(query_id, query_vec).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == QUERY_BLOCK:
            yield ids, np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, np.float64)


def _nearest(shared, k: int, id_col: str, query_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, matrix = shared.value
        best_score = np.full((len(q_ids), 0), -np.inf)
        best_row = np.zeros((len(q_ids), 0), np.int64)
        kept: list = []
        for batch in batches:
            vectors = batch.column(1)
            if not len(vectors):
                continue
            rows = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)
            start = len(kept)
            kept.extend(batch.column(0).to_pylist())
            score = np.concatenate((best_score, matrix @ rows.T), axis=1)
            row = np.concatenate((best_row, np.broadcast_to(np.arange(start, len(kept)), (len(q_ids), len(rows)))), axis=1)
            # Ties at the k-th place go to the smaller id, so order by (-score, id), on ranks of the ids.
            used, place = np.unique(row, return_inverse=True)
            order_of = np.empty(len(used), np.int64)
            order_of[sorted(range(len(used)), key=lambda i: kept[used[i]])] = np.arange(len(used))
            order = np.lexsort((order_of[place.reshape(row.shape)], -score), axis=1)[:, :k]
            best_score, best_row = np.take_along_axis(score, order, 1), np.take_along_axis(row, order, 1)
            # Ids of rows that no query holds any more are let go.
            live, place = np.unique(best_row, return_inverse=True)
            kept, best_row = [kept[i] for i in live], place.reshape(best_row.shape)
        if best_row.shape[1]:
            n = best_row.shape[1]
            flat = [kept[i] for i in best_row.reshape(-1)]
            q = [i for i in q_ids for _ in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(flat), pa.array(best_score.reshape(-1))], names=[query_id, id_col, "score"])

    return run


def with_metadata(hits: DataFrame, metadata: DataFrame, id_col="chunk_id") -> DataFrame:
    """Title and text by key; hits are few, so the join is planned around them."""
    return hits.join(metadata.select(id_col, "title", "text"), id_col, "left")


def self_check(index: DataFrame, k: int = 5, probes: int = 3, id_col="chunk_id", vector_col="embedding", least: float = 0.999) -> DataFrame:
    """For a few vectors of the index: whether each finds itself first with a score above ``least``."""
    queries = index.orderBy(id_col).limit(probes).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query_vec"))
    top = search_many(index, queries, k, id_col, vector_col).filter("rank = 1")
    return top.select("query_id", id_col, "score", ((F.col("query_id") == F.col(id_col)) & (F.col("score") > least)).alias("passed"))


def rerank(hits: DataFrame, top_m: int = SearchConfig.top_m, scorer: Callable[[DataFrame], DataFrame] | None = None, query_id="query_id", id_col="chunk_id") -> DataFrame:
    """The ``top_m`` best of each query's hits by ``scorer``, which adds a column ``rerank_score``; without
    one the order stays. Candidates are only reordered, never changed."""
    scored = scorer(hits) if scorer else hits.withColumn("rerank_score", F.col("score"))
    order = Window.partitionBy(query_id).orderBy(F.desc("rerank_score"), F.desc("score"), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_m)
