"""Exact top-k search by inner product with block bounds.

Vectors lie in blocks of neighbouring rows. A block keeps its rows (the forward
index) and, per dimension, its largest and smallest value. The sum over the
dimensions of what a query can reach at most in a block bounds every score
there. A query visits blocks in falling order of that bound and stops where the
bound lies below its k-th best score so far. Ties are kept open, so the result
is exact.

Blocks form shards of bounded size, queries form blocks of bounded size, and
each pair of the two is one unit of work; the k best per query and shard are
merged at the end. Nothing grows in a task but the number of units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.llm.common import ready, table

BLOCK_ROWS = 128
SHARD_BLOCKS = 64
QUERY_ROWS = 256

_PACKED = "part bigint, block bigint, ids binary, dims int, values binary"


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def usable(vector: Column) -> Column:
    """Neither null nor holding null, NaN or an infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _packer(rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(taken: list) -> pa.RecordBatch:
            width = max(m.shape[1] for _, m in taken)
            matrix = np.vstack([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in taken])
            ids = np.concatenate([i for i, _ in taken])
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "block": pa.array([count], pa.int64()),
                "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "dims": pa.array([width], pa.int32()),
                "values": pa.array([matrix.astype("<f8").tobytes()], pa.binary()),
            })

        for batch in batches:
            ids, matrix = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            at = 0
            while at < len(ids):
                take = min(rows - size, len(ids) - at)
                held.append((ids[at:at + take], matrix[at:at + take]))
                size, at = size + take, at + take
                if size == rows:
                    yield block(held)
                    held, size, count = [], 0, count + 1
        if held:
            yield block(held)

    return pack


def _unpacked(ids: bytes, dims: int, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8")
    return own, np.frombuffer(values, "<f8").reshape(len(own), dims)


def _widened(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] == width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def search_blocks(
    blocks: list[tuple[np.ndarray, np.ndarray]], query_ids: np.ndarray, queries: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best of some blocks for some queries: (query number, id, score, blocks scored).

    In every round each query that is not finished takes its next best block;
    queries that take the same block are scored together.
    """
    width = max([queries.shape[1], *(m.shape[1] for _, m in blocks)])
    queries = _widened(queries, width)
    blocks = [(ids, _widened(m, width)) for ids, m in blocks]
    highest = np.array([m.max(axis=0) for _, m in blocks])
    lowest = np.array([m.min(axis=0) for _, m in blocks])
    bounds = np.maximum(queries, 0) @ highest.T + np.minimum(queries, 0) @ lowest.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    n = len(queries)
    best_score = np.full((n, k), -np.inf)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    active, scored = np.arange(n), 0
    for turn in range(len(blocks)):
        taken = order[active, turn]
        going = bounds[active, taken] >= best_score[active, k - 1]
        active, taken = active[going], taken[going]
        if not len(active):
            break
        for b in np.unique(taken):
            rows = active[taken == b]
            ids, matrix = blocks[b]
            scored += len(rows)
            scores = queries[rows] @ matrix.T
            scores[ids[None, :] == query_ids[rows, None]] = -np.inf
            all_scores = np.hstack([best_score[rows], scores])
            all_ids = np.hstack([best_id[rows], np.broadcast_to(ids, (len(rows), len(ids)))])
            pick = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best_score[rows] = np.take_along_axis(all_scores, pick, axis=1)
            best_id[rows] = np.take_along_axis(all_ids, pick, axis=1)
    number, place = np.nonzero(np.isfinite(best_score))
    return number, best_id[number, place], best_score[number, place], scored


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]
                blocks = [_unpacked(b["ids"], b["dims"], b["values"]) for b in get("blocks").as_py()]
                ids, queries = _unpacked(get("q_ids").as_py(), get("q_dims").as_py(), get("q_values").as_py())
                number, found, score, _ = search_blocks(blocks, ids, queries, k)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(ids[number], pa.int64()), "vec_id": pa.array(found, pa.int64()),
                    "score": pa.array(score.astype("i8"), pa.int64()),
                })

    return search


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k candidates of highest inner product for each query, exactly.

    Both inputs: (vec_id long, vector array<double>) with finite integral values.
    A candidate with the query's own id takes no part; ties go to the smaller id;
    queries with fewer than k candidates get all. Rows without id take no part,
    of vectors under one id all are candidates and the first (by its components)
    is the query. Vectors of different length end in zeros. Empty input gives no
    row. Returns query_id, rank, vec_id, score.
    """
    ready(candidates.sparkSession)
    pick = lambda df: df.select(F.col("vec_id").cast("long"), "vector").filter(F.col("vec_id").isNotNull())
    blocks = pick(candidates).mapInArrow(_packer(BLOCK_ROWS), _PACKED)
    shards = blocks.groupBy("part", F.floor(F.col("block") / SHARD_BLOCKS).alias("shard")).agg(
        F.collect_list(F.struct("ids", "dims", "values")).alias("blocks")
    )
    single = pick(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = single.mapInArrow(_packer(QUERY_ROWS), _PACKED).select(
        F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("values").alias("q_values")
    ).repartition("q_ids")  # packed once, then read again for every shard
    # Blocks of a stated query set against shards of all rows: one unit of work for each pair.
    found = shards.crossJoin(asked).select("blocks", "q_ids", "q_dims", "q_values").mapInArrow(
        _searcher(k), "query_id bigint, vec_id bigint, score bigint"
    )
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark, sf_dir: str) -> DataFrame:
    """Vectors as floor(256 * x); queries are the ids divisible by 50; five best each."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(usable(F.col("embedding")))
    vectors = rows.select("vec_id", scaled(F.col("embedding"), 256).alias("vector"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = {
    "op8_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
QUERIES = {"op8_top_k": op8_top_k}
