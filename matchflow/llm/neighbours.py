"""Approximate nearest neighbours by cross-polytope hashing.

A table hashes a unit vector by pseudo-random rotations: sign flips and fast
Hadamard transforms, three times over. The bucket is the signed axis nearest to
the rotated vector (``width`` axes in a row give finer buckets). A query also
probes the buckets whose axes are next nearest, in order of what they lose
against the best. All rows of the probed buckets are candidates; they are
compared by their true distance.

Candidates and probing queries meet by (table, bucket). A bucket is cut into
pieces of bounded size, and so are its queries, each piece of the one meeting
each piece of the other; a task holds one piece and streams queries past it. Per
piece only a query's k nearest leave the task. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.llm.common import ready, stored, table
from matchflow.llm.topk import usable
from matchflow.llm.vectors import in_pieces, matrix, runs, width_of

TABLES, PROBES, WIDTH, SEED = 4, 36, 1, 13
#: Candidates of a bucket that are held at once, and queries that meet them in one task.
PIECE_ROWS, PIECE_QUERIES = 4096, 16_384
#: Rows of a table of bucket sizes that may be broadcast.
BROADCAST_ROWS = 100_000

_KEY = ["tab", "bucket", "piece", "query_piece"]


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, step = rows.shape[1], 1
    while step < n:
        pairs = rows.reshape(len(rows), -1, 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(-1, n)
        step *= 2
    return rows / np.sqrt(n)


def rotated(rows: np.ndarray, number: int) -> np.ndarray:
    """Pseudo-random rotation ``number``."""
    signs = np.random.default_rng([SEED, number]).integers(0, 2, (3, rows.shape[1])) * 2 - 1
    for flip in signs:
        rows = hadamard(rows * flip)
    return rows


def buckets(unit: np.ndarray, tables: int, width: int, probes: int) -> np.ndarray:
    """The ``probes`` best buckets of every row in each table: (rows, tables, probes).

    Best first. Fewer where there are fewer buckets.
    """
    n, dims = unit.shape
    probes = min(probes, (2 * dims) ** width)
    out = np.zeros((n, tables, probes), "i8")
    for t in range(tables):
        code, loss = np.zeros((n, 1), "i8"), np.zeros((n, 1))
        for w in range(width):
            y = rotated(unit, t * width + w)
            signed = np.stack([y, -y], axis=2).reshape(n, 2 * dims)  # axis 2i is +i, 2i + 1 is -i
            few = min(probes, 2 * dims)
            axes = np.argsort(-signed, axis=1, kind="stable")[:, :few]
            own = (signed.max(axis=1)[:, None] - np.take_along_axis(signed, axes, axis=1)) ** 2
            # The best of all combinations consist of the best of each part.
            loss = (loss[:, :, None] + own[:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * (2 * dims) + axes[:, None, :]).reshape(n, -1)
            keep = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            loss, code = np.take_along_axis(loss, keep, axis=1), np.take_along_axis(code, keep, axis=1)
        out[:, t] = code
    return out


def _hashed(dims: int, tables: int, width: int, probes: int):
    @F.arrow_udf("array<struct<tab:int,bucket:bigint>>")
    def hashes(vectors: pa.Array) -> pa.Array:
        rows = matrix(vectors, dims)
        rows = np.pad(rows, ((0, 0), (0, (1 << max(dims - 1, 0).bit_length()) - dims)))
        found = buckets(rows / np.linalg.norm(rows, axis=1, keepdims=True), tables, width, probes)
        n, t, p = found.shape
        each = pa.StructArray.from_arrays(
            [pa.array(np.tile(np.repeat(np.arange(t, dtype="i4"), p), n)), pa.array(found.ravel())], ["tab", "bucket"]
        )
        return pa.ListArray.from_arrays(np.arange(0, n * t * p + 1, t * p, dtype="i4"), each)

    return hashes


def k_nearest(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """The k nearest rows of each query: (query number, id, distance).

    Distances are first estimated by products; whatever can be among the k
    within the error of that is measured exactly.
    """
    own, asked = (rows ** 2).sum(axis=1), (queries ** 2).sum(axis=1)
    rough = own[None, :] + asked[:, None] - 2 * (queries @ rows.T)
    rough[ids[None, :] == query_ids[:, None]] = np.inf
    slack = 1e-9 * (own.max() + asked)
    far = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
    number, place = np.nonzero((rough <= (far + 2 * slack)[:, None]) & np.isfinite(rough))
    exact = np.sqrt(((rows[place] - queries[number]) ** 2).sum(axis=1))
    order = np.lexsort((ids[place], exact, number))
    number, place, exact = number[order], place[order], exact[order]
    rank = np.arange(len(number)) - np.searchsorted(number, number)
    keep = rank < k
    return number[keep], ids[place[keep]], exact[keep]


def _meeting(dims: int, k: int):
    """Sorted rows: the candidates of a piece, then the queries that meet them."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held = None, [], []
        for (*at, kind), part in runs(batches, [*_KEY, "kind"]):
            if at != key:
                key, ids, held = at, [], []
            own, rows = part.column("id").to_numpy(), matrix(part.column("vector"), dims)
            if kind == 0:
                ids.append(own)
                held.append(rows)
                continue
            if not ids:
                continue
            if len(ids) > 1:
                ids, held = [np.concatenate(ids)], [np.concatenate(held)]
            for i in range(0, len(own), 512):
                asked = own[i:i + 512]
                number, found, distance = k_nearest(ids[0], held[0], asked, rows[i:i + 512], k)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(asked[number]), "vec_id": pa.array(found), "score": pa.array(distance),
                })

    return meet


def _usable_rows(df: DataFrame) -> DataFrame:
    rows = df.select(F.col("vec_id").cast("long").alias("id"), "vector").filter(
        F.col("vec_id").isNotNull() & usable(F.col("vector"))
    )
    return rows.filter(F.exists("vector", lambda x: x != 0))


def nearest(
    candidates: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES, width: int = WIDTH
) -> DataFrame:
    """The k nearest candidates found for each query, by Euclidean distance.

    Both inputs: (vec_id long, vector array of float or double). Rows without
    id, and vectors that are null, zero, empty or hold null or non-finite
    components take no part. A candidate with the query's own id takes no part.
    Rows that repeat an id are one candidate, at its nearest vector; of queries
    under one id the first by its components asks. Ties go to the smaller id.
    Vectors of different length end in zeros. Buckets follow directions, so
    recall is meant for vectors of similar length. Empty input gives no row.
    Returns query_id, rank, vec_id, score.
    """
    ready(candidates.sparkSession)
    all_rows, asked = _usable_rows(candidates), _usable_rows(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    dims = max(width_of(all_rows), width_of(asked))
    own = stored(all_rows.withColumns({
        "hashes": _hashed(dims, tables, width, 1)("vector"), "row_no": F.monotonically_increasing_id(),
    }), "hashed")
    ask = stored(asked.withColumns({
        "hashes": _hashed(dims, tables, width, probes)("vector"), "row_no": F.monotonically_increasing_id(),
    }), "probing")

    def spread(df: DataFrame, *columns: str) -> DataFrame:
        return df.select(*columns, F.explode("hashes").alias("h")).select(*columns, "h.*")

    sizes = spread(own).groupBy("tab", "bucket").agg(F.count("*").alias("rows")).join(
        spread(ask).groupBy("tab", "bucket").agg(F.count("*").alias("asked")), ["tab", "bucket"]
    )
    if tables * (2 * max(dims, 1)) ** width <= BROADCAST_ROWS:  # there are no more buckets
        sizes = F.broadcast(sizes)

    def others(count: str, most: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(count) / most), F.lit(1)).cast("int") - 1))

    columns = ["id", "vector", "row_no"]
    left = spread(own, *columns).join(sizes, ["tab", "bucket"]).select(
        "tab", "bucket", in_pieces(F.col("bucket"), "rows", PIECE_ROWS).alias("piece"),
        others("asked", PIECE_QUERIES).alias("query_piece"), F.lit(0).alias("kind"), "id", "vector",
    )
    right = spread(ask, *columns).join(sizes, ["tab", "bucket"]).select(
        "tab", "bucket", others("rows", PIECE_ROWS).alias("piece"),
        in_pieces(F.col("bucket"), "asked", PIECE_QUERIES).alias("query_piece"), F.lit(1).alias("kind"), "id", "vector",
    )
    met = left.unionByName(right).repartition(*_KEY).sortWithinPartitions(*_KEY, "kind")
    found = met.mapInArrow(_meeting(dims, k), "query_id bigint, vec_id bigint, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    by_rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op13_neighbours(spark, sf_dir: str) -> DataFrame:
    """Queries are the embeddings of ids divisible by 100; ten nearest each."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), 10)


ORACLE: dict[str, str] = {}
QUERIES = {"op13_neighbours": op13_neighbours}
