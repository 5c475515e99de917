"""Vector code compression by product quantisation over value dictionaries.

Vectors of whole numbers are cut into equal parts; a code names the nearest
entry of each part's codebook. The table is first written as chunks of rows. A
chunk keeps, for each dimension, its distinct values (the dictionary) and per
row the place of the value there. Assigning a chunk tabulates, per dimension,
the squared difference of every distinct value to every entry of the codebook;
distances of the parts are then rows gathered from these tables by code and
added up. No difference is computed for a row.

A round of training is one pass over the chunks: tasks return sums and counts
per entry, which are added in Spark. Only the codebooks, entries times
dimensions, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import ready, stored, table
from matchflow.llm.topk import scaled, usable
from matchflow.llm.vectors import matrix, width_of

#: Rows of a chunk at most, so that places fit 16 bits.
CHUNK_ROWS = 4096
#: Components must be smaller than this in size: sums over a part then fit 64 bits.
LARGEST = 1 << 26
#: Salts of a label when its total goes back to its rows.
SALTS = 32

_CHUNK = "ids array<bigint>, labels array<string>, sizes binary, values binary, places binary"


def _chunked(width: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(at, CHUNK_ROWS)
                rows = matrix(batch.column("vector"), width)
                if np.abs(rows).max(initial=0) >= LARGEST:
                    raise ValueError(f"components must be below {LARGEST} in size")
                pairs = [np.unique(column, return_inverse=True) for column in rows.astype("i8").T]
                sizes = np.array([len(values) for values, _ in pairs], "<i4")
                places = np.array([p for _, p in pairs], "<u2").reshape(width, len(rows))
                values = np.concatenate([v for v, _ in pairs]) if pairs else np.zeros(0)
                one = lambda name: pa.ListArray.from_arrays([0, len(rows)], batch.column(name))  # noqa: B023,E731
                yield pa.RecordBatch.from_pydict({
                    "ids": one("vec_id"), "labels": one("label"),
                    "sizes": pa.array([sizes.tobytes()], pa.binary()),
                    "values": pa.array([values.astype("<i8").tobytes()], pa.binary()),
                    "places": pa.array([places.tobytes()], pa.binary()),
                })

    return chunks


def nearest(dictionaries: list[np.ndarray], places: np.ndarray, codebook: np.ndarray, parts: int):
    """Code and squared distance of every row and part, ties to the lower entry.

    ``codebook`` is (entries, dimensions); ``places`` (dimensions, rows).
    """
    width, rows = places.shape
    each = width // parts
    codes, errors = np.zeros((rows, parts), "u1"), np.zeros((rows, parts), "i8")
    for part in range(parts):
        total = np.zeros((rows, len(codebook)), "i8")
        for d in range(part * each, (part + 1) * each):
            squares = (dictionaries[d][:, None] - codebook[None, :, d]) ** 2  # distinct values times entries
            total += squares[places[d]]
        codes[:, part] = total.argmin(axis=1)
        errors[:, part] = np.take_along_axis(total, codes[:, part:part + 1].astype("i8"), axis=1)[:, 0]
    return codes, errors


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    for row in range(batch.num_rows):
        ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
        sizes = np.frombuffer(batch.column("sizes")[row].as_py(), "<i4")
        values = np.frombuffer(batch.column("values")[row].as_py(), "<i8")
        places = np.frombuffer(batch.column("places")[row].as_py(), "<u2").reshape(len(sizes), len(ids))
        yield ids, labels, np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else [], places


def _summing(codebook: np.ndarray, parts: int):
    """Per task: sum and count of the rows of each entry, by dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, width = codebook.shape
        total, count = np.zeros((width, entries), "i8"), np.zeros((parts, entries), "i8")
        for batch in batches:
            for _, _, dictionaries, places in _read(batch):
                codes, _ = nearest(dictionaries, places, codebook, parts)
                for part in range(parts):
                    count[part] += np.bincount(codes[:, part], minlength=entries)
                for d in range(width):
                    # Rows of each (value, entry) are counted; values go in once, times their count.
                    code, values = codes[:, d * parts // width].astype("i8"), dictionaries[d]
                    held = np.bincount(places[d].astype("i8") * entries + code, minlength=len(values) * entries)
                    total[d] += values @ held.reshape(len(values), entries)
        d, entry = np.nonzero(np.repeat(count, width // parts, axis=0) if width else np.zeros((0, entries)))
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array(d, pa.int32()), "entry": pa.array(entry, pa.int32()),
            "total": pa.array(total[d, entry], pa.int64()),
            "rows": pa.array(count[d * parts // max(width, 1), entry], pa.int64()),
        })

    return sums


def _encoding(codebook: np.ndarray, parts: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, dictionaries, places in _read(batch):
                codes, errors = nearest(dictionaries, places, codebook, parts)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids, "label": labels,
                    "code": pa.array([c.tobytes() for c in codes], pa.binary()),
                    "error": pa.array(errors.sum(axis=1), pa.int64()),
                })

    return encode


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebook as a matrix of entries and dimensions.

    Input: (vec_id long, label, vector array of whole numbers below 2^26 in
    size; larger ones are refused). Codebooks start as the vectors of the
    smallest ids (rows under one id by their components, rows without id last)
    and are trained for ``rounds`` rounds over all rows: each entry becomes the
    mean, rounded down, of the parts assigned to it; an unused one stays.
    Vectors of different length end in zeros, up to a multiple of ``parts``.
    Repeated rows count each. Without rows there are no codes and no entries.

    The codes come as (vec_id, label as text, code binary of ``parts`` bytes,
    error): at most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = ready(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "vector")
    width = -(-width_of(rows) // parts) * parts
    chunks = stored(rows.mapInArrow(_chunked(width), _CHUNK), "vector-chunks")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    codebook = np.array([list(r["vector"]) + [0.0] * (width - len(r["vector"])) for r in first]).astype("i8")
    if not first:
        return spark.createDataFrame([], "vec_id long, label string, code binary, error long"), codebook
    for _ in range(rounds):
        sums = chunks.mapInArrow(_summing(codebook, parts), "dim int, entry int, total bigint, rows bigint")
        means = sums.groupBy("dim", "entry").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
        codebook = codebook.copy()
        for r in means.collect():  # entries times dimensions
            codebook[r["entry"], r["dim"]] = r["total"] // r["rows"]
    codes = chunks.mapInArrow(_encoding(codebook, parts), "vec_id bigint, label string, code binary, error bigint")
    return codes, codebook


def decompress(codes: DataFrame, codebook: np.ndarray, parts: int = 16) -> DataFrame:
    """The vector that each code stands for: (vec_id, vector)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = codebook.shape[1] // parts
        for batch in batches:
            picked = np.frombuffer(b"".join(batch.column("code").to_pylist()), "u1").reshape(-1, parts)
            whole = [codebook[picked[:, p], p * each:(p + 1) * each] for p in range(parts)]
            vectors = pa.array(list(np.concatenate(whole, axis=1)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "vector": vectors})

    return codes.select("vec_id", "code").mapInArrow(decode, "vec_id bigint, vector array<bigint>")


def codebook_text(codebook: np.ndarray, parts: int = 16) -> str:
    """All components by part, entry and place within the part."""
    entries, width = codebook.shape if codebook.size else (0, 0)
    return ",".join(map(str, codebook.reshape(entries, parts, -1).transpose(1, 0, 2).ravel().tolist())) if width else ""


def with_label_error(codes: DataFrame) -> DataFrame:
    """Errors summed over equal labels, nulls together.

    Totals are added in the tasks first. They go back to the rows by label and
    salt, so that the rows of one label spread over many tasks.
    """
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = lambda df: df.withColumn("held", F.col("label").isNotNull()).fillna("", ["label"])
    own = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    return keyed(codes).withColumn("salt", own).join(keyed(salted), ["label", "held", "salt"]).drop("salt", "held")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Embeddings as floor(256 * x) in 16 parts of 64 entries, two rounds."""
    kept = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")))
    vectors = kept.select("vec_id", "label", scaled(F.col("embedding"), 256).alias("vector"))
    codes, codebook = compress(vectors, 16, 64, 2)
    digest = hashlib.sha256(codebook_text(codebook).encode()).hexdigest()
    return with_label_error(stored(codes, "vector-codes")).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


_ROUND = """
n{i} AS (
  SELECT r, label, p, x, list_transform(range(CAST(len(es) AS BIGINT)), lambda e:
      list_sum(list_transform(list_zip(x, es[e + 1]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS ds
  FROM parts JOIN b{i} USING (p)
), a{i} AS (
  SELECT r, label, p, x, list_position(ds, list_min(ds)) AS e, list_min(ds) AS d FROM n{i}
)"""
_MEANS = """, m{i} AS (
  SELECT p, e, list(s ORDER BY j) AS v FROM (
    SELECT p, e, j, CAST(floor(sum(y) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS s
    FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY p, e, j) GROUP BY p, e
), b{k} AS (
  SELECT p, list(coalesce(v, old) ORDER BY e) AS es FROM (
    SELECT p, unnest(es) AS old, generate_subscripts(es, 1) AS e FROM b{i}) LEFT JOIN m{i} USING (p, e) GROUP BY p
),"""
ORACLE = {
    "op11_vector_codes": """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
    row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT r, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x
  FROM v CROSS JOIN (SELECT CAST(unnest(range(16)) AS INT) AS p)
), b0 AS (
  SELECT p, list(x ORDER BY r) AS es FROM parts WHERE r <= 64 GROUP BY p
),""" + _ROUND.format(i=0) + _MEANS.format(i=0, k=1) + _ROUND.format(i=1) + _MEANS.format(i=1, k=2) + _ROUND.format(i=2) + """
, c AS (
  SELECT r, string_agg(printf('%02x', CAST(e - 1 AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a2 GROUP BY r
), h AS (
  SELECT sha256(string_agg(array_to_string(flatten(es), ','), ',' ORDER BY p)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN v USING (r) CROSS JOIN h
"""
}
QUERIES = {"op11_vector_codes": op11_vector_codes}
