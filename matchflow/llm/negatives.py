"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster and a shard of candidates the
list is made once: candidates by the largest score any member could reach with
them, ``|c| * cos(max(0, angle(c, centre) - radius))``, where the radius is the
largest angle of a member. Every member walks that list and stops, certified,
where the bound lies below what it still needs. Scores are exact.

Candidates lie in shards by the same centres, so a shard is a narrow cone.
A unit of work is one cluster of anchors with one shard; what the anchors know
so far travels with them and keeps units that cannot matter from being opened:

1. positives in the shards of the own centre;
2. positives in the shards whose cone can beat the fifth of these;
3. negatives in the shards that can reach the lowest allowed score.

Centres are fitted on a bounded sample of anchors; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.llm.common import ready, stored, table
from matchflow.llm.topk import scaled, usable
from matchflow.llm.vectors import in_pieces, matrix, runs, width_of

#: Anchors the centres are fitted on, at most, and centres made of them.
SAMPLE_ANCHORS, CENTRES, FIT_ROUNDS = 8192, 256, 5
CLUSTER_ANCHORS, SHARD_ROWS = 256, 4096
#: Candidates a member looks at between two looks at the bound.
STEP = 128
#: Bounds are raised by this share, far more than rounding takes.
SLACK = 1e-9


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one (zero rows stay) and their lengths."""
    norms = np.linalg.norm(rows, axis=1)
    return rows / np.where(norms > 0, norms, 1)[:, None], norms


def fit_centres(rows: np.ndarray, most: int = CENTRES) -> np.ndarray:
    """Centres of directions, about one per 32 rows."""
    units, norms = _units(rows)
    units = units[norms > 0]
    if not len(units):
        return np.zeros((1, rows.shape[1]))
    centres = units[:: max(1, len(units) // max(1, min(most, len(units) // 32)))][:most]
    for _ in range(FIT_ROUNDS):
        own = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        new, size = _units(sums)
        centres = np.where((size > 0)[:, None], new, centres)
    return centres


def _placed(centres: np.ndarray, vector: str) -> Column:
    """Nearest centre, angle to it and length of each vector."""
    dims = centres.shape[1]

    @F.arrow_udf("struct<cell:int,angle:double,norm:double>")
    def place(vectors: pa.Array) -> pa.Array:
        units, norms = _units(matrix(vectors, dims))
        cosine = units @ centres.T
        cell = cosine.argmax(axis=1)
        angle = np.arccos(np.clip(np.take_along_axis(cosine, cell[:, None], axis=1)[:, 0], -1, 1))
        angle[norms == 0] = 0  # scores 0 with all, whatever the angle
        return pa.StructArray.from_arrays(
            [pa.array(cell.astype("i4")), pa.array(angle), pa.array(norms)], ["cell", "angle", "norm"]
        )

    return place(vector)


def _indexed(rows: DataFrame, centres: np.ndarray, most: int, group: str) -> DataFrame:
    """Rows in groups of one cell, each of about ``most`` rows at most; stored."""
    placed = stored(rows.withColumn("at", _placed(centres, "vector")).select(
        *rows.columns, "at.*", F.monotonically_increasing_id().alias("row_no")), "placed")
    cells = placed.groupBy("cell").agg(F.count("*").alias("rows"))  # no more rows than centres
    piece = in_pieces(F.col("cell"), "rows", most).cast("long")
    return placed.join(F.broadcast(cells), "cell").withColumn(
        group, F.col("cell") * F.lit(1 << 32) + piece).drop("rows", "row_no")


def _cones(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group, "cell").agg(F.max("angle").alias("radius"), F.max("norm").alias("norm"))


class Wanted:
    """What the members of a cluster still look for, and the best found so far.

    ``high`` and ``low`` bound the scores of each wish; a member has as many
    wishes as columns. ``same`` says which label takes part.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.low, self.high, self.same = low, high, same
        self.score = np.full((*low.shape, k), -np.inf)
        self.id = np.full((*low.shape, k), np.iinfo("i8").max)

    def needed(self) -> np.ndarray:
        """Scores below this cannot matter to a member any more."""
        return np.maximum(self.low, self.score[:, :, -1]).min(axis=1)

    def offer(self, members: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        k = self.score.shape[2]
        for wish in range(self.low.shape[1]):
            low, high = self.low[members, wish, None], self.high[members, wish, None]
            fits = allowed & (scores >= low) & (scores <= high) & (scores >= self.score[members, wish, -1:])
            some = fits.any(axis=1)
            rows = members[some]
            if not len(rows):
                continue
            new = np.where(fits[some], scores[some], -np.inf)
            all_scores = np.hstack([self.score[rows, wish], new])
            all_ids = np.hstack([self.id[rows, wish], np.broadcast_to(ids, new.shape)])
            pick = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            self.score[rows, wish] = np.take_along_axis(all_scores, pick, axis=1)
            self.id[rows, wish] = np.take_along_axis(all_ids, pick, axis=1)


def walk(centre, radius, members: dict, shard: dict, wanted: Wanted) -> int:
    """Members walk the list they share; returns how many pairs were scored.

    ``members`` and ``shard`` hold ids, labels and rows (vectors).
    """
    units, norms = _units(shard["rows"])
    angles = np.arccos(np.clip(units @ centre, -1, 1))
    bounds = norms * np.cos(np.maximum(0, angles - radius))
    order = np.argsort(-bounds, kind="stable")
    bounds, size = bounds[order], np.linalg.norm(members["rows"], axis=1)
    active, scored = np.arange(len(size)), 0
    for at in range(0, len(order), STEP):
        reach = size[active] * bounds[at]
        active = active[reach + SLACK * (np.abs(reach) + size[active] * norms.max() + 1) >= wanted.needed()[active]]
        if not len(active):
            break
        step = order[at:at + STEP]
        ids = shard["ids"][step]
        scored += len(active) * len(step)
        scores = members["rows"][active] @ shard["rows"][step].T
        allowed = (members["labels"][active][:, None] == shard["labels"][step][None, :]) == wanted.same
        allowed &= members["ids"][active][:, None] != ids[None, :]
        wanted.offer(active, scores, ids, allowed)
    return scored


def _walking(centres: np.ndarray, same: bool, k: int):
    """Rows sorted by shard, kind, cluster: the candidates, then cluster after cluster."""
    dims = centres.shape[1]

    def part_of(batches: list[pa.RecordBatch]) -> dict:
        whole = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: whole.column(name).combine_chunks()
        return {"ids": column("id").to_numpy(), "labels": column("label").to_numpy(), "rows": matrix(column("vector"), dims),
                "low": column("low"), "high": column("high")}

    def of_cluster(cluster: int, members: dict, shard: dict) -> pa.RecordBatch:
        width = max(1, *np.diff(members["low"].offsets.to_numpy()))
        bounds = [matrix(members[name], width).copy() for name in ("low", "high")]
        missing = np.arange(width) >= np.diff(members["low"].offsets.to_numpy())[:, None]
        bounds[0][missing], bounds[1][missing] = np.inf, -np.inf  # no wish there
        centre = centres[cluster >> 32]
        units, norms = _units(members["rows"])
        angles = np.arccos(np.clip(units @ centre, -1, 1))
        wanted = Wanted(*bounds, same, k)
        walk(centre, angles[norms > 0].max(initial=0), members, shard, wanted)
        who, wish, place = np.nonzero(np.isfinite(wanted.score))
        return pa.RecordBatch.from_pydict({
            "anchor_id": pa.array(members["ids"][who]), "wish": pa.array(wish.astype("i4")),
            "vec_id": pa.array(wanted.id[who, wish, place]),
            "score": pa.array(wanted.score[who, wish, place].astype("i8")),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard_no, shard = None, [], None, None

        def done():
            nonlocal shard_no, shard
            number, kind, cluster = at
            if kind == 0:
                shard_no, shard = number, part_of(held)
            elif shard_no == number:
                yield of_cluster(cluster, part_of(held), shard)

        for key, part in runs(batches, ["shard", "kind", "cluster"]):
            if key != at:
                if held:
                    yield from done()
                at, held = key, []
            held.append(part)
        if held:
            yield from done()

    return run


class _Index:
    """Anchors in clusters and candidates in shards, with the cones of both."""

    def __init__(self, rows: DataFrame, anchors: DataFrame):
        spark = ready(rows.sparkSession)
        dims = max(width_of(rows), 1)
        sample = anchors.orderBy(F.xxhash64("id")).limit(SAMPLE_ANCHORS).select("vector").collect()
        vectors = np.zeros((len(sample), dims))
        for i, r in enumerate(sample):
            vectors[i, :len(r["vector"])] = r["vector"]
        self.centres = fit_centres(vectors)
        self.anchors = stored(_indexed(anchors, self.centres, CLUSTER_ANCHORS, "cluster"), "anchors")
        self.shards = stored(_indexed(rows, self.centres, SHARD_ROWS, "shard"), "shards")
        cosine = np.clip(self.centres @ self.centres.T, -1, 1)
        # Angles between all centres: at most CENTRES squared numbers.
        self.between = spark.createDataFrame(
            [(a, b, float(np.arccos(cosine[a, b]))) for a in range(len(cosine)) for b in range(len(cosine))],
            "cell int, other int, apart double",
        )
        self.cones = stored(_cones(self.shards, "shard"), "cones").withColumnsRenamed(
            {"cell": "other", "radius": "other_radius", "norm": "other_norm"})

    def units(self, wishes: DataFrame, where: Column) -> DataFrame:
        """Clusters and the shards that can reach what a member needs.

        ``wishes``: id, cluster, low, high (arrays of one bound per wish).
        """
        lowest = wishes.select("cluster", "id", F.array_min("low").alias("low"))
        cones = _cones(self.anchors, "cluster").join(lowest.groupBy("cluster").agg(F.min("low").alias("low")), "cluster")
        angle = F.greatest(F.lit(0.0), F.col("apart") - F.col("radius") - F.col("other_radius") - F.lit(1e-6))
        reach = F.col("norm") * F.col("other_norm") * F.greatest(F.lit(0.0), F.cos(angle))
        # By way of the cells: each cell knows its shards, each cluster its cell.
        return cones.join(F.broadcast(self.between), "cell").join(self.cones, "other").filter(
            where & (reach * (1 + SLACK) + 1 >= F.col("low"))).select("cluster", "shard")

    def search(self, wishes: DataFrame, where: Column, same: bool, k: int) -> DataFrame:
        """The k best of each wish of every anchor in the units: anchor_id, wish, vec_id, score."""
        empty = F.array().cast("array<double>")
        units = self.units(wishes, where)
        members = self.anchors.select("id", "label", "vector", "cluster").join(
            wishes.select("id", "low", "high"), "id").join(units, "cluster")
        opened = units.select("shard").distinct()
        rows = self.shards.join(opened, "shard").select(
            "shard", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("cluster"), "id", "label", "vector",
            empty.alias("low"), empty.alias("high"))
        met = rows.unionByName(members.withColumn("kind", F.lit(1)))
        walked = met.repartition("shard").sortWithinPartitions("shard", "kind", "cluster")
        return walked.mapInArrow(
            _walking(self.centres, same, k), "anchor_id bigint, wish int, vec_id bigint, score bigint")


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    by_rank = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """Hard negatives of anchors: rows of another label that score almost as a positive does.

    Both inputs: (vec_id long, label, vector array of whole numbers). The score
    is the inner product; more comes first, then the smaller id. The positives
    of an anchor are its best rows of the same label. For each, the best rows
    of other labels count whose score lies between ``low`` and ``high`` percent
    of the positive's.

    Rows without id, label or vector take no part; vectors are finite. Rows
    under the anchor's own id are no partner of it; otherwise repeated rows
    count each. Of anchors under one id the first by label and components is
    taken. Vectors of different length end in zeros. Scores are exact below
    2^53. Empty input, and anchors without a positive or a negative, give no
    row. Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.
    """
    ready(rows.sparkSession)
    pick = lambda df: df.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.col("vector").cast("array<double>").alias("vector")).dropna()
    own = pick(anchors).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select("id", "a.*")
    index = _Index(pick(rows), own)
    infinite = lambda sign: F.array(F.lit(f"{sign}Infinity").cast("double"))
    keyed = index.anchors.select("id", "cluster")
    every = keyed.withColumns({"low": infinite("-"), "high": infinite("")})
    near = F.col("cell") == F.col("other")
    first = stored(_best(index.search(every, near, True, positives), ["anchor_id"], positives), "own-cone")
    fifth = first.filter(F.col("rank") == positives).select(F.col("anchor_id").alias("id"), F.col("score").alias("least"))
    needs = keyed.join(fifth, "id", "left").withColumns({
        "low": F.array(F.coalesce(F.col("least").cast("double"), F.lit("-Infinity").cast("double"))), "high": infinite("")})
    more = index.search(needs.drop("least"), ~near, True, positives)
    chosen = stored(
        _best(first.drop("rank").unionByName(more), ["anchor_id"], positives).select(
            "anchor_id", (F.col("rank") - 1).alias("wish"), F.col("vec_id").alias("positive_id"),
            F.col("score").alias("positive_score")), "positives")
    # Arrays of at most ``positives`` numbers. A negative positive has no room below itself.
    room = chosen.filter(F.col("positive_score") >= 0).groupBy(F.col("anchor_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("wish", "positive_score"))).alias("p"))
    share = lambda percent: F.transform(
        "p", lambda x: x["positive_score"].cast("double") * percent / 100)
    bounds = keyed.join(room, "id").withColumns({"low": share(low), "high": share(high)}).drop("p")
    found = _best(index.search(bounds, F.lit(True), False, negatives), ["anchor_id", "wish"], negatives)
    return found.join(chosen, ["anchor_id", "wish"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors are the embeddings of ids divisible by 100; labels of ids divisible by 7 move on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")))
    rows = kept.select("vec_id", label.alias("label"), scaled(F.col("embedding"), 256).alias("vector"))
    return mine(rows, rows.filter(F.col("vec_id") % 100 == 0))


ORACLE = {
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.vector, c.vector) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score,
  score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
}
QUERIES = {"op12_hard_negatives": op12_hard_negatives}
