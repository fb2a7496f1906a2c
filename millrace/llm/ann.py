"""Approximate nearest neighbours by an adaptive scan of dimensions.

Vectors are scaled to length one and rotated at random, so that the first dimensions of any
vector are a fair sample of all.  k-means centroids, fitted on the SAMPLE vectors of
smallest hashed id, cut them into lists; every vector is indexed.  How many of the nearest
lists a query probes is measured on the table: for TRIALS of its queries the nearest of all
vectors are found by brute force, and so many lists are probed as hold the share WITHIN of
those, FEWEST at least.  Within a list vectors lie in blocks of columns; after each few columns the
squared distance so far, scaled up to all columns, is tested against the distance of the
best so far, and a vector abandons the scan once it is farther with a confidence set by EPSILON.
A block waits in its task for the queries that probe it, which pass by in batches.  What survives all columns gets its exact cosine in double precision from the original
vectors.  Lists are probed until k candidates are found, all lists if need be.

Equal vectors are one point: only the K + 1 smallest ids of each are indexed, as no more can
be among a query's nearest, and equal queries are searched once.  A list larger than
BLOCK_ROWS is dealt to several blocks by hash, so a frequent region is searched by many tasks.
Vectors that are null, of another length than most, zero, or with null or non-finite
components take no part, as query or candidate.  Ids may repeat; each row is a candidate.
Columns besides the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import giving_back, release, small_batches, stored

SAMPLE = 20_000
ROWS_IN_LIST = 400
MOST_LISTS = 4_096
TRIALS = 256
WITHIN = 0.98
FEWEST = 8
BLOCK_ROWS = 8_192
STEP = 16
EPSILON = 2.1
SEED = 5


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very large or small components square safely
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(points: np.ndarray, lists: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(lists, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(points[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(points), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        length = np.linalg.norm(total, axis=1)
        keep = length > 0
        centres[keep] = total[keep] / length[keep, None]
    return centres


def scan(queries: np.ndarray, block: np.ndarray, k: int, step: int = STEP, epsilon: float = EPSILON) -> list[np.ndarray]:
    """For each unit query the rows of the block (columns by rows) that survive all tests."""
    dims, rows = block.shape
    out = []
    for q in queries:
        alive, left = np.zeros(rows), np.arange(rows)
        # the first rows, in full, give a distance to test against
        head = min(rows, 4 * k)
        first = ((block[:, :head] - q[:, None]) ** 2).sum(axis=0)
        bar = np.partition(first, k - 1)[k - 1] if head >= k else np.inf
        for a in range(0, dims, step):
            b = min(dims, a + step)
            alive = alive + ((block[a:b][:, left] - q[a:b, None]) ** 2).sum(axis=0)
            if b < dims:
                keep = alive * (dims / b) <= bar * (1 + epsilon / np.sqrt(b)) ** 2 + 1e-12
                alive, left = alive[keep], left[keep]
        if len(left) > k:
            bar = np.partition(alive, k - 1)[k - 1]
            left = left[alive <= bar * (1 + 1e-9) + 1e-12]
        out.append(left)
    return out


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision and in one order of summation.

    Where squares leave the range of doubles, both are scaled by powers of two first, which
    changes no digit.
    """
    with np.errstate(over="ignore", invalid="ignore", divide="ignore", under="ignore"):
        out = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    top = [np.abs(z).max(axis=1, initial=0) for z in (x, y)]
    far = np.flatnonzero((np.maximum(*top) > 1e70) | (np.minimum(*top) < 1e-70))
    if len(far):
        x, y = (np.ldexp(z[far], -np.frexp(t[far])[1][:, None]) for z, t in zip((x, y), top, strict=True))
        out[far] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    return out


def probes_for(placed: DataFrame, k: int, dims: int, centres: np.ndarray, turn: np.ndarray, within: float) -> int:
    """How many lists, nearest first, hold the share `within` of the k nearest vectors of TRIALS queries."""
    lists = len(centres)
    if within >= 1:
        return lists
    tried = placed.where("query").orderBy(F.xxhash64(F.lit(SEED + 1), "id"), "id").limit(TRIALS).select("v").toPandas()
    if lists <= FEWEST or not len(tried):
        return lists
    asked = unit(np.array(tried["v"].tolist())) @ turn
    model = placed.sparkSession.sparkContext.broadcast((turn, asked))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, asked = model.value
        score, where = np.full((len(asked), k + 1), -2.0), np.full((len(asked), k + 1), -1)
        for batch in batches:
            if batch.num_rows:
                held = unit(batch.column(0).flatten().to_numpy().reshape(-1, dims)) @ turn
                score = np.concatenate([score, asked @ held.T], axis=1)
                where = np.concatenate([where, np.broadcast_to(batch.column(1).to_numpy(), (len(asked), len(held)))], axis=1)
                top = np.argpartition(-score, k, axis=1)[:, : k + 1]
                score, where = np.take_along_axis(score, top, 1), np.take_along_axis(where, top, 1)
        row = np.repeat(np.arange(len(asked)), k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(score.ravel()), pa.array(where.ravel())], names=["row", "score", "list"])

    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "list"))
    found = placed.select("v", "list").mapInArrow(giving_back(best), "row long, score double, list long").where("list >= 0").withColumn("place", place)
    # the first is the query itself
    found = found.where(F.col("place").between(2, k + 1)).select("row", "list").toPandas()
    if not len(found):
        return lists
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(rank[found["row"].to_numpy(), found["list"].to_numpy()]) + 1
    return min(lists, max(FEWEST, int(needed[int(np.ceil(within * len(needed))) - 1])))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", within: float = WITHIN) -> DataFrame:
    """query_id, rank, key, score: the k nearest rows found for each query row but itself."""
    spark = vectors.sparkSession
    small_batches(spark)
    schema = f"query_id long, rank int, {key} long, score double"
    common_size = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common_size is None or common_size.dims == 0:
        return spark.createDataFrame([], schema)
    dims = common_size.dims
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks")).where(usable(F.col("v"), dims) & F.col("id").isNotNull())
    # -0.0 and 0.0 are one value
    point = F.sha2(F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ",").cast("binary"), 256)
    rows = stored(rows.withColumn("point", F.substring(point, 1, 32)))
    place = F.row_number().over(Window.partitionBy("point").orderBy("id"))
    kept = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    asked = stored(rows.where("asks").select("id", "point"))
    heads = stored(kept.join(asked.select("point", F.lit(True).alias("wanted")).distinct(), "point", "left").select("id", "v", "point", (F.coalesce("wanted", F.lit(False)) & (F.col("place") == 1)).alias("query")))
    n = heads.count()
    if not n:
        return spark.createDataFrame([], schema)
    lists = max(1, min(MOST_LISTS, n // ROWS_IN_LIST))
    sample = heads.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(SAMPLE).select("v").toPandas()
    turn = rotation(dims)
    centres = kmeans(unit(np.array(sample["v"].tolist())) @ turn, lists)
    lists = len(centres)
    model = spark.sparkContext.broadcast((turn, centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centres = model.value
        for batch in batches:
            if batch.num_rows:
                turned = unit(batch.column(1).flatten().to_numpy().reshape(-1, dims)) @ turn
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.argmax(turned @ centres.T, axis=1).astype(np.int32))], names=["id", "v", "point", "query", "list"])

    placed = stored(heads.mapInArrow(giving_back(assign), "id long, v array<double>, point string, query boolean, list int"))
    probes = probes_for(placed, k, dims, centres, turn, within)
    sizes = {r.list: r["count"] for r in placed.groupBy("list").count().collect()}
    blocks = np.array([-(-sizes.get(x, 0) // BLOCK_ROWS) for x in range(lists)], np.int32)
    index = placed.select("list", F.pmod(F.xxhash64("id", "point"), F.greatest(F.get(F.lit(blocks), "list"), F.lit(1)).cast("long")).cast("int").alias("block"), "id", "v", "point")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centres = model.value
        size = np.array([sizes.get(x, 0) for x in range(len(centres))])
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = unit(batch.column(1).flatten().to_numpy().reshape(-1, dims)) @ turn
            order = np.argsort(-(turned @ centres.T), axis=1, kind="stable")
            row, found = [], []
            for j in range(batch.num_rows):
                enough = int(np.searchsorted(np.cumsum(size[order[j]]), k + 1)) + 1
                for x in order[j][: max(probes, enough)]:
                    for b in range(blocks[x]):
                        row.append(j)
                        found.append((x, b))
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), taken.column(1), taken.column(2)], names=["list", "block", "v", "point"])

    probing = placed.where("query").select("id", "v", "point").mapInArrow(giving_back(probe), "list int, block int, v array<double>, point string")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _ = model.value
        flat = lambda column: column.flatten().to_numpy().reshape(-1, dims)

        def answers(points: list[str], asked: np.ndarray) -> Iterator[pa.RecordBatch]:
            out: tuple[list, list, list] = ([], [], [])
            for point, q, alive in zip(points, asked, scan(unit(asked) @ turn, block, k + 1, epsilon=np.inf if within >= 1 else EPSILON), strict=True):
                score = cosine(exact[alive], np.broadcast_to(q, (len(alive), dims)))
                best = np.lexsort((ids[alive], -score))[: k + 1]
                for column, x in zip(out, ([point] * len(best), ids[alive][best].tolist(), score[best].tolist()), strict=True):
                    column += x
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["point", "id", "score"])

        # a block's own rows come first
        at, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {name: batch.column(j) for j, name in enumerate(batch.schema.names)}
            place = column["list"].to_numpy().astype(np.int64) << 33 | column["block"].to_numpy().astype(np.int64) << 1 | column["asks"].to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            for lo, hi in zip(cut, np.append(cut[1:], len(place)), strict=True):
                if place[lo] >> 1 != at:
                    at, held, block = place[lo] >> 1, [], None
                here = batch.slice(lo, hi - lo)
                if not place[lo] & 1:
                    held.append((here.column(3).to_numpy(), flat(here.column(4))))
                elif held:
                    if block is None:
                        ids, exact = (np.concatenate([x[j] for x in held]) for j in (0, 1))
                        order = np.argsort(ids, kind="stable")
                        ids, exact = ids[order], exact[order]
                        block = np.ascontiguousarray((unit(exact) @ turn).T)
                    yield from answers(here.column(5).to_pylist(), flat(here.column(4)))

    both = index.select("list", "block", F.lit(0).alias("asks"), "id", "v", "point").unionByName(probing.select("list", "block", F.lit(1).alias("asks"), F.lit(0).cast("long").alias("id"), "v", "point"))
    found = both.repartition("list", "block").sortWithinPartitions("list", "block", "asks").mapInArrow(giving_back(search), "point string, id long, score double")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("point").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)
    release(spark)
    met = asked.withColumnRenamed("id", "query_id").join(best.select("point", "id", "score"), "point")
    # a query's own row is left out once
    me = F.row_number().over(Window.partitionBy("query_id", "point", "id").orderBy(F.desc("score")))
    others = met.withColumn("copy", me).where((F.col("id") != F.col("query_id")) | (F.col("copy") > 1))
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
