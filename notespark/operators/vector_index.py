"""Nearest vectors through inverted lists of a learned coarse quantiser.

``build`` fits centroids by k-means on a sample (``sample`` rows at most, those of least key hash), puts
every row into the list of its nearest centroid, and writes the rows in folders by list, with the size and
the radius of each list.  A search reads the lists whose centroids are nearest to the query and scores
their rows exactly.

Vectors are compared at length one, where cosine and distance order alike.  By the triangle inequality
nothing in a list is nearer than the distance to its centroid less its radius, so with ``exact`` the search
goes on with all lists that may still hold one of the best n, and gives the pages of a full scan.

The centroids, ``MOST_LISTS`` at most, are held by the driver and sent to tasks.  Rows without a vector, with
a null component or of length zero have no direction; they are kept in list -1, which no search reads.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.operators.vectors import _dot, nearest
from notespark.scale import top_per_key
from notespark.session import cut_lineage

MOST_LISTS = 16_384
SAMPLE = 65_536
ROUNDS = 10
NPROBE = 8
NOWHERE = -1
PART = 8_192
CHUNK = 8_192
PIECE = 512
DIGITS = 6
SLACK = 1e-7


def _units(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length one, and which rows have a direction."""
    good = np.array([v is not None and len(v) > 0 and np.isfinite(np.asarray(v, float)).all() and np.any(v) for v in column], bool)
    rows = np.array([np.asarray(v, float) for v in column[good]])
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True) if len(rows) else rows), good


def _distances(units: np.ndarray, centers: np.ndarray) -> np.ndarray:
    squares = (units ** 2).sum(1)[:, None] + (centers ** 2).sum(1)[None] - 2 * units @ centers.T
    return np.sqrt(np.maximum(squares, 0))


def _unit(vector: str):
    v = F.col(vector).cast("array<double>")
    return F.when(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), v)


def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", lists: int | None = None,
          sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 7) -> None:
    """Write ``rows`` in folders by list, and ``lists`` with center, radius and size."""
    spark = vectors.sparkSession
    n = vectors.count()
    lists = lists or min(max(round(n ** 0.5), 1), MOST_LISTS)
    usable = vectors.select(key, _unit(vector).alias("v")).where("size(v) > 0").withColumn("_norm", F.sqrt(_dot(F.col("v"), F.col("v")))).where(
        "_norm > 0")
    drawn = usable.orderBy(F.xxhash64(key), key).limit(sample).select(
        array_to_vector(F.transform("v", lambda x: x / F.col("_norm"))).alias("features"))
    drawn = cut_lineage(drawn)
    centers = np.zeros((0, 0))
    if not drawn.isEmpty():
        centers = np.array(KMeans(k=lists, seed=seed, maxIter=rounds).fit(drawn).clusterCenters()) if drawn.count() > 1 else np.array(
            [drawn.first()["features"].toArray()])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            units, good = _units(frame["_v"])
            at, far = np.full(len(frame), NOWHERE), np.zeros(len(frame))
            if len(units):
                apart = _distances(units, centers)
                at[good], far[good] = apart.argmin(1), apart.min(1)
            yield frame.drop(columns="_v").assign(_list=at, _far=far)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    placed = vectors.withColumn("_v", F.col(vector).cast("array<double>")).mapInPandas(place, f"{schema}, _list int, _far double")
    if not n:  # no folder would hold the columns
        vectors.withColumn("_far", F.lit(0.0)).coalesce(1).write.mode("overwrite").parquet(f"{path}/rows/_list={NOWHERE}")
    placed.hint("rebalance", "_list").write.mode("append" if not n else "overwrite").partitionBy("_list").parquet(f"{path}/rows")
    known = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "_list int, center array<double>")
    stored = spark.read.schema(f"{schema}, _far double, _list int").parquet(f"{path}/rows")
    sizes = stored.groupBy("_list").agg(F.max("_far").alias("radius"), F.count("*").alias("size"))
    sizes.join(known, "_list", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")  # a row per list


def _lists(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = spark.read.parquet(f"{path}/lists").where(F.col("_list") != NOWHERE).orderBy("_list").collect()  # MOST_LISTS at most
    return (np.array([r["_list"] for r in rows], int), np.array([r["center"] for r in rows]), np.array([r["radius"] for r in rows]))


def _parts(spark: SparkSession, path: str, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First part and number of parts of each list; small lists share a part, a large one has several."""
    sizes = {r["_list"]: r["size"] for r in spark.read.parquet(f"{path}/lists").select("_list", "size").collect()}  # MOST_LISTS at most
    first, count, part, held = [], [], 0, 0
    for name in names:
        size = sizes[name]
        if held and held + size > PART:
            part, held = part + 1, 0
        first.append(part)
        count.append(max(1, -(-size // PART)))
        held += size
        if count[-1] > 1:
            part, held = part + count[-1], 0
    return np.array(first, int), np.array(count, int)


def rows_of(spark: SparkSession, path: str, chosen: Sequence[int]) -> DataFrame:
    """The rows of some lists; other folders are not read."""
    return spark.read.parquet(f"{path}/rows").where(F.col("_list").isin([int(k) for k in chosen])).drop("_far", "_list")


def search(spark: SparkSession, path: str, query: Sequence[float], n: int = 10, key: str = "vec_id", vector: str = "embedding",
           nprobe: int | None = NPROBE, exact: bool = False) -> DataFrame:
    """The ``n`` rows most similar to ``query`` of the ``nprobe`` nearest lists, all lists with None."""
    names, centers, radius = _lists(spark, path)
    if not len(names):
        return nearest(rows_of(spark, path, []), query, n, key, vector)
    unit = np.asarray(query, float) / np.linalg.norm(query)
    apart = _distances(unit[None], centers)[0]
    chosen = names[np.argsort(apart, kind="stable")][:nprobe]
    if exact and nprobe is not None:
        best = nearest(rows_of(spark, path, chosen), query, n, key, vector, digits=None).agg(
            F.min("score").alias("least"), F.count("*").alias("found")).first()
        worst = np.sqrt(max(2 - 2 * best["least"], 0)) if best["found"] == n else np.inf
        chosen = names[apart - radius <= worst + SLACK]
    return nearest(rows_of(spark, path, chosen), query, n, key, vector)


def search_many(spark: SparkSession, path: str, queries: DataFrame, n: int = 10, key: str = "vec_id", vector: str = "embedding",
                nprobe: int = NPROBE, exact: bool = False) -> DataFrame:
    """Best ``n`` rows for each of many queries ``query_id, vector``: ``query_id, rank, key, score``.

    Lists are gathered into parts of about ``PART`` rows and queries into chunks of about ``CHUNK``; a part meets
    a chunk in one task as two matrices, and only the best ``n`` of each query leave it, so no row is made per
    query and vector.  Ties go by key after rounding to ``DIGITS``.
    """
    names, centers, radius = _lists(spark, path)
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString()}
    stored = spark.read.parquet(f"{path}/rows")
    kinds[key] = stored.schema[key].dataType.simpleString()
    first_part, parts = _parts(spark, path, names)
    chunks = max(1, -(-queries.count() // CHUNK))

    def probes(beyond: bool):
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in frames:
                for start in range(0, len(whole), PIECE):
                    frame = whole[start:start + PIECE]
                    units, good = _units(frame["vector"])
                    if not len(units) or not len(names):
                        continue
                    asked = frame[good]
                    apart = _distances(units, centers)
                    near = np.zeros(apart.shape, bool)
                    np.put_along_axis(near, np.argsort(apart, axis=1, kind="stable")[:, :nprobe], True, axis=1)
                    if beyond:
                        near = ~near & (apart - radius <= asked["worst"].to_numpy()[:, None] + SLACK)
                    out: list[tuple] = []
                    for row, query in enumerate(asked["query_id"]):
                        lists: dict[int, list[int]] = {}
                        for k in np.nonzero(near[row])[0]:
                            for part in range(first_part[k], first_part[k] + parts[k]):
                                lists.setdefault(part, []).append(int(names[k]))
                        out += [(query, part, units[row], chosen) for part, chosen in lists.items()]
                    yield pd.DataFrame(out, columns=["query_id", "_part", "_q", "_lists"])

        return work

    def best(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": asked["query_id"][:0], key: rows[key][:0], "score": np.zeros(0)})]
        if len(asked) and len(rows):
            vectors = np.stack(rows["_v"].to_numpy())
            vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            held, at = np.unique(rows["_list"].to_numpy(), return_inverse=True)
            for start in range(0, len(asked), PIECE):
                piece = asked[start:start + PIECE]
                reach = np.array([np.isin(held, chosen) for chosen in piece["_lists"]])
                scores = np.round(np.stack(piece["_q"].to_numpy()) @ vectors.T, DIGITS)
                scores[~reach[:, at]] = -np.inf
                m = min(n, scores.shape[1])
                least = np.partition(scores, scores.shape[1] - m, axis=1)[:, scores.shape[1] - m]
                row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                page = pd.DataFrame({"query_id": piece["query_id"].to_numpy()[row], key: rows[key].to_numpy()[column], "score": scores[row, column]})
                page = page.sort_values(["query_id", "score", key], ascending=[True, False, True])
                found.append(page[page.groupby("query_id").cumcount() < n])
        return pd.concat(found) if len(found) > 1 else found[0]

    where = spark.createDataFrame([(int(k), int(b), int(c)) for k, b, c in zip(names, first_part, parts)], "_list int, _first int, _count int")
    dealt = stored.join(F.broadcast(where), "_list").select(
        key, "_list", F.col(vector).cast("array<double>").alias("_v"),
        (F.col("_first") + F.pmod(F.xxhash64(key), F.col("_count"))).cast("int").alias("_part"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk")) if len(names) else None

    def scored(asked: DataFrame, beyond: bool) -> DataFrame:
        if dealt is None:
            return spark.createDataFrame([], f"query_id {kinds['query_id']}, `{key}` {kinds[key]}, score double")
        sent = asked.mapInPandas(probes(beyond), f"query_id {kinds['query_id']}, _part int, _q array<double>, _lists array<int>").withColumn(
            "_chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
        met = sent.groupBy("_part", "_chunk").cogroup(dealt.groupBy("_part", "_chunk"))
        return met.applyInPandas(best, f"query_id {kinds['query_id']}, `{key}` {kinds[key]}, score double")

    order = [F.desc("score"), F.col(key)]
    first = cut_lineage(top_per_key(scored(queries.select("query_id", "vector"), False), ["query_id"], order, n).drop("rank"))
    if not exact:
        return top_per_key(first, ["query_id"], order, n)
    worst = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("least")).where(F.col("found") == n)
    far = F.when(F.col("least").isNull(), F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(2 - 2 * F.col("least"), F.lit(0.0)) + 2 * 10.0 ** -DIGITS))
    asked = queries.join(worst, "query_id", "left").select("query_id", "vector", far.alias("worst"))
    return top_per_key(first.unionByName(scored(asked, True)), ["query_id"], order, n)
