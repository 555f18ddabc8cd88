"""Approximate nearest neighbours by inner product: inverted lists scanned with adaptive dimensions.

Spherical k-means on a bounded sample (``SAMPLE``) gives the lists' centres; every vector goes into the list of its nearest centre.  A
query probes the lists that look best by centre and largest norm.  How many is measured on each table: ``TRIED`` queries
are compared with every vector, and so many lists are probed that a share ``RECALL`` of their true neighbours is in them,
``probes_of`` at least.  Within a list, vectors and
queries are rotated by one random rotation and compared a block of columns at a time.  After d of D columns their
squared distance so far times D / d estimates the whole one within a factor of (1 + EPSILON / sqrt(d))^2, and a candidate is
abandoned if even the lower end is farther than the k-th best known row of the list (a distance and an inner product
follow from each other by the norms).  While many candidates are left, a block of columns is one product of matrices for all of them; few
are followed pair by pair.  What survives and is no farther than the k-th best of the list, and of those rows of the sample that lie in
probed lists, is measured exactly on the original vectors.

Lists are cut into blocks of rows and their queries into chunks, so a large list is many groups.  Equal vectors are searched
once, and of equal candidates only the k + 1 with the smallest ids can be among the k nearest of a query,
so only these are listed.

Null, empty, zero vectors, those with null or non-finite entries or another length than most of the sample, and
rows with null ids take no part; a query has fewer than k neighbours only if there are fewer vectors; ties go to the smaller id;
ids are expected to be unique, rows with equal ids are found as often as they appear but never by each other; an
empty table gives an empty result.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlines.llm import common

K = 20
SAMPLE = 20_000
MOST_LISTS = 4096
#: Queries that are compared with every vector, and the share of their neighbours that the probed lists have to hold.
TRIED = 256
RECALL = 0.95
#: Of n lists so many are probed at least: FACTOR * n ** POWER.
FACTOR = 1.9
POWER = 0.765
BLOCK_ROWS = 4096
CHUNK_QUERIES = 2048
COLUMNS = 16
#: Deviations of the test, in its usual unit of 1 / sqrt(columns seen).
EPSILON = 1.5
ITERATIONS = 8
#: Bytes of sample rows that give each query a score which its neighbours reach.
FLOOR_BYTES = 4 << 20
#: Candidates are followed pair by pair once no larger share of them is left.
FEW = 1 / 16
#: What a product may be off by, as a share of the vectors' lengths.
ROUNDING = 1e-9


def probes_of(lists: int, factor: float = FACTOR) -> int:
    return min(lists, int(np.ceil(factor * lists ** POWER)))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample."""
    points = unit(sample)
    found = points[np.linspace(0, len(points) - 1, min(lists, len(points))).astype(int)]
    for _ in range(ITERATIONS):
        nearest = np.concatenate([(points[a:a + 2048] @ found.T).argmax(axis=1) for a in range(0, len(points), 2048)])
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, points)
        found = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, unit(sums), found)
    return found


def matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def rotation(width: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(5).normal(size=(width, width)))[0]


def survivors(q: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of rotated vectors that were not abandoned; all rows if there are no more than k.

    Where whole products were worked out for all pairs, those are left that may be among a query's k best and reach its ``floor``.
    Pairs followed by themselves need not reach it: one that gave the floor may have been abandoned.
    """
    width = x.shape[1]
    if len(x) <= k:
        return np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))
    q_part, x_part = np.cumsum(q ** 2, axis=1), np.cumsum(x ** 2, axis=1)  # squared norms of the first columns
    slack = ROUNDING * np.sqrt(q_part[:, -1] * x_part[:, -1].max())
    at = min(COLUMNS, width)
    product, alive = q[:, :at] @ x[:, :at].T, np.ones((len(q), len(x)), bool)
    first = np.argpartition(-product, k - 1, axis=1)[:, :k]
    known = np.einsum("qd,qkd->qk", q, x[first]).min(axis=1) - slack  # k rows are at least that near
    while at < width and alive.mean() > FEW:
        # apart * (width / at) <= (1 + EPSILON / sqrt(at)) ** 2 * most, solved for the product so far
        share = (1 + EPSILON / np.sqrt(at)) ** 2 * at / width
        alive &= product >= ((q_part[:, at - 1] - share * (q_part[:, -1] - 2 * known))[:, None]
                             + (x_part[:, at - 1] - share * x_part[:, -1])) / 2
        to = min(at + COLUMNS, width)
        product += q[:, at:to] @ x[:, at:to].T
        at = to
    if at == width:
        best = np.partition(product, len(x) - k, axis=1)[:, len(x) - k]
        return np.nonzero(product >= (np.maximum(floor, best) - slack)[:, None])
    left, right = np.nonzero(alive)
    so_far = product[left, right]
    while at < width:
        apart = q_part[left, at - 1] + x_part[right, at - 1] - 2 * so_far
        most = q_part[left, -1] + x_part[right, -1] - 2 * known[left]
        near = apart * (width / at) <= (1 + EPSILON / np.sqrt(at)) ** 2 * most
        left, right, so_far = left[near], right[near], so_far[near]
        to = min(at + COLUMNS, width)
        so_far = so_far + np.einsum("ij,ij->i", q[left, at:to], x[right, at:to])
        at = to
    near = so_far >= known[left]
    return left[near], right[near]


def _compare(width: int, k: int, tried: np.ndarray, ids: np.ndarray):
    """The k best other rows of a task for each tried query, and the lists they are in."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, lists = np.empty((len(tried), 0)), np.empty((len(tried), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                product = tried @ matrix(some.column(1), width).T
                product[ids[:, None] == some.column(0).to_numpy()] = -np.inf
                score = np.concatenate([score, product], axis=1)
                lists = np.concatenate([lists, np.broadcast_to(some.column(2).to_numpy(), product.shape)], axis=1)
                if score.shape[1] > k:
                    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, lists = np.take_along_axis(score, best, axis=1), np.take_along_axis(lists, best, axis=1)
        query, place = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int32()), pa.array(score[query, place]), pa.array(lists[query, place], pa.int32())],
            ["query", "score", "list"])

    return compare


def _probes(placed: DataFrame, asked: DataFrame, looks, width: int, k: int, recall: float) -> int:
    """How many of the best looking lists hold the share ``recall`` of the true neighbours of the tried queries."""
    tried = asked.orderBy(F.xxhash64("key", F.lit(3)), "key").limit(TRIED).collect()
    if not tried:
        return 1
    x, ids = np.array([r["vector"] for r in tried]), np.array([r["vec_id"] for r in tried])
    best = Window.partitionBy("query").orderBy(F.desc("score"), "list")
    near = placed.select("vec_id", "vector", "list").mapInArrow(
        _compare(width, k, x, ids), "query int, score double, list int").withColumn(
        "place", F.row_number().over(best)).where(F.col("place") <= k).select("query", "list").toPandas()
    if near.empty:
        return 1
    order = np.argsort(-looks(x), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(rank[near["query"].to_numpy(), near["list"].to_numpy()]) + 1
    return int(needed[int(np.ceil(recall * len(needed))) - 1])


def _scan(width: int, k: int):
    turn = rotation(width)

    def scan(rows: pa.Table, queries: pa.Table) -> pa.Table:
        x, ids = matrix(rows["vector"], width), rows["vec_id"].to_numpy()
        q_all, floor = matrix(queries["vector"], width), queries["floor"].to_numpy()
        x_turned, q_turned = x @ turn, q_all @ turn
        out_query, out_id, out_score = [np.empty(0, np.int64)], [ids[:0]], [np.empty(0)]
        for begin in range(0, len(q_all) if len(x) else 0, 256):
            some = slice(begin, begin + 256)
            left, right = survivors(q_turned[some], x_turned, k, floor[some])
            exact = (q_all[some][left] * x[right]).sum(axis=1)
            order = np.lexsort((ids[right], -exact, left))
            left, right, exact = left[order], right[order], exact[order]
            rank = np.arange(len(left)) - np.searchsorted(left, left)
            kept = rank < k
            out_query.append(begin + left[kept])
            out_id.append(ids[right[kept]])
            out_score.append(exact[kept])
        return pa.table({
            "key": queries["key"].combine_chunks().take(pa.array(np.concatenate(out_query))),
            "vec_id": pa.array(np.concatenate(out_id), pa.int64()), "score": pa.array(np.concatenate(out_score), pa.float64())})

    return scan


def floors(q: np.ndarray, probed: np.ndarray, known: np.ndarray, known_list: np.ndarray, n_lists: int, k: int) -> np.ndarray:
    """For each query the k-th best score of the known rows in its probed lists, less what it may be off by; no score if they are fewer."""
    if len(known) < k:
        return np.full(len(q), -np.inf)
    open_ = np.zeros((len(q), n_lists), bool)
    np.put_along_axis(open_, probed, True, axis=1)
    score = np.where(open_[:, known_list], q @ known.T, -np.inf)
    slack = ROUNDING * np.linalg.norm(q, axis=1) * np.linalg.norm(known, axis=1).max()
    return np.partition(score, len(known) - k, axis=1)[:, len(known) - k] - slack


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
            k: int = K, factor: float = FACTOR, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` holds for, its k nearest other rows."""
    spark = vectors.sparkSession
    vector = F.col("vector")
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
                           F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = named.where(F.col("vec_id").isNotNull() & usable(vector)).withColumn(
        "key", F.concat_ws(":", F.xxhash64(F.lit(1), vector), F.xxhash64(F.lit(2), vector)))
    equal = Window.partitionBy("key").orderBy("vec_id")
    listed = common.table(rows.select("vec_id", "vector", "key", F.row_number().over(equal).alias("copy"))
                          .where(F.col("copy") <= k + 1).drop("copy"))
    n = listed.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    draw = F.pmod(F.xxhash64("key", "vec_id"), F.lit(1 << 30)) / (1 << 30)
    sample = [r["vector"] for r in listed.where(draw < SAMPLE / n * 1.1 + 1e-6).select("vector", draw.alias("draw"))
              .orderBy("draw").limit(SAMPLE).collect()] or [listed.first()["vector"]]
    width = Counter(map(len, sample)).most_common(1)[0][0]
    points = np.array([v for v in sample if len(v) == width])
    middle = centres(points, max(1, min(MOST_LISTS, round(n ** 0.5))))
    points = points[:max(1, FLOOR_BYTES // (8 * width))]
    points_list = np.concatenate([(points[a:a + 2048] @ middle.T).argmax(axis=1) for a in range(0, len(points), 2048)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            lists = (x @ middle.T).argmax(axis=1) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.int32()), pa.array(np.linalg.norm(x, axis=1), pa.float64())],
                ["vec_id", "vector", "list", "norm"])

    right = F.size("vector") == width
    placed = common.table(listed.where(right).select("vec_id", "vector").mapInArrow(
        assign, "vec_id long, vector array<double>, list int, norm double"))
    asked = common.table(rows.where(F.col("is_query") & right).groupBy("key").agg(
        F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("vec_id")))
    of_list = {r["list"]: r for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect()}
    norms = np.array([of_list[i]["norm"] if i in of_list else 0.0 for i in range(len(middle))])
    looks = lambda x: x @ middle.T * norms
    n_probes = max(probes_of(len(middle), factor), _probes(placed, asked, looks, width, k, recall))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                x = matrix(some.column(1), width)
                lists = np.argsort(-looks(x), axis=1, kind="stable")[:, :n_probes]
                floor = floors(x, lists, points, points_list, len(middle), k + 1)
                again = pa.array(np.repeat(np.arange(some.num_rows), n_probes))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(again), some.column(1).take(again), pa.array(lists.reshape(-1), pa.int32()),
                     pa.array(np.repeat(floor, n_probes))], ["key", "vector", "list", "floor"])

    probing = common.table(asked.select("key", "vector").repartition(common.partitions(spark), "key").mapInArrow(  # many rows a query
        probe, "key string, vector array<double>, list int, floor double"))
    chunks = {r["list"]: -(-r["n"] // CHUNK_QUERIES) for r in probing.groupBy("list").agg(F.count("*").alias("n")).collect()}
    shape = F.broadcast(spark.createDataFrame(
        [(i, -(-r["n"] // BLOCK_ROWS), chunks[i]) for i, r in of_list.items() if i in chunks], "list int, blocks int, chunks int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    left = placed.join(shape, "list").select(
        "vec_id", "vector", "list", dealt("vec_id", "blocks").alias("block"), upto("chunks").alias("chunk"))
    asking = probing.join(shape, "list").select(
        "key", "vector", "floor", "list", upto("blocks").alias("block"), dealt("key", "chunks").alias("chunk"))
    group = ["list", "block", "chunk"]
    found = left.groupBy(*group).cogroup(asking.groupBy(*group)).applyInArrow(
        _scan(width, k + 1), "key string, vec_id long, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    answers = merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    answers = common.table(asked.select("key", "n").join(answers, "key"))
    each = common.with_group(rows.where(F.col("is_query") & right).select(F.col("vec_id").alias("query_id"), "key"),
                             answers, "key", "n")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(others).alias("place", "near")).select(
        "query_id", (F.col("place") + 1).alias("rank"), "near.vec_id", "near.score")
