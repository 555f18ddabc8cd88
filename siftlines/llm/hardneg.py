"""Hard negatives: for each anchor and positive the best rows of other labels whose score lies in a window below the positive's.

Vectors become integers, floor(``SCALE`` * x), and a score is the inner product of an anchor and a row.  Rows are put on a sphere by one more
component, sqrt(M^2 - |x|^2) with the largest norm M, so that a distance from an anchor (with 0 there) and an inner product follow
from each other, and are kept in cover trees: a node's children are rows at least a level's radius apart, the radius falling by ``BASE``
from level to level, and each node knows, for each of its levels, how far its farthest remaining descendant is.
An inner product with a descendant differs by no more than the anchor's norm times that radius, and by no more than the cap of the
sphere around the node allows.

A search goes down a tree by the best upper bound first, for all anchors of a group that still have an interest in
a node: a node is skipped if none of their windows, cut off below at the k-th best score found so far, meets its bounds; rows are
verified exactly as they are reached.  The first level of the trees is spread over the cluster: rows go to the nearest of up to
``MOST_CELLS`` pivots, a cell is cut into trees of ``TREE_ROWS``, and anchors visit the ``FIRST`` most promising cells, then those that
the k-th best score found there does not rule out.  An anchor's positives are found by the same search over an open window, among rows of its label.

Rows with a null id, label or vector, null or non-finite components, or another length than most take no part; zero vectors
do.  Ties go to the smaller id; ids are expected to be unique, a row with the anchor's id is never its positive.  Of equal rows of a label
only as many as can be among the answers are kept in the trees.  Scores are 64-bit integers.  Other columns play no part,
whatever their names.  An empty table, or one without anchors, gives an empty result.
"""

import heapq
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlines.llm import common

POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100
SCALE = 256
BASE = 1.3
SAMPLE = 20_000
MOST_CELLS = 4096
CELL_ROWS = 2048
TREE_ROWS = 2048
CHUNK_ANCHORS = 2048
FIRST = 2
#: Anchors that go down a tree together.
TOGETHER = 256


def matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Rows on the sphere of radius ``most``."""
    x = x.astype(np.float64)
    return np.c_[x, np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0))]


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[float]]]:
    """Parent of each row (-1 for the first, the root), the step of its parent it comes in at, and each row's radii.

    The radii of a row are the distances of its farthest descendant before each of its steps.
    """
    n = len(points)
    parent, step, radii = np.full(n, -1), np.zeros(n, np.int64), [[] for _ in range(n)]
    far = lambda a, rows: np.sqrt(np.maximum(((points[rows] - points[a]) ** 2).sum(axis=1), 0))
    waiting = [(0, np.arange(1, n), far(0, np.arange(1, n)))] if n else []
    while waiting:
        top, rows, apart = waiting.pop()
        if not len(rows):
            continue
        widest = float(apart.max())
        radii[top].append(widest)
        # The largest radius of the levels below the farthest row.
        level = BASE ** (np.ceil(np.log(widest) / np.log(BASE)) - 1) if widest > 0 else -1.0
        outside, inside = rows[apart > level], apart <= level
        left = points[outside]
        while len(outside):
            new = outside[0]
            parent[new], step[new] = top, len(radii[top]) - 1
            gap = np.sqrt(((left - left[0]) ** 2).sum(axis=1))
            near = gap <= max(level, 0.0)
            near[0] = True
            if near.sum() == 1:  # views, no copies
                outside, left = outside[1:], left[1:]
                continue
            own = near.copy()
            own[0] = False
            waiting.append((new, outside[own], gap[own]))
            outside, left = outside[~near], left[~near]
        waiting.append((top, rows[inside], apart[inside]))
    return parent, step, radii


def _build(width: int, most: float):
    def build(rows: pa.Table) -> pa.Table:
        x = matrix(rows["x"], width)
        parent, step, radii = cover_tree(lifted(x, most))
        return rows.append_column("slot", pa.array(np.arange(len(x)), pa.int32())).append_column(
            "parent", pa.array(parent, pa.int32())).append_column("step", pa.array(step, pa.int32())).append_column(
            "radii", pa.array(radii, pa.list_(pa.float64())))

    return build


def bounds(score: np.ndarray, norm: np.ndarray, radius, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of an anchor and anything within ``radius`` of a row it has ``score`` with."""
    slack = 1e-9 * (norm * most + 1)
    low, high = score - norm * radius, score + norm * radius
    whole = norm * most
    angle = np.arccos(np.clip(score / np.where(whole > 0, whole, 1), -1, 1))
    turn = 2 * np.arcsin(np.clip(radius / (2 * most), 0, 1)) if most > 0 else np.pi
    low = np.maximum(low, whole * np.cos(np.minimum(angle + turn, np.pi)))
    high = np.minimum(high, whole * np.cos(np.maximum(angle - turn, 0)))
    return low - slack, high + slack


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integers."""
    most = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * float(x.shape[1])
    if most < 2.0 ** 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def meets(low, high, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Whether any window of each anchor (anchors x windows) meets the bounds."""
    return ((high[..., None] >= lows) & (low[..., None] <= highs)).any(axis=-1)


def windows(positives: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The integer scores s with low * p <= 100 * s <= high * p."""
    return -((-low * positives) // 100), (high * positives) // 100


class Tree:
    """The rows of a cover tree, ready for searches."""

    def __init__(self, rows: pa.Table, width: int, most: float):
        rows = rows.sort_by("slot")
        self.x, self.ids = matrix(rows["x"], width), rows["vec_id"].to_numpy()
        self.labels, self.radii, self.most = rows["label"].to_numpy(), rows["radii"].to_pylist(), most
        parent, step = rows["parent"].to_numpy(), rows["step"].to_numpy()
        order = np.lexsort((step, parent))
        edges = np.flatnonzero(np.r_[True, (np.diff(parent[order]) != 0) | (np.diff(step[order]) != 0)])
        self.children = {(int(parent[part[0]]), int(step[part[0]])): part for part in np.split(order, edges[1:])}

    def search(self, q, labels, same: bool, lows, highs, k: int):
        """Hits (anchor, window, slot, score): the k best rows of each window, and those equal to the last of them."""
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        least = lows.astype(np.float64)  # rises with what is found
        best = np.full((*lows.shape, k), -np.inf)
        hits = []

        def verify(members, slots):
            score = product(q[members], self.x[slots])
            allowed = (self.labels[slots][None, :] == labels[members][:, None]) == same
            for w in range(lows.shape[1]):
                good = allowed & (score >= least[members, w][:, None]) & (score <= highs[members, w][:, None])
                who, which = np.nonzero(good)
                if not len(who):
                    continue
                hits.append((members[who], np.full(len(who), w), slots[which], score[who, which]))
                touched = np.unique(who)
                seen = np.where(good[touched], score[touched].astype(np.float64), -np.inf)
                both = np.concatenate([best[members[touched], w], seen], axis=1)
                kept = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                best[members[touched], w] = kept
                least[members[touched], w] = np.maximum(least[members[touched], w], kept.min(axis=1))
            return score.astype(np.float64)

        everyone, turn = np.arange(len(q)), count()
        root = verify(everyone, np.zeros(1, np.int64))[:, 0]
        heap = []

        def push(slot: int, at: int, members, score):
            if at >= len(self.radii[slot]) or not len(members):
                return
            low, high = bounds(score, norm[members], self.radii[slot][at], self.most)
            alive = meets(low, high, least[members], highs[members])
            if alive.any():
                heapq.heappush(heap, (-float(high[alive].max()), next(turn), slot, at, members[alive], score[alive]))

        push(0, 0, everyone, root)
        while heap:
            _, _, slot, at, members, score = heapq.heappop(heap)
            low, high = bounds(score, norm[members], self.radii[slot][at], self.most)
            alive = meets(low, high, least[members], highs[members])  # again, as windows have shrunk since
            members, score = members[alive], score[alive]
            if not len(members):
                continue
            below = self.children.get((slot, at), np.empty(0, np.int64))
            if len(below):
                found = verify(members, below)
                for i, child in enumerate(below.tolist()):
                    if self.radii[child]:
                        push(child, 0, members, found[:, i])
            push(slot, at + 1, members, score)
        if not hits:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        who, w, slot, score = (np.concatenate(part) for part in zip(*hits))
        kept = score >= least[who, w]
        who, w, slot, score = who[kept], w[kept], slot[kept], score[kept]
        order = np.lexsort((self.ids[slot], -score, w, who))
        who, w, slot, score = who[order], w[order], slot[order], score[order]
        group = who * lows.shape[1] + w
        kept = np.arange(len(group)) - np.searchsorted(group, group) < k
        return who[kept], w[kept], slot[kept], score[kept]


def _window_arrays(rows: pa.Table, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of anchors, anchors x windows: open ones where no positives are given; cut off below at ``floors``."""
    positives, floors = rows["positives"].to_pylist(), rows["floors"].to_pylist()
    wide = max((len(p) for p in positives if p is not None), default=1)
    lows, highs = np.full((len(positives), wide), np.inf), np.full((len(positives), wide), -np.inf)
    for i, (scores, floor) in enumerate(zip(positives, floors)):
        if scores is None:
            lows[i, 0], highs[i, 0] = -np.inf, np.inf
        elif scores:
            lows[i, :len(scores)], highs[i, :len(scores)] = windows(np.array(scores, np.int64), low, high)
        for w, f in enumerate(floor or []):
            if f is not None:
                lows[i, w] = max(lows[i, w], f)
    return lows, highs


def _go_down(width: int, most: float, same: bool, k: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows and anchors.num_rows:
            tree = Tree(rows, width, most)
            for at in range(0, anchors.num_rows, TOGETHER):
                some = anchors.slice(at, TOGETHER)
                lows, highs = _window_arrays(some, low, high)
                who, w, slot, score = tree.search(matrix(some["x"], width), some["label"].to_numpy(), same, lows, highs, k)
                parts.append((some["anchor"].to_numpy()[who], w, tree.ids[slot], score))
        joined = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * 4
        return pa.table({"anchor": pa.array(joined[0], pa.int64()), "window": pa.array(joined[1], pa.int32()),
                         "vec_id": pa.array(joined[2], pa.int64()), "score": pa.array(joined[3], pa.int64())})

    return run


def _visit(pivots: np.ndarray, radii: np.ndarray, width: int, most: float, low: int, high: int, first: bool):
    """A row for each anchor and cell it visits: the ``FIRST`` most promising ones, or the others that its windows meet."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                rows = pa.Table.from_batches([some])
                lows, highs = _window_arrays(rows, low, high)
                q = matrix(rows["x"], width).astype(np.float64)
                score = q @ pivots.T
                norm = np.sqrt((q * q).sum(axis=1))[:, None]
                least, largest = bounds(score, norm, radii[None, :], most)
                top = highs.max(axis=1, keepdims=True)
                with np.errstate(invalid="ignore"):
                    order = np.argsort(np.where(np.isfinite(top), np.abs(score - top), -score), axis=1, kind="stable")
                early = np.zeros(score.shape, bool)
                np.put_along_axis(early, order[:, :FIRST], True, axis=1)
                meeting = np.zeros(score.shape, bool)
                for w in range(lows.shape[1]):
                    meeting |= (largest >= lows[:, w:w + 1]) & (least <= highs[:, w:w + 1])
                who, cell = np.nonzero(meeting & (early if first else ~early))
                taken = some.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32())], [*some.schema.names, "cell"])

    return run


_ANCHORS = "anchor long, label long, x array<long>, positives array<long>, floors array<long>"


class Forest:
    """Cover trees of all rows, one table; and where their cells lie."""

    def __init__(self, rows: DataFrame, width: int):
        spark = rows.sparkSession
        self.width = width
        n, norm = rows.agg(F.count("*"), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v))).first()
        self.most = float(np.sqrt(norm)) * (1 + 1e-12)
        draw = F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 30)) / (1 << 30)
        cells = max(1, min(MOST_CELLS, round(n / CELL_ROWS)))
        drawn = [r["x"] for r in rows.where(draw < SAMPLE / n * 1.1 + 1e-6).select("x", draw.alias("draw")).orderBy("draw").limit(
            SAMPLE).collect()] or [rows.first()["x"]]
        different = np.unique(np.array(drawn, np.int64), axis=0)
        self.pivots = different[np.random.default_rng(7).permutation(len(different))[:cells]]
        middle, most = lifted(self.pivots, self.most), self.most

        def assign(batches):
            for batch in batches:
                x = lifted(matrix(batch.column("x"), width), most)
                near = (x @ middle.T).argmax(axis=1) if len(x) else np.empty(0, np.int64)
                apart = np.sqrt(((x - middle[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(apart, pa.float64())],
                                                 [*batch.schema.names, "cell", "apart"])

        placed = common.table(rows.mapInArrow(assign, "vec_id long, label long, x array<long>, cell int, apart double"))
        shape = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("apart").alias("radius")).collect()  # MOST_CELLS at most
        self.trees = {r["cell"]: -(-r["rows"] // TREE_ROWS) for r in shape}
        self.radii = np.full(len(self.pivots), -np.inf)
        for r in shape:
            self.radii[r["cell"]] = r["radius"]
        self.radii = np.where(np.isfinite(self.radii), self.radii * (1 + 1e-9), 0.0)
        self.sizes = spark.createDataFrame(list(self.trees.items()), "cell int, trees int")
        dealt = placed.join(F.broadcast(self.sizes), "cell").withColumn(
            "tree", F.pmod(F.xxhash64("vec_id", "label"), F.col("trees")).cast("int"))
        self.nodes = common.table(dealt.select("vec_id", "label", "x", "cell", "tree").groupBy("cell", "tree").applyInArrow(
            _build(width, self.most), "vec_id long, label long, x array<long>, cell int, tree int, slot int, parent int, step int, "
                                      "radii array<double>"))

    def _descend(self, anchors: DataFrame, same: bool, k: int, low: int, high: int, first: bool) -> DataFrame:
        spark = anchors.sparkSession
        visiting = common.table(anchors.mapInArrow(
            _visit(self.pivots.astype(np.float64), self.radii, self.width, self.most, low, high, first), _ANCHORS + ", cell int"))
        asked = {r["cell"]: -(-r["n"] // CHUNK_ANCHORS) for r in visiting.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        shape = F.broadcast(spark.createDataFrame(
            [(c, self.trees[c], n) for c, n in asked.items() if c in self.trees], "cell int, trees int, chunks int"))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = self.nodes.join(shape, "cell").withColumn("chunk", upto("chunks")).drop("trees", "chunks")
        coming = visiting.join(shape, "cell").withColumn("chunk", F.pmod(F.xxhash64("anchor"), F.col("chunks")).cast("int")).withColumn(
            "tree", upto("trees")).drop("trees", "chunks")
        group = ["cell", "tree", "chunk"]
        found = rows.groupBy(*group).cogroup(coming.groupBy(*group)).applyInArrow(
            _go_down(self.width, self.most, same, k, low, high), "anchor long, window int, vec_id long, score long")
        return common.table(best(found, k))

    def search(self, anchors: DataFrame, same: bool, k: int, low: int = LOW, high: int = HIGH) -> DataFrame:
        """(anchor, window, vec_id, score, rank): the k best rows in each window of anchors(anchor, label, x, positives).

        Rows have the anchor's label or another one, by ``same``; without positives the only window is open.
        """
        begun = anchors.withColumn("floors", F.lit(None).cast("array<long>")).select("anchor", "label", "x", "positives", "floors")
        early = self._descend(begun, same, k, low, high, True)
        floors = early.where(F.col("rank") == k).groupBy("anchor").agg(
            F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))  # a window of an anchor each
        wide = F.greatest(F.lit(1), F.coalesce(F.size("positives"), F.lit(1)))
        again = begun.drop("floors").join(floors, "anchor", "left").select(
            "anchor", "label", "x", "positives",
            F.transform(F.sequence(F.lit(0), wide - 1), lambda w: F.try_element_at("kth", w)).alias("floors"))
        late = self._descend(common.table(again), same, k, low, high, False)
        return best(early.drop("rank").unionByName(late.drop("rank")), k)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row that ``is_anchor`` holds for and each of its ``positives`` best other rows of the same label, the ``negatives`` best rows of
    another label whose score is from ``low`` to ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    none = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    named = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    usable = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
                         & (F.size("vector") > 0) & F.forall("vector", finite))
    usual = usable.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if usual is None:
        return spark.createDataFrame([], none)
    rows = common.table(usable.where(F.size("vector") == usual["width"]).select(
        "vec_id", "label", F.transform("vector", lambda v: F.floor(v * scale)).alias("x"), "is_anchor"))
    most = max(positives + 1, negatives)
    equal = Window.partitionBy("same", "label").orderBy("vec_id")
    same = F.concat_ws(":", F.xxhash64(F.lit(1), "x"), F.xxhash64(F.lit(2), "x"))
    listed = common.table(rows.select("vec_id", "label", "x", same.alias("same")).withColumn(
        "copy", F.row_number().over(equal)).where(F.col("copy") <= most).select("vec_id", "label", "x"))
    forest = Forest(listed, usual["width"])
    anchors = common.table(rows.where("is_anchor").select(
        F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "x"))
    if anchors.isEmpty():
        return spark.createDataFrame([], none)
    near = forest.search(anchors.select("anchor", "label", "x", F.lit(None).cast("array<long>").alias("positives")), True, positives + 1)
    others = near.join(anchors.select("anchor", "anchor_id"), "anchor").where("vec_id <> anchor_id")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    chosen = common.table(others.withColumn("window", F.row_number().over(order) - 1).where(F.col("window") < positives).select(
        "anchor", "anchor_id", "window", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    asked = chosen.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "positive_score"))),
                                                     lambda p: p["positive_score"]).alias("positives"))
    asking = common.table(anchors.join(asked, "anchor").select("anchor", "label", "x", "positives"))
    if asking.isEmpty():
        return spark.createDataFrame([], none)
    found = forest.search(asking, False, negatives, low, high)
    return found.join(chosen, ["anchor", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
