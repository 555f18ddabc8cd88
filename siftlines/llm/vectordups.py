"""Near-duplicate vectors of a label: cells by spherical k-means, cosine products in blocks, one row kept of each group.

Centres come from a bounded sample (``SAMPLE``), for 2, 4, 8, ... ``MOST_CELLS`` cells; a label takes as many cells as have about
``CELL_ROWS`` of its vectors each.  A vector lives in the cell of its nearest centre.  Vectors of one cell are compared by blocked
products, and a vector also visits those later cells that may hold a vector as near as ``tau``: if y lies on b's side of the plane
between the centres a and b, a vector x on a's side is at least (x.a - x.b) / |a - b| away, and a cosine of tau leaves a distance
of sqrt(2 - 2 tau).  So no link is lost, whatever the centres are; where vectors form clusters few cells are
visited, and where they do not, most later cells of the label are (``slack`` below 1 visits fewer and may lose links).

Equal vectors are compared once and count as often as they appear.  A cell's rows are cut into blocks and its visitors into chunks,
so a hot label or cell is many groups.  A group returns the number of links of each vector and
a star for each set of vectors linked within it, never the pairs; the stars are joined to components by contraction.

Rows with a null label, null, empty or zero vectors, null or non-finite components link with nothing and are kept; vectors of
different length do not link.  Ids are expected to be unique; rows with equal ids are counted each, and what they link to is one
component.  A row with a null id is no other row's representative: its component is the smallest id of its group, null if there is none.  Other
columns of the input play no part, whatever their names.  An empty table gives an empty result.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlines.llm import common

TAU = 0.93
SAMPLE = 20_000
CELL_ROWS = 2048
MOST_CELLS = 1024
ITERATIONS = 8
BLOCK_ROWS = 2048
CHUNK_ROWS = 4096
#: Cosines this near to tau are worked out again from the vectors as they are.
CLOSE = 1e-9


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    largest = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # first, so that no square overflows
    x = x / largest
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def centres(points: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means of unit vectors, from evenly spaced ones."""
    found = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(ITERATIONS):
        nearest = np.concatenate([(points[a:a + 2048] @ found.T).argmax(axis=1) for a in range(0, len(points), 2048)])
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, points)
        found = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, unit(sums), found)
    return found


def visits(x: np.ndarray, middle: np.ndarray, tau: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector, and which later cells may hold a vector that near (rows x cells)."""
    near = x @ middle.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * middle @ middle.T, 0))
    most = slack * np.sqrt(max(2 - 2 * tau, 0)) * apart[home] + 1e-9
    return home, (near[np.arange(len(x)), home][:, None] - near <= most) & (np.arange(len(middle)) > home[:, None])


def _assign(levels: dict[int, np.ndarray], width: int, tau: float, slack: float):
    def run(batches):
        for batch in batches:
            vector, cells = batch.column("vector"), batch.column("cells").to_numpy()
            home, later = np.zeros(len(cells), np.int64), [[]] * len(cells)
            for level in set(cells[cells > 1].tolist()):
                which = np.flatnonzero(cells == level)
                home[which], seen = visits(unit(matrix(vector.take(pa.array(which)), width)), levels[level], tau, slack)
                for i, row in zip(which.tolist(), seen):
                    later[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), vector, batch.column("n"), batch.column("same"), batch.column("kind"),
                 pa.array(home, pa.int32()), pa.array(later, pa.list_(pa.int32()))],
                ["id", "vector", "n", "same", "kind", "cell", "later"])

    return run


class Links:
    """Links among the rows of one group, found block by block: their number for each row, and the smallest id reachable."""

    def __init__(self, x: np.ndarray, n: np.ndarray, tau: float):
        self.x, self.u, self.n, self.tau = x, unit(x), n, tau
        self.count = np.zeros(len(x), np.int64)
        self.root = np.arange(len(x))

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def compare(self, left: np.ndarray, right: np.ndarray, within: bool = False) -> None:
        """Rows ``left`` with rows ``right``; with ``within`` each pair of them once."""
        cosine = self.u[left] @ self.u[right].T
        for i, j in zip(*np.nonzero(np.abs(cosine - self.tau) < CLOSE)):
            a, b = self.x[left[i]], self.x[right[j]]
            with np.errstate(over="ignore", invalid="ignore"):
                again = (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
            cosine[i, j] = again if np.isfinite(again) else cosine[i, j]
        linked = cosine >= self.tau
        if within:
            linked &= right[None, :] > left[:, None]
        if not linked.any():
            return
        self.count[left] += linked @ self.n[right]
        self.count[right] += self.n[left] @ linked
        for i in np.flatnonzero(linked.any(axis=1)):  # a row and all that it links with have one root
            roots = {self._find(j) for j in np.unique(self.root[right[linked[i]]])} | {self._find(left[i])}
            least = min(roots)
            for r in roots:
                self.root[r] = least

    def roots(self) -> np.ndarray:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]
        return self.root


def _compare(tau: float):
    def run(key: tuple, homes: pa.Table, guests: pa.Table) -> pa.Table:
        rows = pa.concat_tables([homes.select(["id", "vector", "n"]), guests.select(["id", "vector", "n"])])
        if homes.num_rows == 0:
            rows = rows.slice(0, 0)
        ids = rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")  # so that the first of a set has its smallest id
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        rows, ids = rows.take(pa.array(order)), ids[order]
        width = len(rows["vector"][0]) if rows.num_rows else 1
        links = Links(matrix(rows["vector"], width), rows["n"].to_numpy(), tau)
        own, other = np.sort(place[:homes.num_rows]), np.sort(place[homes.num_rows:])
        for at in range(0, len(own), 512):
            part = own[at:at + 512]
            if key[-1].as_py() == 0:  # the block itself, once
                links.compare(part, own[at:], within=True)
            for begin in range(0, len(other), 2048):
                links.compare(part, other[begin:begin + 2048])
        found = np.flatnonzero(links.count)
        return pa.table({"id": pa.array(ids[found], pa.int64()), "links": pa.array(links.count[found], pa.int64()),
                         "star": pa.array(ids[links.roots()[found]], pa.int64())})

    return run


def _mapped(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``rows`` with the values of ``column`` replaced by their parents where they have one; values may be hot."""
    groups = common.table(rows.groupBy(column).agg(F.count("*").alias("_n")).join(
        parents.select(F.col("id").alias(column), F.col("parent").alias("_up")), column, "left").select(
        column, "_n", F.coalesce("_up", column).alias("_to")))
    return common.with_group(rows, groups, column, "_n").drop(column, "_n").withColumnRenamed("_to", column)


def components(edges: DataFrame) -> DataFrame:
    """(id, parent): for every id of edges(a, b) that is not the smallest of its component, that smallest id.

    Every id hooks to its smallest neighbour below it, the trees are flattened by pointer jumping, and edges between roots are what
    the next round works on; at least half of the ids of an edge are gone after each.
    """
    left = common.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    known = None
    while not left.isEmpty():
        parents = common.table(left.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("parent")))
        while True:
            jumped = common.table(_mapped(parents.withColumn("before", F.col("parent")), "parent", parents))
            parents = jumped.select("id", "parent")
            if jumped.where("parent <> before").isEmpty():
                break
        left = common.table(_mapped(_mapped(left, "a", parents), "b", parents).where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        known = parents if known is None else common.table(_mapped(known, "parent", parents).unionByName(parents))
    return edges.sparkSession.createDataFrame([], "id long, parent long") if known is None else known


def near_groups(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                tau: float = TAU, cell_rows: int = CELL_ROWS, slack: float = 1.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    vector = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    part = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(vector)
    kind = F.concat_ws(":", F.size(vector), F.col("label").cast("string"))
    named = rows.select("vec_id", "vector", F.when(part, kind).alias("kind"), F.when(part, F.concat_ws(
        ":", F.xxhash64(F.lit(1), vector), F.xxhash64(F.lit(2), vector), kind)).alias("same"))
    different = common.table(named.where("same IS NOT NULL").groupBy("same").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector"), F.first("kind").alias("kind")))
    # As many cells as the label's vectors fill, a power of two.
    want = F.least(F.lit(MOST_CELLS), F.pow(2, F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("of_kind") / cell_rows)))).cast("int"))
    labels = common.table(different.groupBy("kind").agg(F.count("*").alias("of_kind"), F.max(F.size("vector")).alias("width"))
                          .withColumn("cells", want))
    total, most = labels.agg(F.sum("of_kind"), F.max("cells")).first()
    levels, width = {}, 1
    if most and most > 1:
        draw = F.pmod(F.xxhash64("same"), F.lit(1 << 30)) / (1 << 30)
        drawn = [r["vector"] for r in different.where(draw < SAMPLE / total * 1.1 + 1e-6).select(
            "vector", draw.alias("draw")).orderBy("draw").limit(SAMPLE).collect()]
        width = Counter(map(len, drawn)).most_common(1)[0][0]
        sample = unit(np.array([v for v in drawn if len(v) == width]))
        levels = {2 ** i: centres(sample, 2 ** i) for i in range(1, most.bit_length())}
    cells = F.when(F.size("vector") == width, F.col("cells")).otherwise(1).alias("cells")
    sized = common.with_group(different, labels, "kind", "of_kind").select("id", "vector", "n", "same", "kind", cells)
    placed = common.table(sized.mapInArrow(
        _assign(levels, width, tau, slack),
        "id long, vector array<double>, n long, same string, kind string, cell int, later array<int>").withColumn(
        "home", F.concat_ws("/", "cell", "kind")))

    visiting = placed.select("kind", F.explode("later").alias("to")).groupBy(
        F.concat_ws("/", "to", "kind").alias("home")).agg(F.count("*").alias("guests"))
    shape = common.table(placed.groupBy("home").agg(F.count("*").alias("rows")).join(visiting, "home", "left").select(
        "home", "rows", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(
            (F.coalesce("guests", F.lit(0)) + F.when(F.col("rows") > BLOCK_ROWS, F.col("rows")).otherwise(0)) / CHUNK_ROWS
        )).cast("int").alias("chunks")))
    dealt = lambda name, n, seed: F.pmod(F.xxhash64(name, F.lit(seed)), F.col(n)).cast("int")
    here = common.table(common.with_group(placed, shape, "home", "rows").withColumn("block", dealt("id", "blocks", 1)))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ["id", "vector", "n", "home", "block", "chunk"]
    homes = here.withColumn("chunk", upto("chunks")).select(fields)
    # Visitors: vectors of earlier cells, and of the same cell those of earlier blocks.
    after = F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1))
    beside = here.where("block + 1 < blocks").withColumn("chunk", dealt("id", "chunks", 2)).withColumn("block", after).select(fields)
    coming = here.select("id", "vector", "n", F.col("kind"), F.explode("later").alias("to")).select(
        "id", "vector", "n", F.concat_ws("/", "to", "kind").alias("home"))
    coming = common.with_group(coming, shape.join(visiting, "home"), "home", "guests").withColumn(
        "chunk", dealt("id", "chunks", 2)).withColumn("block", upto("blocks")).select(fields)
    group = ["home", "block", "chunk"]
    found = common.table(homes.groupBy(*group).cogroup(beside.unionByName(coming).toDF(*fields).groupBy(*group)).applyInArrow(
        _compare(tau), "id long, links long, star long"))

    roots = components(found.select(F.col("id").alias("a"), F.col("star").alias("b")))
    linked = found.groupBy("id").agg(F.sum("links").alias("links")).join(roots, "id", "left")
    groups = common.table(different.select("same", "id", "n").join(linked, "id", "left").select(
        "same", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("parent", "id").alias("component_id")))
    apart = named.where("same IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return common.with_group(named.where("same IS NOT NULL").select("vec_id", "same"), groups, "same", "n").select(
        "vec_id", "n_links", "component_id").unionByName(apart).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", **how) -> DataFrame:
    """The rows of ``vectors`` that ``near_groups`` keeps, with all their columns; rows with null ids stay."""
    kept = near_groups(vectors, id_col, **how).where("kept AND vec_id IS NOT NULL").select(F.col("vec_id").alias("_kept")).distinct()
    renamed, name = common.plain(vectors), common.plain_name(vectors, id_col)
    stay = renamed.join(kept, renamed[name].cast("long") == kept["_kept"], "left_semi").unionByName(renamed.where(F.col(name).isNull()))
    return stay.toDF(*vectors.columns)
