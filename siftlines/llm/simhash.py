"""SimHash near-dedup with pigeonring filtering.

A 64-bit fingerprint is cut into five segments on a ring.  If two differ in at most ``BUDGET`` bits, some segment
begins a chain in which the first k segments differ in at most k * BUDGET / 5 bits, for every k up to five.  With a budget of 4 the
first segment is equal and the first two differ in one bit at most, so a fingerprint is indexed under each pair of
consecutive segments and looked up under each with one bit of the second flipped; a chain is followed segment by
segment before the full distance is taken.

Equal fingerprints are one row throughout.  Within an index entry no more than a forest of links leaves the task: links among
few are taken as they are, and a large entry links its members to a first one and compares the rest with
all.  Around one centre there are at most C(64, 4) + ... fingerprints, which bounds an entry whatever the number of copies.

Null and wordless texts have fingerprint zero and are linked to each other; a null id is never
the smallest of a component unless there is no other; rows repeated are one row each; an empty table
gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlines.llm import common

SHINGLE = 4
BUDGET = 4
#: First bit and width of each segment.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rounds of label spreading before giving up; each at least halves a path.
ROUNDS = 64
#: Shingles whose bits are counted at a time.
SLICE = 1 << 15
#: Entries up to this size compare each with each.
SMALL = 48
#: First members that a large entry is compared with before the rest is compared with all.
HUBS = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the hashes of all word shingles; zero without words."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash64(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), SLICE):
        hashes = np.array([hash64(joined[a:b], 42) for a, b in zip(starts[at:at + SLICE], stops[at:at + SLICE])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(starts)).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["doc_id", "content", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content, fp): the fingerprint's bits as a signed long, and a hash of the whole row."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(*docs.columns).alias("content"),
                        F.col(text_col).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(_fingerprints, f"doc_id {kind}, content long, fp long")


def _segment(i: int) -> Column:
    start, width = SEGMENTS[i % len(SEGMENTS)]
    return F.expr(f"shiftrightunsigned(fp, {start}) & {(1 << width) - 1}L")


def index_entries(fps: DataFrame) -> DataFrame:
    """(entry, fp, probe): the entries a fingerprint lies in, and those it looks into."""
    lists = []
    for i in range(len(SEGMENTS)):
        width = SEGMENTS[(i + 1) % len(SEGMENTS)][1]
        key = F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(F.shiftleft(_segment(i), 16)).bitwiseOR(_segment(i + 1))
        lists.append(F.struct(key.alias("entry"), F.lit(False).alias("probe")))
        lists += [F.struct(key.bitwiseXOR(F.lit(1 << b)).alias("entry"), F.lit(True).alias("probe")) for b in range(width)]
    return fps.select("fp", F.explode(F.array(*lists)).alias("at")).select("at.entry", "fp", "at.probe")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def chained(first: np.ndarray, second: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Which pairs pass: the chain from ``segment`` on stays within its budgets, then the whole distance."""
    different = first ^ second
    alive = np.arange(len(different))
    total = np.zeros(len(different), np.int64)
    starts = np.array([s for s, _ in SEGMENTS], np.uint64)
    masks = np.array([(1 << w) - 1 for _, w in SEGMENTS], np.uint64)
    for k in range(1, len(SEGMENTS) + 1):
        at = (segment[alive] + k - 1) % len(SEGMENTS)
        total[alive] += _popcount((different[alive] >> starts[at]) & masks[at])
        alive = alive[total[alive] * len(SEGMENTS) <= k * BUDGET]
    passed = np.zeros(len(different), bool)
    passed[alive] = _popcount(different[alive]) <= BUDGET
    return passed


def _large(members: np.ndarray, lookers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a large entry: as connected as all links are, no more than a few per row.

    Rows near the first member are linked to it; each other row is compared with
    all members and linked to one member of each part that it touches.
    """
    rows = np.concatenate([members, lookers])
    parent = np.arange(len(rows))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []

    def link(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))

    todo = np.arange(len(rows))
    for _ in range(HUBS):
        if not len(todo) or todo[0] >= len(members):
            break
        hub = todo[0]
        near = todo[_popcount(rows[todo] ^ rows[hub]) <= BUDGET]
        link(int(hub), near[near != hub])
        rest = todo[_popcount(rows[todo] ^ rows[hub]) > BUDGET]
        for i in rest.tolist():  # what is linked to the hub may also touch the rest
            others = near if i < len(members) else near[near < len(members)]
            touching = others[_popcount(rows[others] ^ rows[i]) <= BUDGET]
            link(i, touching[:1])
        todo = rest
    for i in todo.tolist():
        others = np.arange(len(members)) if i >= len(members) else np.arange(len(rows))
        touching = others[_popcount(rows[others] ^ rows[i]) <= BUDGET]
        link(i, touching[touching != i])
    picked = np.array(links, np.int64).reshape(-1, 2)
    return rows[picked[:, 0]], rows[picked[:, 1]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by entry, members before lookers; entries may run over several batches."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def solve(entry: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
        size = np.diff(np.r_[first, len(entry)])
        row_size = np.repeat(size, size)
        left, right = [], []
        small = int(size[size <= SMALL].max(initial=0))
        for step in range(1, small):
            i = np.flatnonzero((entry[step:] == entry[:-step]) & (row_size[step:] <= SMALL) & ~probe[:-step])
            a, b = fp[i], fp[i + step]
            ok = chained(a, b, (entry[i] >> 32).astype(np.int64))
            left.append(a[ok])
            right.append(b[ok])
        for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
            rows, looks = fp[at:at + n], probe[at:at + n]
            if not looks.all():
                a, b = _large(rows[~looks], rows[looks])
                left.append(a)
                right.append(b)
        a = np.concatenate(left) if left else np.empty(0, np.uint64)
        b = np.concatenate(right) if right else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        entry = batch.column(0).to_numpy()
        held.append((entry, batch.column(1).to_numpy().view(np.uint64),
                     batch.column(2).to_numpy(zero_copy_only=False).astype(bool)))
        if held[0][0][0] != entry[-1]:  # keep the last entry, which may go on
            whole = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(whole[0], entry[-1]))
            yield solve(*[x[:cut] for x in whole])
            held = [tuple(x[cut:] for x in whole)]
    if held:
        yield solve(*[np.concatenate(x) for x in zip(*held)])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect whatever is within the budget."""
    n = common.partitions(fps.sparkSession)
    entries = index_entries(fps).repartition(n, "entry").sortWithinPartitions("entry", "probe")
    return entries.mapInArrow(_links, "a long, b long").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest label reachable over ``edges`` (a, b); ``nodes`` has (node, label), labels unique.

    In each round a node takes the smallest label of its neighbours and then the label of the
    node that this label belongs to, until no label changes.
    """
    both = common.table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    touched = both.select(F.col("a").alias("node")).distinct()
    state = common.table(nodes.join(touched, "node").withColumn("own", F.col("label")))
    for _ in range(ROUNDS):
        near = (both.join(state.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        nearest = common.table(state.join(near, "node").select(
            "node", "own", F.col("label").alias("before"), F.least("label", "near").alias("label")))
        jump = nearest.select(F.col("own").alias("label"), F.col("label").alias("next"))
        state = common.table(nearest.join(jump, "label").select(
            "node", "own", "before", F.least("label", "next").alias("label")))
        if not state.where("label <> before").limit(1).count():
            break
        state = state.drop("before")
    else:
        raise RuntimeError("labels did not settle")
    return state.select("node", "label")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, representative, content), one row per document.

    ``representative`` marks one row per component: the one with the smallest id.
    """
    rows = common.table(fingerprints(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    groups = common.table(rows.groupBy("fp").agg(
        F.count("*").alias("n"), F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("label")))
    found = common.table(links(groups.select("fp")))
    settled = components(groups.select(F.col("fp").alias("node"), "label"),
                         found)
    named = common.table(groups.join(settled.select(F.col("node").alias("fp"), F.col("label").alias("least")), "fp", "left")
                         .select("fp", "n", F.coalesce("least", "label").alias("least")))
    return common.with_group(rows, named, "fp", "n").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("representative"), "content")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the smallest id.

    Decisions are joined back by id and a hash of the whole row; rows alike in every column are one.
    """
    stay = near_groups(docs, id_col, text_col).where("representative").select(
        common.join_id(F.col("doc_id")).alias("_id"), F.col("content").alias("_content"))
    return common.keyed(docs, id_col).join(stay, ["_id", "_content"], "left_semi").dropDuplicates(
        ["_id", "_content"]).drop("_id", "_content").toDF(*docs.columns)
