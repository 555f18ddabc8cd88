"""Sharding by balanced label propagation: linked documents (equal texts) move to one shard under quotas.

Documents start in a shard by hash of their id.  All documents of a group that share a start cell (shard and salt) are
interchangeable, so the state is one row per group and cell, at most ``SHARDS * SALTS`` per group
however many copies it has.  In each round a group votes for the shard that holds most of it, cells elsewhere ask
to move there, and requests are granted, small groups first, within a quota per pair of shards: swaps that leave sizes
as they are, and the room that a shard's exact share leaves for linked rows.  Once the first ``ROUNDS`` rounds are over, groups
whose choice is full fill the shards that hold most of them and still have room, as many as they need, until no
request is granted (``MOST_ROUNDS`` is a guard).  At the end rows are numbered within
their shard, linked ones first, and what exceeds the share goes to the shards that are short: counts differ by one at
most, and only rows without copies move for that.

Null texts count as empty, with size 8; null ids and repeated rows are placed like any
others; an empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlines.llm import common

SHARDS = 24
SALTS = 64
ROUNDS = 4
MOST_ROUNDS = 64
#: Requests of a size class are granted in so many slices.
SLICES = 16


def _moves(cells: DataFrame, shards: int) -> DataFrame:
    """Requests: cells whose group has most of its rows in another shard, with the slice they are granted in."""
    held = cells.groupBy("linked", "shard").agg(F.sum("n").alias("held"))
    vote = held.groupBy("linked").agg(
        F.max(F.struct("held", F.xxhash64("linked", "shard").alias("lot"), "shard")).alias("vote"))
    wish = cells.join(vote.select("linked", F.col("vote.shard").alias("wish"), F.col("vote.held").alias("held")),
                      "linked")
    return _sliced(wish)


def _sliced(wish: DataFrame) -> DataFrame:
    spread = F.when(F.col("held") >= SLICES, F.col("cell")).otherwise(F.lit(0))
    return wish.withColumn("slice", F.floor(F.log2("held")).cast("int") * SLICES
                           + F.pmod(F.xxhash64("linked", spread), F.lit(SLICES)).cast("int"))


def _next_moves(cells: DataFrame, room: list[int]) -> DataFrame:
    """Requests as in ``_moves``, for the shards with room that hold most of a group, until what lies in shards below fits."""
    rooms = F.broadcast(_values(cells.sparkSession, list(enumerate(room)), "shard, room"))
    held = cells.groupBy("linked", "shard").agg(F.sum("n").alias("held")).join(rooms, "shard")
    order = Window.partitionBy("linked").orderBy(F.desc("held"), F.xxhash64("linked", "shard"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = held.select(
        "linked", "shard", "held", "room", F.row_number().over(order).alias("rank"),
        F.coalesce(F.sum("room").over(earlier), F.lit(0)).alias("upto"),
        F.coalesce(F.sum("held").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("below"))
    target = (F.col("room") > 0) & (F.col("upto") < F.col("below"))
    aims = ranked.groupBy("linked").agg(
        F.max(F.when(target, F.col("rank"))).alias("last"), F.max("held").alias("held"),
        F.max(F.when(target, F.col("upto") + F.col("room"))).alias("total"),
        F.sort_array(F.collect_list(F.when(target, F.struct("upto", "shard")))).alias("aims"))
    ranks = ranked.select("linked", "shard", "rank")
    wish = cells.join(aims, "linked").join(ranks, ["linked", "shard"])
    drawn = F.pmod(F.xxhash64("cell", "linked"), F.col("total"))
    aim = F.element_at(F.filter("aims", lambda x: x["upto"] <= drawn), -1)["shard"]
    asks = F.col("last").isNotNull() & (F.col("rank") > F.col("last"))
    return _sliced(wish.select("linked", "cell", "n", "shard", F.when(asks, aim).otherwise(F.col("shard")).alias("wish"), "held"))


def _quotas(asked: dict[tuple, int], sizes: list[int], capacity: int) -> dict[tuple, int]:
    """How many rows may move from s to t: as many as move back, and a share of t's room."""
    swaps = {(s, t): min(n, asked.get((t, s), 0)) for (s, t), n in asked.items()}
    wanting = [0] * len(sizes)
    for (s, t), n in asked.items():
        wanting[t] += n - swaps[s, t]
    return {(s, t): swaps[s, t] + max(0, capacity - sizes[t]) * (n - swaps[s, t]) // max(1, wanting[t])
            for (s, t), n in asked.items()}


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few constants as a table; at most one row per pair of shards."""
    listed = ", ".join(f"({', '.join(map(str, row))})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({columns})")


def propagate(cells: DataFrame, capacity: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (linked, cell, n, shard) after the rounds of moves; ``capacity``: linked rows a shard may hold."""
    spark = cells.sparkSession
    held = dict(cells.groupBy("shard").agg(F.sum("n")).collect())
    sizes = [held.get(s, 0) for s in range(shards)]
    full, first = set(), rounds  # shards that grant nothing any more; rounds of first choices that are left
    for _ in range(rounds + MOST_ROUNDS):
        room = [0 if s in full else max(0, capacity - n) for s, n in enumerate(sizes)]
        if first <= 0 and not any(room):
            break
        wish = common.table(_moves(cells, shards) if first > 0 else _next_moves(cells, room))
        flows = wish.where("shard <> wish").groupBy("shard", "wish", "slice").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("shard", "wish").orderBy("slice")
        flows = common.table(flows.withColumn("upto", F.sum("n").over(upto)))
        asked = {(r["shard"], r["wish"]): r["n"] for r in flows.groupBy("shard", "wish").agg(F.sum("n").alias("n")).collect()}
        if not asked:
            if first <= 0:
                break
            first = 0
            continue
        quotas = _quotas(asked, sizes, capacity)
        allowed = _values(spark, [(s, t, q) for (s, t), q in quotas.items()], "shard, wish, quota")
        granted = (flows.join(F.broadcast(allowed), ["shard", "wish"]).where("upto <= quota")
                   .groupBy("shard", "wish").agg(F.max("slice").alias("last"), F.max("upto").alias("n"))).collect()
        first -= 1
        if first < 0:
            full |= {t for _, t in asked} - {r["wish"] for r in granted}
        elif not granted:
            first = 0
        if not granted:
            continue
        for r in granted:
            sizes[r["shard"]] -= r["n"]
            sizes[r["wish"]] += r["n"]
        last = _values(spark, [(r["shard"], r["wish"], r["last"]) for r in granted], "shard, wish, last")
        cells = wish.join(F.broadcast(last), ["shard", "wish"], "left").select(
            "linked", "cell", "n", F.when(F.col("slice") <= F.col("last"), F.col("wish")).otherwise(F.col("shard")).alias("shard"))
    return cells


def _level(counts: list[int], shard: Column, rank: Column) -> tuple[Column, Column]:
    """Shard and slot once every shard has its exact share: surplus ranks fill the shards that are short, in order."""
    shards, total = len(counts), sum(counts)
    shares = [total // shards + (s < total % shards) for s in range(shards)]
    surplus, at = [], 0
    for n, share in zip(counts, shares):
        surplus.append(at)
        at += max(0, n - share)
    listed = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    share, begin = F.get(listed(shares), shard), F.get(listed(surplus), shard)
    extra = begin + rank - share
    into, slot, at = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for t, (n, want) in enumerate(zip(counts, shares)):
        if n < want:
            here = (extra >= at) & (extra < at + want - n)
            into = F.when(here, F.lit(t)).otherwise(into)
            slot = F.when(here, n + extra - at).otherwise(slot)
            at += want - n
    stays = rank < share
    return F.when(stays, shard).otherwise(into), F.when(stays, rank).otherwise(slot)


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, linked), one row per document."""
    text = common.text_of(F.col(text_col))
    rows = common.table(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("linked"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(shards * SALTS)).cast("int").alias("cell")))
    start = (F.col("cell") % shards).alias("shard")
    cells = common.table(rows.groupBy("linked", "cell").agg(F.count("*").alias("n")))
    groups = cells.groupBy("linked").agg(F.sum("n").alias("all")).where("`all` > 1").select("linked")
    linked = common.table(cells.join(groups, "linked").select("linked", "cell", "n", start))
    moved = propagate(linked, rows.count() // shards, shards)
    settled = moved.select("linked", "cell", F.col("shard").alias("at"))
    placed = rows.join(settled, ["linked", "cell"], "left").select(
        "doc_id", "size", "text_crc32", "linked", F.coalesce("at", start).alias("at"), F.isnull("at").alias("single"))
    ranked = common.ordered(placed, "at", "single", "linked", "doc_id")
    parts = common.table(ranked.groupBy("at", "part").agg(F.count("*").alias("n"), F.min("place").alias("first")))
    before = Window.partitionBy("at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("at", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    counted = dict(parts.groupBy("at").agg(F.sum("n")).collect())
    shard, slot = _level([counted.get(s, 0) for s in range(shards)], F.col("at"), F.col("place") + F.col("start"))
    return ranked.join(starts, ["at", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "linked")
