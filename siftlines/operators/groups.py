"""Totals of a group on each of its rows, whatever share of the rows a group holds."""

from pyspark.sql import Column, DataFrame, functions as F

# Cells a group is cut into; a group is joined cell by cell.
CELLS = 256


def with_totals(rows: DataFrame, group: str, spread_by: str, totals: dict[str, tuple[Column, callable]],
                cells: int = CELLS) -> DataFrame:
    """``rows`` with totals(name -> (aggregate of rows, function that combines such aggregates)) of their group.

    Rows are counted per group and cell first, so a group is at most ``cells`` rows when its
    cells are put together, and its rows meet the total under as many keys.
    """
    cell = F.pmod(F.xxhash64(spread_by), F.lit(cells)).alias("_cell")
    placed = rows.withColumn("_cell", cell)
    parts = placed.groupBy(group, "_cell").agg(*[made.alias(name) for name, (made, _) in totals.items()])
    whole = parts.groupBy(group).agg(
        F.collect_list("_cell").alias("_cells"), *[combine(name).alias(name) for name, (_, combine) in totals.items()])
    each = whole.select(group, F.explode("_cells").alias("_cell"), *totals)
    return placed.join(each, [group, "_cell"]).drop("_cell")
