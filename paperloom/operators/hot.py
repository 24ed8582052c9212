"""Order within groups of any size: a group that holds a large part of all rows is cut before it is ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut_lineage

#: Rows of a group that one task may sort, and the slices of a group that has more.
HOT_ROWS, SLICES = 100_000, 256
#: Hot groups up to this many are sent to all executors (SLICES cut points each); beyond, an ordinary join.
BROADCAST_GROUPS = 1_000


def ranked(df: DataFrame, group: str, by: str, order: list[Column], name: str = "place", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with the place (from 1) of every row within its group; ``order`` must begin with ``by``, a number, nulls first.

    Groups above ``hot_rows`` (null is a group too) are cut at approximate quantiles of ``by``; rows are numbered within a
    slice, and the sizes of the slices before are added. Only groups with many rows of one and the same ``by`` stay whole.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    hot = cut_lineage(sizes.select(F.col(group).alias("_group")))
    n = hot.count()
    if not n:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    side = F.broadcast(hot) if n <= BROADCAST_GROUPS else hot
    same = F.col(group).eqNullSafe(F.col("_group"))
    shares = F.array(*(F.lit(k / SLICES) for k in range(1, SLICES)))
    cuts = cut_lineage(df.join(side, same, "left_semi").groupBy(F.col(group).alias("_group")).agg(F.array_distinct(F.percentile_approx(by, shares, F.lit(10 * SLICES))).alias("_cuts")))
    cuts = F.broadcast(cuts) if n <= BROADCAST_GROUPS else cuts
    slice_no = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(by))), F.lit(0))
    held = df.join(cuts, same, "left").withColumn("_slice", F.when(F.col("_cuts").isNotNull() & F.col(by).isNotNull(), slice_no).otherwise(0)).drop("_group", "_cuts")
    inside = held.withColumn("_at", F.row_number().over(Window.partitionBy(group, "_slice").orderBy(*order)))
    counts = held.groupBy(F.col(group).alias("_group"), F.col("_slice").alias("_other")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_group").orderBy("_other")) - F.col("_n")).where("_before > 0").drop("_n")
    counts = F.broadcast(counts) if n <= BROADCAST_GROUPS else counts
    out = inside.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_other")), "left")
    return out.withColumn(name, (F.col("_at") + F.coalesce("_before", F.lit(0))).cast("int")).drop("_slice", "_at", "_group", "_other", "_before")


def neighbourly(placed: DataFrame, place: str, back: int, rows: int = HOT_ROWS) -> DataFrame:
    """``placed`` in blocks of ``rows`` places: columns ``_block`` and ``_guest``. The last ``back`` rows of a block are guests of the next one, so windows over (group, _block) that look at most ``back`` rows back see what a window over the group would; drop the guests afterwards."""
    block = F.floor((F.col(place) - 1) / F.lit(rows))
    homes = F.when((F.col(place) - 1) % rows >= rows - back, F.array(block, block + 1)).otherwise(F.array(block))
    return placed.select("*", F.posexplode(homes).alias("_guest", "_block"))
