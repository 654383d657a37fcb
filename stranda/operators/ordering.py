"""Ordered neighbours without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stranda.session import Cut

BLOCK_BITS = 12


def with_previous(df: DataFrame, keys: Sequence[str], order: str, row: Column, out: str = "prev", tie: str | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """df with the column out: the value of row for the row just before in the order of the key, null for the first.

    A group is cut into blocks of 2**block_bits values of order. A block is sorted in one task; its first row gets the
    last row of the block before, which a window over one row a block finds. Rows with a null order come out without
    neighbours. tie breaks equal values of order.
    """
    o = F.col(order).cast("long")
    rows = df.withColumn("_row", row).withColumn("_ord", o).withColumn("_tie", F.col(tie).cast("long") if tie else F.lit(0).cast("long"))
    placed = rows.where(o.isNotNull()).withColumn("_blk", F.shiftright("_ord", block_bits))
    place = F.struct("_ord", "_tie")
    lasts = placed.groupBy(*keys, "_blk").agg(F.max_by("_row", place).alias("_row"))
    carry = lasts.withColumn("_row", F.lag("_row").over(Window.partitionBy(*keys).orderBy("_blk"))).where(F.col("_row").isNotNull())
    inside = Window.partitionBy(*keys, "_blk").orderBy(F.col("_ord").asc_nulls_first(), "_tie")
    both = placed.unionByName(carry, allowMissingColumns=True).withColumn(out, F.lag("_row").over(inside)).where(F.col("_ord").isNotNull())
    alone = rows.where(o.isNull()).withColumn(out, F.lit(None).cast(both.schema[out].dataType))
    return both.drop("_blk").unionByName(alone).drop("_row", "_ord", "_tie")


def pointer_doubling(links: DataFrame, group: str, node: str, pointer: str) -> DataFrame:
    """group, node, pointer: each node's pointer followed to the first node of its chain.

    links holds one row for each node that has a predecessor in its group. Each round replaces a pointer by the pointer
    of the node it points to, so a chain of n nodes takes log2(n) rounds, and rounds end once no pointer moved. Nodes at
    the head of a chain have no row and get none. Links must not form a ring.
    """
    p = Cut(links.select(F.col(group).alias("_g"), F.col(node).alias("_n"), F.col(pointer).alias("_p")))
    while True:
        here = p.df.select("_g", "_n", "_p")
        q = here.select(F.col("_g").alias("_qg"), F.col("_n").alias("_qn"), F.col("_p").alias("_qp"))
        step = here.join(q, (here["_g"] == q["_qg"]) & (here["_p"] == q["_qn"]), "left")
        moved = Cut(step.select("_g", "_n", F.coalesce("_qp", "_p").alias("_p"), F.col("_qp").isNotNull().alias("_moved")))
        p.drop()
        p = moved
        if moved.df.where("_moved").isEmpty():
            return moved.df.select(F.col("_g").alias(group), F.col("_n").alias(node), F.col("_p").alias(pointer))


def with_running_max(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "most", block_bits: int = BLOCK_BITS) -> DataFrame:
    """df with the column out: the largest value among the rows before a row in the order of its key, null for the first.

    Blocks and their carry are those of with_previous; rows of one order value count before none of each other. A null
    order has no place and a null out.
    """
    o = F.col(order).cast("long")
    placed = df.where(o.isNotNull()).withColumn("_ord", o).withColumn("_val", F.col(value)).withColumn("_blk", F.shiftright(o, block_bits))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = placed.groupBy(*keys, "_blk").agg(F.max("_val").alias("_val")).withColumn("_val", F.max("_val").over(earlier)).where(F.col("_val").isNotNull())
    inside = Window.partitionBy(*keys, "_blk").orderBy(F.coalesce("_ord", F.lit(-(2**62)))).rangeBetween(Window.unboundedPreceding, -1)
    both = placed.unionByName(carry, allowMissingColumns=True).withColumn(out, F.max("_val").over(inside)).where(F.col("_ord").isNotNull())
    return both.drop("_blk", "_ord", "_val").unionByName(df.where(o.isNull()).withColumn(out, F.lit(None).cast(df.schema[value].dataType)))


def sort_records(df: DataFrame, mode: str = "full", order: str = "row_id", window: int = 1000) -> DataFrame:
    """The records of df (rid, pos, order) sorted in ranges, each range in one task; null contigs come first.

    full: by contig and position. chrom: by contig, in input order within it. local: by contig and position as far as a
    window allows, with a column late: a record goes no farther back than `window` bases behind the largest position
    that stands before it in the input; where its own position lies farther back, it is late.
    """
    if mode == "full":
        by = ["rid", "pos", order]
    elif mode == "chrom":
        by = ["rid", order]
    elif mode == "local":
        df = with_running_max(df, ["rid"], order, "pos", "_most")
        df = df.withColumn("late", F.coalesce(F.col("pos") < F.col("_most") - window, F.lit(False))).withColumn("_at", F.greatest(F.col("pos"), F.col("_most") - window))
        return df.repartitionByRange("rid", "_at", "pos", order).sortWithinPartitions("rid", "_at", "pos", order).drop("_at", "_most")
    else:
        raise ValueError(f"no mode {mode}")
    return df.repartitionByRange(*by).sortWithinPartitions(*by)
