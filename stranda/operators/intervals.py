"""Overlapping and gapped intervals: continuous periods and the gaps between them, and overlap joins.

A window over a whole entity would put a contig that holds a third of all rows into one task. Each entity is therefore
cut into blocks of 2**16 start positions. A block's own rows are sorted and labelled in one task, and what a block must
know of the blocks before it (the largest end so far, the island still open) comes from a window over one row a block.
Equal starts are merged before the first shuffle, so a block holds at most 65,536 rows and an entity at most 32,768
blocks, however the data are skewed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stranda.session import renamed

BLOCK_BITS = 16


def _islands(df: DataFrame, keys: Sequence[str], beg: str, end: str, block_bits: int, slack: int) -> tuple[list[str], DataFrame, DataFrame]:
    """The names of the keys in what follows; each different start with the block and label of its island (_blk, _isl); and
    the islands by block and label, with begin, end and the largest end before them (_b, _e, _prev)."""
    selected, k = renamed(df, keys, "_k")
    rows = df.select(*selected, df[beg].cast("long").alias("_b"), df[end].cast("long").alias("_e"))
    rows = rows.where(F.col("_b").isNotNull() & (F.col("_e") >= F.col("_b")))
    starts = rows.groupBy(*k, "_b").agg(F.max("_e").alias("_e")).withColumn("_blk", F.shiftright("_b", block_bits))

    # The largest end of all earlier blocks enters each block as a row that sorts before the block's own.
    before = Window.partitionBy(*k).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        starts.groupBy(*k, "_blk").agg(F.max("_e").alias("_e"))
        .withColumn("_e", F.max("_e").over(before))
        .where(F.col("_e").isNotNull())
        .select(*k, F.lit(None).cast("long").alias("_b"), "_e", "_blk")
    )
    inside = Window.partitionBy(*k, "_blk").orderBy(F.col("_b").asc_nulls_first())
    labelled = (
        starts.unionByName(carry)
        .withColumn("_prev", F.max("_e").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_first", F.col("_b").isNotNull() & (F.col("_prev").isNull() | (F.col("_b") > F.col("_prev") + slack)))
        .withColumn("_isl", F.sum(F.col("_first").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("_b").isNotNull())
    )
    pieces = labelled.groupBy(*k, "_blk", "_isl").agg(F.min("_b").alias("_b"), F.max("_e").alias("_e"), F.max(F.when(F.col("_first"), F.col("_prev"))).alias("_prev"))

    # Label 0 goes on with the island that was open at the end of the last block in which one began.
    summary = pieces.groupBy(*k, "_blk").agg(F.max("_isl").alias("_n"), F.max(F.when(F.col("_isl") == 0, F.col("_e"))).alias("_e0"))
    opened = F.last(F.when(F.col("_n") > 0, F.struct("_blk", "_n")), ignorenulls=True).over(before)
    heads = summary.withColumn("_open", opened)
    tails = (
        heads.where(F.col("_e0").isNotNull())
        .select(*k, F.col("_open._blk").alias("_blk"), F.col("_open._n").alias("_isl"), F.lit(None).cast("long").alias("_b"), F.col("_e0").alias("_e"), F.lit(None).cast("long").alias("_prev"))
    )
    islands = (
        pieces.where(F.col("_isl") > 0).unionByName(tails)
        .groupBy(*k, "_blk", "_isl").agg(F.min("_b").alias("_b"), F.max("_e").alias("_e"), F.max("_prev").alias("_prev"))
    )
    own = labelled.where(F.col("_isl") > 0).select(*k, "_b", "_blk", "_isl")
    carried = labelled.where(F.col("_isl") == 0).select(*k, "_b", "_blk").join(heads.where(F.col("_e0").isNotNull()).select(*[F.col(n).alias(f"{n}h") for n in k], F.col("_blk").alias("_blkh"), "_open"), reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"{n}h")) for n in k], F.col("_blk") == F.col("_blkh")))
    return k, own.unionByName(carried.select(*k, "_b", F.col("_open._blk").alias("_blk"), F.col("_open._n").alias("_isl"))), islands


def periods_and_gaps(df: DataFrame, keys: Sequence[str], beg: str = "beg1", end: str = "end1", block_bits: int = BLOCK_BITS, slack: int = 1) -> DataFrame:
    """keys, piece, beg1, end1: one row for each continuous period and for each gap between neighbouring periods.

    Intervals are closed. Two belong to one period if they share a base or one begins on the base after the other's end;
    slack is how many bases farther than the end a begin may lie, 0 for those alone that share a base.
    Rows with a null or reversed interval are left out; a null key is a key like any other; an empty table gives no
    rows; repeated rows change nothing. Other columns of df, whatever their names, are not looked at.
    """
    k, _, islands = _islands(df, keys, beg, end, block_bits, slack)
    piece = lambda name, b, e: F.struct(F.lit(name).alias("piece"), b.alias("beg1"), e.alias("end1"))
    both = F.array(piece("period", F.col("_b"), F.col("_e")), piece("gap", F.col("_prev") + 1, F.col("_b") - 1))
    return (
        islands.select(*[F.col(n).alias(c) for n, c in zip(k, keys)], F.explode(both).alias("_p"))
        .where(F.col("_p.end1") >= F.col("_p.beg1"))
        .select(*keys, "_p.piece", F.col("_p.beg1").cast("int").alias("beg1"), F.col("_p.end1").cast("int").alias("end1"))
    )


LEVELS = (5, 10, 15)


def overlap_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_span: tuple[str, str], right_span: tuple[str, str], levels: tuple[int, ...] = LEVELS, how: str = "inner") -> DataFrame:
    """Pairs of rows on one contig whose closed intervals share a base (how: inner, left_semi, left_anti).

    Bins have the sizes 2**level. An interval's own level is the least whose bins are no shorter than it; it stands in
    the bins of that level and of all above, and a pair meets at the larger of the two own levels. So short intervals
    are compared with short ones in short bins, long ones with what lies about them, and dense contigs cost what they
    overlap, not the square of a bin. Intervals longer than the largest bin stand in several. A pair that shares several
    bins is kept in the first of them, so nothing has to be made distinct. Rows with a null key or a null or reversed
    interval overlap nothing. Columns of left come out as they are, those of right with the prefix r_.

    Semi and anti joins ask for each different interval once whether it is hit, and left's rows are joined to the answer
    by their key and interval, values that don't depend on how left is read or partitioned.
    """
    lrow, rrow = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.struct(*[F.col(f"`{c}`") for c in right.columns])
    (lb, le), (rb, re_) = left_span, right_span
    ls = left.select(lrow.alias("_l"), F.col(left_key).alias("_k"), F.col(lb).cast("long").alias("_lb"), F.col(le).cast("long").alias("_le"))
    rs = right.select(rrow.alias("_r"), F.col(right_key).alias("_k"), F.col(rb).cast("long").alias("_rb"), F.col(re_).cast("long").alias("_re"))
    if how == "inner":
        return _meet(ls, rs, levels).select("_l.*", *[F.col(f"_r.`{c}`").alias(f"r_{c}") for c in right.columns])
    # A semi join only asks whether there is a hit: periods of the right side answer that, and don't overlap.
    merged = periods_and_gaps(rs, ["_k"], "_rb", "_re").where(F.col("piece") == "period").select("_k", F.col("beg1").cast("long").alias("_rb"), F.col("end1").cast("long").alias("_re"))
    spans = ls.select("_k", "_lb", "_le").distinct()
    return ls.join(_meet(spans, merged, levels).select("_k", "_lb", "_le").distinct(), ["_k", "_lb", "_le"], how).select("_l.*")


def _meet(ls: DataFrame, rs: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Pairs of ls (_k, _lb, _le) and rs (_k, _rb, _re) that overlap, with the other columns of both."""

    def binned(d: DataFrame, b: str, e: str, own: str) -> DataFrame:
        valid = d.where(F.col("_k").isNotNull() & F.col(b).isNotNull() & (F.col(e) >= F.col(b)))
        size = F.col(e) - F.col(b) + 1
        level = F.lit(levels[-1])
        for x in reversed(levels[:-1]):
            level = F.when(size <= 1 << x, x).otherwise(level)

        def cells(x: int):
            spot = lambda i: F.struct(F.lit(x).alias("_level"), i.alias("_bin"))
            return F.when(F.col(own) <= x, F.transform(F.sequence(F.shiftright(b, x), F.shiftright(e, x)), spot)).otherwise(F.array().cast("array<struct<_level:int,_bin:bigint>>"))

        return valid.withColumn(own, level).withColumn("_cell", F.explode(F.flatten(F.array(*[cells(x) for x in levels])))).select("*", "_cell._level", "_cell._bin").drop("_cell")

    touching = (F.col("_lb") <= F.col("_re")) & (F.col("_le") >= F.col("_rb")) & (F.greatest("_lown", "_rown") == F.col("_level"))
    first = F.lit(False)
    for x in levels:
        first = F.when(F.col("_level") == x, F.col("_bin") == F.shiftright(F.greatest("_lb", "_rb"), x)).otherwise(first)
    return binned(ls, "_lb", "_le", "_lown").join(binned(rs, "_rb", "_re", "_rown"), ["_k", "_level", "_bin"]).where(touching & first)


def overlap_flags(df: DataFrame, key: str, span: tuple[str, str], areas: DataFrame, flags: Sequence[str]) -> DataFrame:
    """df with a boolean column for each of flags: whether the row's closed interval overlaps an area of that flag.

    areas has key, flag, b and e, an area of several flags a row for each. All flags are worked out in one pass: areas
    are merged to periods by flag, each different interval of df meets them once, and rows get the answers by their key
    and interval. Rows with a null key or a null or reversed interval overlap nothing.
    """
    b, e = span
    periods = periods_and_gaps(areas, [key, "flag"], "b", "e").where(F.col("piece") == "period").select(F.col(key).alias("_k"), "flag", F.col("beg1").cast("long").alias("_rb"), F.col("end1").cast("long").alias("_re"))
    rows = df.withColumn("_k", F.col(key)).withColumn("_lb", F.col(b).cast("long")).withColumn("_le", F.col(e).cast("long"))
    names = [f"_flag{i}" for i in range(len(flags))]
    hits = _meet(rows.select("_k", "_lb", "_le").distinct(), periods)
    told = hits.groupBy("_k", "_lb", "_le").agg(*[F.max(F.col("flag") == f).alias(n) for f, n in zip(flags, names)])
    out = rows.join(told, ["_k", "_lb", "_le"], "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(n, F.lit(False)).alias(f) for f, n in zip(flags, names)])


def with_cluster(df: DataFrame, key: str, beg: str, end: str, slack: int = 0) -> DataFrame:
    """df with cluster_beg and cluster_end: the period of overlapping (or, with slack, near) rows a row belongs to.

    The periods come from the blocks of starts, each start knows the period it was labelled with, and the rows are joined
    to their starts, so no contig's rows meet in one task. Rows without a key or a valid interval are left out.
    """
    k, starts, islands = _islands(df.where(F.col(key).isNotNull()), [key], beg, end, BLOCK_BITS, slack)
    placed = starts.join(islands.select(*k, "_blk", "_isl", F.col("_b").cast("int").alias("cluster_beg"), F.col("_e").cast("int").alias("cluster_end")), [*k, "_blk", "_isl"])
    rows = df.where(F.col(end) >= F.col(beg)).withColumn(k[0], F.col(key)).withColumn("_b", F.col(beg).cast("long"))
    return rows.join(placed.select(*k, "_b", "cluster_beg", "cluster_end"), [*k, "_b"]).select(*df.columns, "cluster_beg", "cluster_end")
