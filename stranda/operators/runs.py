"""Runs of the same tandem repeat listed several times in a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stranda.operators.ordering import pointer_doubling, with_previous

MAX_EDITS = 2


def is_rotation(a: Column, b: Column) -> Column:
    """True if one string is the other with its start moved (ACG, CGA, GAC)."""
    return (F.length(a) == F.length(b)) & F.contains(F.concat(a, a), b)


def _members(df: DataFrame, max_edits: int) -> tuple[DataFrame, DataFrame]:
    """The records, one for each vntr_id of a set; and of each record in a run the vntr_id of the run's first record."""
    fields = F.struct("ord", "rid", "motif", "ru", F.upper("repeat_tract").alias("tract"), "beg1", "end1")
    known = df.where(F.col("set_id").isNotNull() & F.col("vntr_id").isNotNull() & F.col("ord").isNotNull())
    rows = known.groupBy("set_id", "vntr_id").agg(F.min_by(fields, "row_id").alias("r")).select("set_id", "vntr_id", "r.*")
    own = F.struct("vntr_id", "rid", F.upper(F.coalesce("motif", "ru")).alias("unit"), "tract")
    seen = with_previous(rows, ["set_id"], "ord", own, tie="vntr_id").withColumn("_own", own)
    repeats = (
        (F.col("_own.rid") == F.col("prev.rid"))
        & is_rotation(F.col("_own.unit"), F.col("prev.unit"))
        & (F.abs(F.length("tract") - F.length("prev.tract")) <= max_edits)
        & F.levenshtein(F.col("tract"), F.col("prev.tract"), max_edits).between(0, max_edits)
    )
    links = seen.where(repeats).select("set_id", "vntr_id", F.col("prev.vntr_id").alias("first_id"))
    followers = pointer_doubling(links, "set_id", "vntr_id", "first_id")
    heads = followers.select("set_id", F.col("first_id").alias("vntr_id"), "first_id").distinct()
    return rows, followers.unionByName(heads)


def repeat_runs(df: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """set_id, first_id, last_id, n_records, n_bases of each run of two or more records that repeat the one before.

    df has the columns of vntr; others are not looked at. A record follows another in the order of ord within its
    set; a vntr_id delivered again counts once (the row of the least row_id stands for it). It repeats the one before if
    rid is the same, the units (motif, or ru if motif is null) are rotations of each other and at most max_edits
    single-base edits turn one repeat_tract into the other, case ignored. A null rid, unit or repeat_tract repeats
    nothing; a null set_id, vntr_id or ord has no place in any order and is left out; null positions don't count for
    n_bases, which is null if a run has none. Equal ords stand in the order of vntr_id.

    The method is pointer doubling: each repeating record points to its predecessor, and self-joins over three integer
    columns move all pointers to the first record of the run in log2(longest run) rounds.
    """
    members = _members(df, max_edits)[1]
    place = F.struct("ord", "vntr_id")
    known = df.where(F.col("set_id").isNotNull() & F.col("vntr_id").isNotNull() & F.col("ord").isNotNull())
    # The tracts have done their work: what is joined here are the places alone.
    narrow = known.groupBy("set_id", "vntr_id").agg(F.min_by(F.struct("ord", "beg1", "end1"), "row_id").alias("r")).select("set_id", "vntr_id", "r.*")
    return (
        members.join(narrow, ["set_id", "vntr_id"])
        .groupBy("set_id", "first_id")
        .agg(F.max_by("vntr_id", place).alias("last_id"), F.count("*").alias("n_records"), (F.max(F.col("end1").cast("long")) - F.min("beg1") + 1).alias("n_bases"))
        .select("set_id", "first_id", "last_id", "n_records", "n_bases")
    )


def collapsed(df: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """The table with each run as one record: fields of the run's first record, n_records, and the bases it covers.

    A record outside any run stands for itself with n_records 1. Rows are left out or merged as in repeat_runs.
    """
    rows, members = _members(df, max_edits)
    fields = ["rid", "motif", "ru", "ord", "beg1", "end1"]
    return (
        rows.join(members, ["set_id", "vntr_id"], "left")
        .withColumn("first_id", F.coalesce("first_id", "vntr_id"))
        .groupBy("set_id", "first_id")
        .agg(F.min_by(F.struct(*fields), F.struct("ord", "vntr_id")).alias("r"), F.count("*").alias("n_records"), F.min("beg1").alias("run_beg1"), F.max("end1").alias("run_end1"))
        .select("set_id", F.col("first_id").alias("vntr_id"), "r.rid", "r.motif", "r.ru", "r.ord", F.col("run_beg1").alias("beg1"), F.col("run_end1").alias("end1"), "n_records", (F.col("run_end1").cast("long") - F.col("run_beg1") + 1).alias("n_bases"))
    )
