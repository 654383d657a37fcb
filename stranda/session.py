"""Helpers that every operator shares: reading tables, cutting lineage, naming columns."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One test table; only the named columns reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, which spark.checkpoint.dir names. A folder of this machine takes its place only
    in a local session without that setting; on a cluster it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "stranda-checkpoints")
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session's end, or the table's, comes first
        return


class Cut:
    """Tables written to the shared folder: rows whose lineage is one read, so a lost executor loses none of them.

    Each table is written once, in one job, and stays until drop or the end of the session.
    """

    written: list[tuple[SparkSession, str]] = []

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{_shared_folder(self.spark)}/{uuid.uuid4().hex}"
        if not Cut.written:
            atexit.register(Cut.clean)
        Cut.written.append((self.spark, self.path))
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the table; nothing may read it any more."""
        _remove(self.spark, self.path)
        Cut.written.remove((self.spark, self.path))

    @staticmethod
    def clean() -> None:
        for spark, path in Cut.written:
            _remove(spark, path)
        Cut.written.clear()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with a lineage of one read, kept in the shared folder until the session ends."""
    return Cut(df).df


def renamed(df: DataFrame, columns: Sequence[str], prefix: str) -> tuple[list[Column], list[str]]:
    """Selectable columns under names of the operator's own, so that other columns of df can't clash with them."""
    names = [f"{prefix}{i}" for i in range(len(columns))]
    return [df[c].alias(n) for c, n in zip(columns, names)], names


def contig_key(chrom: Column | str) -> Column:
    """A chrom's spelling brought to one form: outer spaces dropped, case ignored, one leading chr dropped."""
    c = F.col(chrom) if isinstance(chrom, str) else chrom
    return F.regexp_replace(F.lower(F.trim(c)), "^chr", "")


def with_rid(df: DataFrame, contigs: DataFrame, chrom: str, out: str = "rid") -> DataFrame:
    """Adds the contig's rid by the spelling rule, null where chrom names no contig. Spark broadcasts the
    contig table where its size is within the threshold, as that of a genome's list of sequences is, and else joins by key."""
    small = contigs.select(F.lower("contig_name").alias("_contig_key"), F.col("rid").alias(out))
    keyed = df.withColumn("_contig_key", contig_key(chrom))
    return keyed.join(small, "_contig_key", "left").drop("_contig_key")


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a DataFrame of one row, such as a total, in every row: an equi-join with one broadcast row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row.limit(1).withColumn("_one", F.lit(1))), "_one").drop("_one")
