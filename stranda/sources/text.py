"""Region, pedigree, sequence and read files as text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stranda.session import cut


def parse_interval(text: str) -> tuple[str, int, int]:
    """seq, seq:pos or seq:beg-end, 1-based and closed; a whole sequence reaches to 2**29 - 1."""
    m = re.fullmatch(r"(.+):(\d+)(?:-(\d+))?", text.strip().replace(",", ""))
    if not m:
        return text.strip(), 1, (1 << 29) - 1
    beg = int(m[2])
    end = int(m[3] or m[2])
    if beg < 1 or end < beg:
        raise ValueError(f"{text} is no interval")
    return m[1], beg, end


def intervals(spark: SparkSession, texts: list[str]) -> DataFrame:
    """chrom, beg1, end1 of a list of intervals, repeated ones once."""
    return spark.createDataFrame(list(dict.fromkeys(parse_interval(t) for t in texts)), "chrom string, beg1 int, end1 int")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, beg1, end1, name, score, strand; 0-based half-open lines become 1-based closed ones. Comments, track and
    browser lines and lines of fewer than three fields are no regions."""
    f = lambda i: F.get("f", F.lit(i))
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)")).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f")).where(F.size("f") >= 3)
    return rows.select(f(0).alias("chrom"), (f(1).try_cast("int") + 1).alias("beg1"), f(2).try_cast("int").alias("end1"), f(3).alias("name"), f(4).alias("score"), f(5).alias("strand"))


def read_gtf(spark: SparkSession, path: str, features: tuple[str, ...] = ("exon", "CDS", "start_codon", "stop_codon")) -> DataFrame:
    """chrom, source, feature, beg1, end1, strand, frame, attributes (name to value) of the features asked for."""
    f = lambda i: F.get("f", F.lit(i))
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where((F.size("f") >= 9) & f(2).isin(*features))
    pairs = F.transform(F.filter(F.split(f(8), r"\s*;\s*"), lambda x: x != ""), lambda x: F.struct(F.substring_index(F.trim(x), " ", 1).alias("k"), F.trim(F.translate(F.substr(F.trim(x), F.instr(F.trim(x), " ") + 1), '"', "")).alias("v")))
    once = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    return rows.select(F.regexp_replace(f(0), "^chr", "").alias("chrom"), f(1).alias("source"), f(2).alias("feature"), f(3).try_cast("int").alias("beg1"), f(4).try_cast("int").alias("end1"), f(6).alias("strand"), f(7).try_cast("int").alias("frame"), F.map_from_entries(once).alias("attributes"))


def read_ped(spark: SparkSession, path: str) -> DataFrame:
    """fam, ids (an individual and its duplicates), father, mother, sex; blanks or tabs between fields."""
    f = lambda i: F.get("f", F.lit(i))
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 4)
    sex = F.lower(f(4))
    return rows.select(f(0).alias("fam"), F.split(f(1), ",").alias("ids"), f(2).alias("father"), f(3).alias("mother"), F.when(sex.isin("1", "male", "m"), 1).when(sex.isin("2", "female", "f"), 2).otherwise(0).alias("sex"))


def read_dataset_list(spark: SparkSession, path: str) -> DataFrame:
    """label, type, filter, path of a list of reference data sets, one a line, fields between blanks."""
    f = lambda i: F.get("f", F.lit(i))
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") == 4)
    return rows.select(f(0).alias("label"), f(1).alias("type"), F.when(f(2) != "N/A", f(2)).alias("filter"), f(3).alias("path"))


def write_dataset_list(path: str, rows: list[tuple[str, str, str | None, str]]) -> None:
    """A list of reference data sets (label, type, filter, path) that read_dataset_list reads."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("# label type filter path\n")
        f.writelines(f"{label} {kind} {condition or 'N/A'} {place}\n" for label, kind, condition, place in rows)


PIECES = "file string, block long, seg int, name string, at long, bases string"


def read_fasta(spark: SparkSession, path: str, chunk_bits: int = 16) -> DataFrame:
    """chrom, chunk, seq: the sequences in upper case, in chunks of 2**chunk_bits bases.

    The scan cuts files where it likes, also amid a sequence: each block of a file gives pieces of about a chunk, counted
    from the last > line or the block's begin. How many bases of a sequence lie in earlier blocks comes from a window over
    one row a stretch, so no task holds a sequence. Lines before a file's first > line, and sequences without a name, are
    left out. The pieces are written once, since they are read for their lengths and for their bases.
    """
    size = 1 << chunk_bits

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, seg, name, at, held, n = None, 0, None, 0, [], 0
        out: list[tuple] = []
        for x in batches:
            for line, file, block in zip(x["value"], x["file"], x["block"]):
                fresh = (file, block) != here
                if (fresh or line.startswith(">")) and (held or name is not None):
                    out.append((*here, seg, name, at, "".join(held)))
                    held, n = [], 0
                if fresh:
                    here, seg, name, at = (file, block), 0, None, 0
                if line.startswith(">"):
                    seg, name, at = seg + 1, (line[1:].split() or [""])[0], 0
                    continue
                bases = "".join(line.split()).upper()
                held.append(bases)
                n += len(bases)
                if n >= size:
                    out.append((*here, seg, name, at, "".join(held)))
                    at, held, n = at + n, [], 0
            if out:
                yield pd.DataFrame(out, columns=["file", "block", "seg", "name", "at", "bases"])
                out = []
        if here is not None and (held or name is not None):
            yield pd.DataFrame([(*here, seg, name, at, "".join(held))], columns=["file", "block", "seg", "name", "at", "bases"])

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = cut(lines.mapInPandas(cut_up, PIECES))
    stretches = pieces.groupBy("file", "block", "seg").agg(F.max("name").alias("name"), F.sum(F.length("bases")).alias("n"))
    order = Window.partitionBy("file").orderBy("block", "seg")
    named = stretches.withColumn("chrom", F.last("name", ignorenulls=True).over(order)).withColumn("head", F.last(F.when(F.col("name").isNotNull(), F.struct("block", "seg")), ignorenulls=True).over(order))
    before = F.sum("n").over(Window.partitionBy("file", "head").orderBy("block", "seg").rowsBetween(Window.unboundedPreceding, -1))
    starts = named.withColumn("offset", F.coalesce(before, F.lit(0))).where("chrom <> ''").select("file", "block", "seg", "chrom", "offset")
    placed = pieces.where("bases <> ''").drop("name").join(starts, ["file", "block", "seg"]).withColumn("_b", F.col("offset") + F.col("at"))
    chunks = placed.select("file", "chrom", "_b", "bases", F.explode(F.sequence(F.shiftright("_b", chunk_bits), F.shiftright(F.col("_b") + F.length("bases") - 1, chunk_bits))).alias("chunk"))
    first = F.greatest(F.col("chunk") * size, F.col("_b"))
    part = F.substr("bases", (first - F.col("_b") + 1).cast("int"), ((F.col("chunk") + 1) * size - first).cast("int"))
    g = chunks.groupBy("file", "chrom", "chunk").agg(F.array_sort(F.collect_list(F.struct(first.alias("p"), part.alias("s")))).alias("x"))
    return g.select("chrom", "chunk", F.array_join(F.transform("x", lambda r: r["s"]), "").alias("seq"))


def subsequences(chunks: DataFrame, spans: DataFrame, chunk_bits: int = 16) -> DataFrame:
    """chrom, beg1, end1, seq of each interval; X where the reference has no such place."""
    from stranda.operators.records import reference_windows

    out = reference_windows(spans.select("chrom", "beg1", "end1"), chunks, F.col("beg1"), F.col("end1"), chunk_bits)
    return out.select("chrom", "beg1", "end1", F.when(F.length("window") > 0, F.col("window")).otherwise(F.lit("X")).alias("seq"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, chrom, pos, mapq, cigar, mate_chrom, mate_pos, seq, qual, md of each aligned line; null for `*`."""
    f = lambda i: F.get("f", F.lit(i))
    star = lambda c: F.nullif(c, F.lit("*"))
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 11)
    md = F.get(F.filter("f", lambda x: x.startswith("MD:Z:")), F.lit(0))
    return rows.select(f(0).alias("qname"), f(1).try_cast("int").alias("flag"), star(f(2)).alias("chrom"), f(3).try_cast("int").alias("pos"), f(4).try_cast("int").alias("mapq"), star(f(5)).alias("cigar"), F.when(f(6) == "=", f(2)).otherwise(star(f(6))).alias("mate_chrom"), f(7).try_cast("int").alias("mate_pos"), star(f(9)).alias("seq"), star(f(10)).alias("qual"), F.substr(md, F.lit(6)).alias("md"))
