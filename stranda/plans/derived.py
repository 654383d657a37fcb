"""Variant records made of the test tables, once as DataFrames and once as SQL for the oracle.

`calls` are the rows of genotype with their contig; `records` give every row of lineitem alleles of one to three bases,
so that places and alleles repeat within and between three files; `sampled` gives it a sample, a genotype and depths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stranda.session import beside, table, with_rid

KEY = "regexp_replace(lower(trim(chrom, ' ')), '^chr', '')"


def calls(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "genotype", "row_id", "file_id", "chrom", "pos", F.col("ref_allele").alias("ref"), F.coalesce("alt_alleles", F.array().cast("array<string>")).alias("alts"), "qual", "sample_id", "fmt", "val")
    gt = F.get(F.split("val", ":"), F.array_position(F.split("fmt", ":"), "GT") - 1)
    named = with_rid(g, table(spark, d, "contig", "rid", "contig_name"), "chrom")
    return named.withColumn("gt_text", gt).withColumn("gt", F.transform(F.split(gt, "[/|]"), lambda a: a.try_cast("int"))).withColumn("file_index", (F.col("file_id") % 3).cast("int"))


CALLS = f"""
calls AS (
  SELECT g.row_id, g.file_id, g.chrom, k.rid, g.pos, g.ref_allele AS ref, coalesce(g.alt_alleles, []) AS alts, g.qual, g.sample_id, g.fmt, g.val,
         string_split(g.val, ':')[list_position(string_split(g.fmt, ':'), 'GT')] AS gt_text, CAST(g.file_id % 3 AS INT) AS file_index
  FROM genotype g LEFT JOIN contig k ON lower(k.contig_name) = {KEY.replace('chrom', 'g.chrom')}
)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    letters = F.lit("ACGTACGTAC")
    x = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    length = lambda c: (c.cast("int") % 3 + 1).cast("int")
    return x.select(
        (F.col("l_suppkey") % 22).cast("int").alias("rid"),
        (F.col("l_partkey") + 1).cast("int").alias("pos"),
        F.substr(letters, (F.col("l_partkey") % 4 + 1).cast("int"), length(F.col("l_linenumber"))).alias("ref"),
        F.array(F.substr(letters, (F.col("l_orderkey") % 4 + 1).cast("int"), length(F.floor("l_quantity")))).alias("alts"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("file_index"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 50).alias("sample_id"),
        (F.floor("l_quantity") % 61).cast("float").alias("qual"),
        F.col("l_linenumber").alias("e"),
        F.floor("l_quantity").cast("int").alias("n"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"),
    )


RECORDS = """
records AS (
  SELECT CAST(l_suppkey % 22 AS INT) AS rid, CAST(l_partkey + 1 AS INT) AS pos,
         substr('ACGTACGTAC', CAST(l_partkey % 4 + 1 AS INT), CAST(l_linenumber % 3 + 1 AS INT)) AS ref,
         substr('ACGTACGTAC', CAST(l_orderkey % 4 + 1 AS INT), CAST(CAST(floor(l_quantity) AS INT) % 3 + 1 AS INT)) AS alt,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS file_index,
         's' || (l_suppkey % 50) AS sample_id, CAST(CAST(floor(l_quantity) AS BIGINT) % 61 AS FLOAT) AS qual,
         l_linenumber AS e, CAST(floor(l_quantity) AS INT) AS n
  FROM lineitem
)"""

# The trimmed form of a biallelic record and its class, in closed form.
CLASSED = """
cut AS (SELECT *, coalesce(list_filter(range(1, least(length(ref), length(alt))), lambda i: substr(ref, length(ref) - i + 1, 1) <> substr(alt, length(alt) - i + 1, 1))[1], least(length(ref), length(alt))) - 1 AS c FROM records),
skip AS (SELECT *, coalesce(list_filter(range(1, least(length(ref), length(alt)) - c), lambda i: substr(ref, i, 1) <> substr(alt, i, 1))[1], least(length(ref), length(alt)) - c) - 1 AS s FROM cut),
trim AS (SELECT *, substr(ref, CAST(s + 1 AS INT), CAST(length(ref) - c - s AS INT)) AS r, substr(alt, CAST(s + 1 AS INT), CAST(length(alt) - c - s AS INT)) AS a FROM skip),
meas AS (
  SELECT *, least(length(r), length(a)) AS mlen, length(a) - length(r) AS dlen,
         CASE WHEN length(r) > length(a) THEN a ELSE r END AS lone, CASE WHEN length(r) > length(a) THEN r ELSE a END AS lng,
         list_filter(range(1, least(length(r), length(a)) + 1), lambda i: substr(r, i, 1) <> substr(a, i, 1)) AS places
  FROM trim
),
pairs AS (
  SELECT *, CASE WHEN mlen = 1 AND dlen <> 0 THEN CASE WHEN lng[1] <> lone AND lng[-1] <> lone THEN [lng[1] || lone] ELSE [] END
                 ELSE list_transform(places, lambda i: substr(r, i, 1) || substr(a, i, 1)) END AS p
  FROM meas
),
classed AS (
  SELECT *, CASE WHEN ref = alt THEN 0 ELSE len(list_filter(p, lambda x: x IN ('AG', 'GA', 'CT', 'TC'))) END AS ts,
         CASE WHEN ref = alt THEN 0 ELSE len(p) - len(list_filter(p, lambda x: x IN ('AG', 'GA', 'CT', 'TC'))) END AS tv,
         CASE WHEN ref <> alt AND dlen > 0 THEN 1 ELSE 0 END AS ins, CASE WHEN ref <> alt AND dlen < 0 THEN 1 ELSE 0 END AS del,
         CASE WHEN ref = alt THEN 0 ELSE (CASE WHEN mlen = len(p) THEN CASE WHEN mlen = 1 THEN 1 ELSE 2 END ELSE 0 END)
           | (CASE WHEN dlen <> 0 THEN 4 ELSE 0 END) | (CASE WHEN len(p) > 0 AND len(p) < mlen THEN 8 ELSE 0 END) END AS t
  FROM pairs
),
variants AS (
  SELECT * EXCLUDE (t, p, places), CASE WHEN t <> 0 AND length(ref) = length(alt) AND length(ref) > 1 THEN t | 2 ELSE t END AS vtype FROM classed
)"""
NAMED = "CASE WHEN vtype = 0 THEN 'REF' ELSE concat_ws('/', CASE WHEN vtype & 1 <> 0 THEN 'SNP' END, CASE WHEN vtype & 2 <> 0 THEN 'MNP' END, CASE WHEN vtype & 4 <> 0 THEN 'INDEL' END, CASE WHEN vtype & 8 <> 0 THEN 'CLUMPED' END, CASE WHEN vtype & 16 <> 0 THEN 'VNTR' END, CASE WHEN vtype & 32 <> 0 THEN 'SV' END) END"


def regions(spark: SparkSession, d: str) -> DataFrame:
    b = with_rid(table(spark, d, "bed_record", "region_id", "chrom", "beg1", "end1", "region_name", "feature"), table(spark, d, "contig", "rid", "contig_name"), "chrom")
    return b.where("rid is not null and end1 >= beg1").withColumn("feature", F.lower(F.trim("feature"))).drop("chrom")


REGIONS = f"""
regions AS (
  SELECT region_id, c.rid, beg1, end1, region_name, lower(trim(feature)) AS feature
  FROM bed_record JOIN contig c ON lower(c.contig_name) = {KEY} WHERE end1 >= beg1
)"""


def sampled(spark: SparkSession, d: str) -> DataFrame:
    """pos, sample, k (0 to 29), g (copies of ALT), gt, dp and pl of thirty samples at the places of lineitem; of a
    sample's several rows at a place the one of the largest (g, dp)."""
    x = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    rows = x.select((F.col("l_partkey") + 1).cast("int").alias("pos"), (F.col("l_suppkey") % 30).cast("int").alias("k"), F.struct((F.col("l_linenumber") % 3).cast("int").alias("g"), F.floor("l_quantity").cast("int").alias("dp")).alias("x"))
    one = rows.groupBy("pos", "k").agg(F.max("x").alias("x")).select("pos", "k", "x.g", "x.dp")
    pl = F.array(*[F.abs(F.col("g") - i) * (F.col("dp") % 20 + 10) for i in range(3)])
    gt = F.array((F.col("g") > 1).cast("int"), (F.col("g") > 0).cast("int"))
    return one.select("pos", F.concat(F.lit("S"), "k").alias("sample"), "k", "g", gt.alias("gt"), "dp", pl.alias("pl"))


SAMPLED = """
srows AS (SELECT CAST(l_partkey + 1 AS INT) AS pos, CAST(l_suppkey % 30 AS INT) AS k, CAST(l_linenumber % 3 AS INT) AS g, CAST(floor(l_quantity) AS INT) AS dp FROM lineitem),
sbest AS (SELECT pos, k, max(g * 1000 + dp) AS x FROM srows GROUP BY pos, k),
sampled AS (SELECT pos, 'S' || k AS sample, k, CAST(x // 1000 AS INT) AS g, CAST(x % 1000 AS INT) AS dp FROM sbest)"""


def trios(spark: SparkSession) -> DataFrame:
    """The thirty samples as ten trios."""
    return spark.range(10).select(F.concat(F.lit("S"), F.col("id") * 3 + 2).alias("child"), F.concat(F.lit("S"), F.col("id") * 3).alias("father"), F.concat(F.lit("S"), F.col("id") * 3 + 1).alias("mother"))


BASE = "ACGT"


def reference(spark: SparkSession, d: str, chunk_bits: int = 10) -> DataFrame:
    """chrom, chunk, seq: a reference of 22 contigs long enough for the places of records; the base at p of contig c is
    letter (p // 3 + p // 7 + c) % 4 of ACGT, so that short stretches repeat."""
    size = 1 << chunk_bits
    longest = table(spark, d, "lineitem", "l_partkey").agg(((F.max("l_partkey") + 600) / size).cast("long").alias("m"))
    chunks = beside(spark.range(22).withColumnRenamed("id", "c"), longest).select("c", F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("chunk"))
    places = F.sequence(F.col("chunk") * size + 1, (F.col("chunk") + 1) * size)
    letter = lambda p: F.substr(F.lit(BASE), (F.floor(p / 3) + F.floor(p / 7) + F.col("c")).cast("int") % 4 + 1, F.lit(1))
    return chunks.select(F.col("c").cast("string").alias("chrom"), "chunk", F.array_join(F.transform(places, letter), "").alias("seq"))
