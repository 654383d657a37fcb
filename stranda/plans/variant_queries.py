"""The registered queries of the variant operators, one or more a command, with SQL for those SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stranda.functions import alleles as A
from stranda.functions import sequences as S
from stranda.functions.filters import compile_filter
from stranda.operators import cogroup, features, intervals, ordering, profiles, reads, records, regions, repeats
from stranda.plans.derived import CALLS, CLASSED, KEY, NAMED, RECORDS, REGIONS, SAMPLED, calls, reference, sampled, trios
from stranda.plans.derived import records as variant_rows
from stranda.plans.derived import regions as region_rows
from stranda.session import beside, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


big = lambda x: f"CAST({x} AS BIGINT)"
alt_list = "array_to_string(alts, ',')"
alts_text = lambda: F.array_join("alts", ",")
akey_sql = "concat_ws(',', ref, nullif(array_to_string(list_sort(alts), ','), ''))"


f_ref = lambda p, c="rid": f"'ACGT'[(({p}) // 3 + ({p}) // 7 + {c}) % 4 + 1]"
ref_seq = lambda b, e, c="rid": f"array_to_string(list_transform(range({b}, {e} + 1), lambda p: {f_ref('p', c)}), '')"
alone_sql = "v AS (SELECT DISTINCT rid, pos, ref, alt FROM records)"


# --- scans, filters, projections


@query(with_(CALLS) + f" SELECT row_id, rid, pos, ref, {alt_list} AS alt FROM calls WHERE qual > 30 AND len(alts) = 1 AND alts[1] NOT LIKE '<%' AND length(alts[1]) = 1 AND alts[1] <> ref")
def view(spark, d):
    """Records that meet a filter expression, sites only."""
    c = A.classified(calls(spark, d))
    return c.where(compile_filter("QUAL>30 && VTYPE==SNP && N_ALLELE==2", columns={"filters": "fmt", "info": "fmt"})).select("row_id", "rid", "pos", "ref", alts_text().alias("alt"))


@query(with_(CALLS, REGIONS) + " SELECT row_id, rid, pos FROM calls c WHERE EXISTS (SELECT 1 FROM regions r WHERE r.rid = c.rid AND r.feature = 'exon' AND c.pos <= r.end1 AND c.pos + length(c.ref) - 1 >= r.beg1)")
def view_regions(spark, d):
    """Records that overlap a region of a list."""
    return regions.select_regions(calls(spark, d).select("row_id", "rid", "pos", "ref"), region_rows(spark, d).where("feature = 'exon'")).select("row_id", "rid", "pos")


@query(with_(CALLS) + " SELECT row_id, rid, pos FROM calls WHERE rid IN (0, 19) AND pos BETWEEN 1000000 AND 90000000")
def view_intervals(spark, d):
    """Records inside intervals, pushed down to the scan as ranges of positions."""
    return calls(spark, d).where("rid in (0, 19) and pos between 1000000 and 90000000").select("row_id", "rid", "pos")


@query(with_(CALLS) + f" SELECT file_index, count(*) AS n, count(DISTINCT sample_id) AS n_samples, {big('sum(len(alts))')} AS n_alts FROM calls GROUP BY file_index")
def cat(spark, d):
    """Three files put after each other."""
    c = calls(spark, d)
    files = [c.where(F.col("file_index") == i).drop("file_index") for i in range(3)]
    return cogroup.stack(files).groupBy("file_index").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("n_samples"), F.sum(F.size("alts")).alias("n_alts"))


@query(with_(CALLS) + " SELECT row_id, rid, pos FROM calls")
def sort(spark, d):
    """All records in the order of contigs and positions: ranges of (rid, pos), each sorted in its task."""
    return ordering.sort_records(calls(spark, d).select("row_id", "rid", "pos"))


def inversions(df: DataFrame, *by: str) -> DataFrame:
    """n, n_inversions, n_overlaps: rows, rows that stand before a smaller one in their partition, and partitions that
    don't begin behind the one before."""
    key = F.struct(*by)
    at = df.select(key.alias("k"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    rows = at.withColumn("bad", F.lag("k").over(Window.partitionBy("p").orderBy("i")) > F.col("k"))
    parts = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("bad"), F.lit(False)).cast("long")).alias("b"), F.min("k").alias("low"), F.max("k").alias("high"))
    last = F.max("high").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))  # over one row a partition
    return parts.withColumn("o", F.coalesce(last > F.col("low"), F.lit(False)).cast("long")).agg(F.sum("n").alias("n"), F.sum("b").alias("n_inversions"), F.sum("o").alias("n_overlaps"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_inversions, CAST(0 AS BIGINT) AS n_overlaps FROM genotype")
def sort_order(spark, d):
    """The order that sort leaves, looked at inside and between its partitions."""
    return inversions(sort(spark, d), "rid", "pos", "row_id")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_inversions, CAST(0 AS BIGINT) AS n_overlaps FROM genotype")
def sort_chrom(spark, d):
    """Records by contig, in input order within each: the order it leaves."""
    return inversions(ordering.sort_records(calls(spark, d).select("row_id", "rid", "pos"), "chrom"), "rid", "row_id")


@query(with_(CALLS) + ", m AS (SELECT row_id, rid, pos, max(pos) OVER (PARTITION BY rid ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM calls) SELECT row_id, rid, pos, coalesce(pos < most - 10000000, false) AS late FROM m")
def sort_local(spark, d):
    """Records in order as far as a window of ten million bases allows, those that come too late for it marked."""
    return ordering.sort_records(calls(spark, d).select("row_id", "rid", "pos"), "local", window=10_000_000)


@query("SELECT rid, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM (" + with_(CALLS) + " SELECT * FROM calls) GROUP BY rid")
def index(spark, d):
    """What an index of a sorted file holds for each contig."""
    return calls(spark, d).groupBy("rid").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(with_(CALLS) + """ SELECT row_id, chrom, pos, ref, array_to_string(alts, ',') AS alt, len(alts) + 1 AS n_allele,
 CASE WHEN qual > 30 THEN 1 ELSE 0 END AS pass_qual, string_split(val, ':')[nullif(coalesce(list_position(string_split(fmt, ':'), 'DP'), 0), 0)] AS dp FROM calls""")
def info2tab(spark, d):
    """Records as a wide table: fixed fields, filters as 0 and 1, tags as columns."""
    c = calls(spark, d)
    dp = F.get(F.split("val", ":"), F.array_position(F.split("fmt", ":"), "DP") - 1)
    return c.select("row_id", "chrom", "pos", "ref", alts_text().alias("alt"), (F.size("alts") + 1).cast("long").alias("n_allele"), compile_filter("QUAL>30", columns={"info": "fmt"}).cast("int").alias("pass_qual"), dp.alias("dp"))


@query(with_(CALLS) + ", t AS (SELECT row_id, unnest(string_split(fmt, ':')) AS k, generate_subscripts(string_split(fmt, ':'), 1) AS i FROM calls) SELECT c.row_id, coalesce(string_agg(k, ':' ORDER BY i) FILTER (k NOT IN ('PL', 'NM', 'ST')), '') AS fmt FROM calls c LEFT JOIN t ON t.row_id = c.row_id GROUP BY c.row_id")
def rminfo(spark, d):
    """Records without some tags."""
    c = calls(spark, d).withColumn("format_keys", F.split("fmt", ":"))
    return records.remove_fields(c, format_=("PL", "NM", "ST")).select("row_id", F.array_join("format_keys", ":").alias("fmt"))


@query(with_(CALLS) + " SELECT row_id, CASE WHEN qual < 20 THEN 'low' ELSE '' END AS filters FROM calls")
def filter(spark, d):  # noqa: A001
    """All records, those that meet an expression tagged."""
    c = calls(spark, d).withColumn("filters", F.array().cast("array<string>"))
    return records.add_filter(c, compile_filter("QUAL<20", columns={"info": "fmt"}), "low").select("row_id", F.array_join("filters", ";").alias("filters"))


EXPRESSIONS = {
    "QUAL>30 && N_ALLELE==2 || QUAL<5": "coalesce(qual > 30, false) AND (len(alts) = 1 OR coalesce(qual < 5, false))",
    "~(VTYPE==SNP)": "vtype <> 1",
    "(QUAL+10)*2 > 100": "coalesce((CAST(qual AS DOUBLE) + 10) * 2 > 100, false)",
    "DLEN>1": "coalesce(dlen > 1, false)",
    "LEN==1": "coalesce(abs(dlen) = 1, false)",
    "VTYPE & INDEL": "vtype & 4 <> 0",
    "(VTYPE | SNP) == 5": "vtype | 1 = 5",
    "REF =~ '^[AC]'": "coalesce(regexp_matches(ref, '^[AC]'), false)",
    "ALT ~~ 'G'": "NOT regexp_matches(array_to_string(alts, ','), 'G')",
    "QUAL-10-5 > 20": "coalesce(CAST(qual AS DOUBLE) - (10 - 5) > 20, false)",
    "QUAL/2 > 20": "coalesce(CAST(qual AS DOUBLE) / 2 > 20, false)",
    "~(QUAL>=10) && VARIANT_CONTAINS_N || N_ALLELE>=3": "NOT coalesce(qual >= 10, false) AND (has_n OR len(alts) >= 2)",
}


@query(with_(CALLS) + """, a AS (SELECT *, list_filter(alts, lambda x: x <> ref AND NOT starts_with(x, '.')) AS kept, ref LIKE '%N%' OR len(list_filter(alts, lambda x: x NOT LIKE '%<%' AND x LIKE '%N%')) > 0 AS has_n FROM calls),
t AS (SELECT *, CASE WHEN len(list_filter(kept, lambda x: x = '<VNTR>')) > 0 THEN 16 ELSE 0 END | CASE WHEN len(list_filter(kept, lambda x: x NOT LIKE '<%' AND (length(x) = 1 OR substr(x, 1, 1) <> ref AND substr(x, length(x), 1) <> ref))) > 0 THEN 1 ELSE 0 END
  | CASE WHEN len(list_filter(kept, lambda x: x NOT LIKE '<%' AND length(x) > 1)) > 0 THEN 4 ELSE 0 END AS vtype, CASE WHEN kept[1] LIKE '<%' THEN 0 ELSE length(kept[1]) - length(ref) END AS dlen FROM a)
SELECT row_id, """ + " || ".join(f"CASE WHEN {sql} THEN '1' ELSE '0' END" for sql in EXPRESSIONS.values()) + " AS kept FROM t")
def filter_language(spark, d):
    """Which of a dozen expressions, of every operator and most fields, keep each record."""
    c = A.classified_once(calls(spark, d), ("alleles", "vtype", "contains_n"))
    return c.select("row_id", F.concat(*[F.when(compile_filter(e, columns={"filters": "fmt", "info": "fmt"}), "1").otherwise("0") for e in EXPRESSIONS]).alias("kept"))


# --- classification


@query(with_(RECORDS, CLASSED) + f" SELECT {NAMED} AS vt, CAST(1 AS BIGINT) AS n_alt, count(*) AS n, {big('sum(ts)')} AS ts, {big('sum(tv)')} AS tv, {big('sum(ins)')} AS ins, {big('sum(del)')} AS del FROM variants GROUP BY ALL")
def classify(spark, d):
    """Types and measures of biallelic records of all lengths."""
    p = profiles.peek(variant_rows(spark, d)).where("vt is not null and n_alt is not null")
    return p.withColumn("n_alt", F.col("n_alt").cast("long"))


@query(with_(CALLS) + """, a AS (SELECT row_id, ref, alts, list_filter(alts, lambda x: x <> ref AND NOT starts_with(x, '.')) AS kept FROM calls),
t AS (SELECT *, CASE WHEN len(list_filter(kept, lambda x: x = '<VNTR>')) > 0 THEN 16 ELSE 0 END | CASE WHEN len(list_filter(kept, lambda x: x NOT LIKE '<%' AND length(x) = 1)) > 0 THEN 1 ELSE 0 END
  | CASE WHEN len(list_filter(kept, lambda x: x NOT LIKE '<%' AND length(x) > 1)) > 0 THEN 4 ELSE 0 END
  | CASE WHEN len(list_filter(kept, lambda x: x NOT LIKE '<%' AND length(x) > 1 AND substr(x, 1, 1) <> ref AND substr(x, length(x), 1) <> ref)) > 0 THEN 1 ELSE 0 END AS vtype,
  list_filter(kept, lambda x: x NOT LIKE '<%') AS ex FROM a),
m AS (SELECT *, len(list_filter(ex, lambda x: (length(x) = 1 AND ref || x IN ('AG', 'GA', 'CT', 'TC')) OR (length(x) > 1 AND substr(x, 1, 1) <> ref AND substr(x, length(x), 1) <> ref AND substr(x, 1, 1) || ref IN ('AG', 'GA', 'CT', 'TC')))) AS ts,
  len(list_filter(ex, lambda x: (length(x) = 1 AND ref || x NOT IN ('AG', 'GA', 'CT', 'TC')) OR (length(x) > 1 AND substr(x, 1, 1) <> ref AND substr(x, length(x), 1) <> ref AND substr(x, 1, 1) || ref NOT IN ('AG', 'GA', 'CT', 'TC')))) AS tv,
  len(list_filter(ex, lambda x: length(x) > 1)) AS ins FROM t)
SELECT """ + NAMED + f""" AS vt, CAST(least(len(alts), 4) AS INT) AS n_alt, count(*) AS n, {big('sum(ts)')} AS ts, {big('sum(tv)')} AS tv, {big('sum(ins)')} AS ins, CAST(0 AS BIGINT) AS del FROM m GROUP BY ROLLUP (1, 2)""")
def peek(spark, d):
    """Counts by type and number of ALTs, with sums over each."""
    return profiles.peek(calls(spark, d))


@query(with_(CALLS) + f" SELECT row_id, chrom || ':' || pos || ':' || concat_ws('/', ref, nullif(array_to_string(alts, '/'), '')) AS key, {akey_sql} AS akey FROM calls WHERE len(alts) > 0")
def variant_keys(spark, d):
    """Keys of variants, with ALTs in their order and in byte order."""
    c = calls(spark, d).where(F.size("alts") > 0)
    return c.select("row_id", A.variant_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alts")).alias("key"), A.allele_key(F.col("ref"), F.col("alts")).alias("akey"))


@query(with_(RECORDS) + " SELECT ref, alt, (right(ref, 1) <> right(alt, 1)) AND NOT (length(ref) > 1 AND length(alt) > 1 AND left(ref, 1) = left(alt, 1)) AS normal, count(*) AS n FROM records GROUP BY ALL")
def is_normalized(spark, d):
    """Which pairs of alleles are in normal form."""
    return variant_rows(spark, d).select("ref", F.get("alts", F.lit(0)).alias("alt"), A.is_normalized(F.col("ref"), F.col("alts")).alias("normal")).groupBy("ref", "alt", "normal").agg(F.count("*").alias("n"))


@query(with_(CALLS, REGIONS) + """, v AS (SELECT row_id, rid, pos, pos + length(ref) - 1 AS e, ref, alts FROM calls WHERE len(alts) = 1 AND alts[1] NOT LIKE '<%' AND alts[1] <> ref)
SELECT row_id, CASE WHEN length(alts[1]) = 1 THEN 'SNP' WHEN substr(alts[1], 1, 1) <> ref AND substr(alts[1], length(alts[1]), 1) <> ref THEN 'SNP/INDEL' ELSE 'INDEL' END AS vt,
 EXISTS (SELECT 1 FROM regions r WHERE r.rid = v.rid AND r.feature IN ('lcr', 'dust') AND v.pos <= r.end1 AND v.e >= r.beg1) AS lc,
 CASE WHEN length(alts[1]) > 1 AND EXISTS (SELECT 1 FROM regions r WHERE r.rid = v.rid AND r.feature = 'cds' AND v.pos <= r.end1 AND v.e >= r.beg1) THEN CASE WHEN (length(alts[1]) - 1) % 3 <> 0 THEN 'FS1' ELSE 'NFS' END END AS fs FROM v""")
def annotate_variants(spark, d):
    """Types, low complexity and frame shifts of biallelic records."""
    r = region_rows(spark, d)
    v = calls(spark, d).where(F.size("alts") == 1).where(~A.is_symbolic(F.get("alts", F.lit(0))) & (F.get("alts", F.lit(0)) != F.col("ref")))
    return records.annotate_types(v, r.where("feature in ('lcr', 'dust')"), r.where("feature = 'cds'")).select("row_id", "vt", "lc", "fs")


@query(with_(CALLS, REGIONS) + """ SELECT row_id, EXISTS (SELECT 1 FROM regions r WHERE r.rid = c.rid AND c.pos <= r.end1 AND c.pos >= r.beg1) AS hit,
 EXISTS (SELECT 1 FROM regions r WHERE r.rid = c.rid AND c.pos <= r.beg1 - 1 AND c.pos >= r.beg1 - 100) AS hit_left,
 EXISTS (SELECT 1 FROM regions r WHERE r.rid = c.rid AND c.pos <= r.end1 + 50 AND c.pos >= r.end1 + 1) AS hit_right FROM calls c""")
def annotate_regions(spark, d):
    """Flags for regions and their margins."""
    return regions.annotate_regions(calls(spark, d).select("row_id", "rid", "pos", "ref"), region_rows(spark, d), "hit", 100, 50).select("row_id", "hit", "hit_left", "hit_right")


@query(SQL["view_regions"])
def view_regions_repartitioned(spark, d):
    """view_regions of records that were dealt out anew: the answer doesn't hang on the partitions."""
    return regions.select_regions(calls(spark, d).select("row_id", "rid", "pos", "ref").repartition(11), region_rows(spark, d).where("feature = 'exon'").repartition(3)).select("row_id", "rid", "pos")


@query(SQL["annotate_regions"])
def annotate_regions_repartitioned(spark, d):
    """annotate_regions of records that were dealt out anew."""
    return regions.annotate_regions(calls(spark, d).select("row_id", "rid", "pos", "ref").repartition(11), region_rows(spark, d).repartition(3), "hit", 100, 50).select("row_id", "hit", "hit_left", "hit_right")


# --- rewrites


@query(with_(CALLS) + """, x AS (SELECT row_id, chrom, pos, ref, alts, string_split_regex(gt_text, '[/|]') AS g, len(alts) AS n, unnest(range(1, len(alts) + 1)) AS i FROM calls WHERE len(alts) > 0)
SELECT row_id, CAST(i AS INT) AS alt_index, pos, ref, alts[i] AS alt, CASE WHEN n > 1 THEN chrom || ':' || pos || ':' || ref || '/' || array_to_string(alts, '/') END AS old_multiallelic,
 array_to_string(list_transform(g, lambda a: CASE WHEN try_cast(a AS INT) IS NULL THEN '.' WHEN n = 1 THEN a WHEN try_cast(a AS INT) = i THEN '1' WHEN a = '0' THEN '0' ELSE '.' END), '/') AS gt FROM x""")
def decompose(spark, d):
    """One row an ALT, genotypes rewritten."""
    c = calls(spark, d).where(F.size("alts") > 0).drop("gt_text")
    out = records.decompose(c)
    return out.select("row_id", "alt_index", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), "old_multiallelic", F.array_join(F.transform("gt", lambda a: a.cast("string")), "/", ".").alias("gt"))


@query(with_(RECORDS) + """, x AS (SELECT pos, ref, alt, unnest(list_filter(range(1, length(ref) + 1), lambda i: substr(ref, i, 1) <> substr(alt, i, 1))) AS i,
 list_filter(range(1, length(ref) + 1), lambda i: substr(ref, i, 1) <> substr(alt, i, 1))[1] AS f FROM records WHERE length(ref) = length(alt) AND length(ref) > 1)
SELECT CAST(pos + i - 1 AS INT) AS pos, substr(ref, CAST(i AS INT), 1) AS ref, substr(alt, CAST(i AS INT), 1) AS alt, CAST(pos + f - 1 AS INT) AS phase_set, count(*) AS n FROM x GROUP BY ALL""")
def decompose_blocksub(spark, d):
    """Block substitutions as their mismatches."""
    v = variant_rows(spark, d).withColumn("chrom", F.col("rid").cast("string"))
    out = records.decompose_blocks(v).where("old_clumped is not null")
    return out.groupBy("pos", "ref", F.get("alts", F.lit(0)).alias("alt"), "phase_set").agg(F.count("*").alias("n"))


@query()
def decompose_aligned(spark, d):
    """Records of uneven lengths as the pieces of their alignment."""
    v = variant_rows(spark, d).select(F.col("rid").cast("string").alias("chrom"), "pos", "ref", "alts").distinct()
    return records.decompose_aligned(v)


@query(with_(RECORDS, f"v AS (SELECT DISTINCT rid, pos, {ref_seq('pos', 'pos + 3')} AS ref FROM records)", f"""
n AS (SELECT *, coalesce(list_filter(range(0, pos - 1), lambda j: {f_ref('pos - j')} <> {f_ref('pos + 3 - j')})[1], pos - 1) AS s FROM v)""") + f" SELECT CAST(rid AS VARCHAR) AS chrom, rid, CAST(pos - s AS INT) AS pos, {ref_seq('pos - s', 'pos - s + 3')} AS ref, {f_ref('pos - s')} AS alt, CASE WHEN s > 0 THEN rid || ':' || pos || ':' || ref || '/' || ref[1] END AS old_variant, CASE WHEN s > 0 THEN 'rt_la' END AS change, false AS ref_mismatch FROM n")
def normalize(spark, d):
    """Left-aligned parsimonious records over a chunked reference: the indels that the reference's own repeats offer."""
    ref = reference(spark, d)
    v = variant_rows(spark, d).select(F.col("rid").cast("string").alias("chrom"), "rid", "pos").distinct()
    w = records.reference_windows(v, ref, F.col("pos"), F.col("pos") + 4, 10)
    made = w.select("chrom", "rid", "pos", F.substr("window", F.lit(1), F.lit(4)).alias("ref"), F.array(F.substr("window", F.lit(1), F.lit(1))).alias("alts"))
    return records.normalize(made, ref, chunk_bits=10, flank=64).withColumn("alts", alts_text()).withColumnRenamed("alts", "alt")


@query(with_(RECORDS) + f" SELECT DISTINCT CAST(rid AS VARCHAR) AS chrom, pos AS beg1, CAST(pos + 29 AS INT) AS end1, {ref_seq('pos', 'pos + 29')} AS seq FROM records")
def seq(spark, d):
    """Stretches of the reference."""
    from stranda.sources.text import subsequences

    v = variant_rows(spark, d).select(F.col("rid").cast("string").alias("chrom"), F.col("pos").alias("beg1"), (F.col("pos") + 29).alias("end1")).distinct()
    return subsequences(reference(spark, d), v, 10)


@query(with_(RECORDS, alone_sql, f"w AS (SELECT *, {ref_seq('greatest(pos - 4, 1)', 'pos - 1')} AS l, {ref_seq('pos + length(ref)', 'pos + 4')} AS r FROM v)") + " SELECT CAST(rid AS VARCHAR) AS chrom, CAST(greatest(pos - 4, 1) AS INT) AS pos, l || ref || r AS ref, l || alt || r AS alt, 'within' AS set_ref FROM w")
def set_ref(spark, d):
    """Records inside a tract widened to it."""
    v = variant_rows(spark, d).select(F.col("rid").cast("string").alias("chrom"), "pos", "ref", "alts").distinct()
    v = v.withColumn("tract", F.struct((F.col("pos") - 3).alias("beg"), (F.col("pos") + 3).alias("end")))
    return records.widen_to_tract(v, reference(spark, d), "tract", 10).select("chrom", "pos", "ref", alts_text().alias("alt"), "set_ref")


@query(with_(RECORDS, alone_sql, f"w AS (SELECT *, {ref_seq('greatest(pos - 20, 1)', 'pos - 1')} AS l, {ref_seq('pos + length(ref)', 'pos + length(ref) + 79')} AS r FROM v)", """
h AS (SELECT *, l || ref || r AS h1, l || alt || r AS h2 FROM w), m AS (SELECT *, least(length(h1), length(h2)) AS n FROM h),
t AS (SELECT *, greatest(coalesce(list_filter(range(1, n), lambda i: h1[i] <> h2[i])[1], n), 21) AS p FROM m), k AS (SELECT *, CASE WHEN h1 <> h2 AND p <= n THEN CAST(p AS INT) END AS plen FROM t)""") + " SELECT CAST(rid AS VARCHAR) AS chrom, pos, ref, alt, substr(h1, 1, plen) AS ref_probe, substr(h2, 1, plen) AS alt_probe, plen FROM k")
def construct_probes(spark, d):
    """Probes that tell a record's alleles apart."""
    v = variant_rows(spark, d).select(F.col("rid").cast("string").alias("chrom"), "pos", "ref", "alts").distinct()
    return records.probes(v, reference(spark, d), 20, 10).select("chrom", "pos", "ref", alts_text().alias("alt"), "ref_probe", F.get("alt_probes", F.lit(0)).alias("alt_probe"), "plen")


@query(with_(CALLS) + """, l AS (SELECT *, pos + length(ref) - 1 AS e, max(pos + length(ref) - 1) OVER (PARTITION BY rid ORDER BY pos, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM calls WHERE rid IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR pos > prev THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos, row_id ROWS UNBOUNDED PRECEDING) AS isl FROM l)
SELECT rid, arg_min(row_id, (pos, row_id)) AS row_id, min(pos) AS pos, count(*) AS n_cluster, CASE WHEN count(*) > 1 THEN 'overlap' END AS overlap_filter FROM i GROUP BY rid, isl""")
def filter_overlap(spark, d):
    """First records of clusters, tagged where others overlap."""
    return regions.first_of_overlaps(calls(spark, d).select("row_id", "rid", "pos", "ref"), "row_id").select("rid", "row_id", "pos", "n_cluster", "overlap_filter")


@query(with_(RECORDS, f"u AS (SELECT DISTINCT rid, pos, length(ref) AS w, alt FROM records), v AS (SELECT rid, pos, pos + w - 1 AS e, {ref_seq('pos', 'pos + w - 1')} AS ref, alt FROM u WHERE {ref_seq('pos', 'pos + w - 1')} <> alt)", """
l AS (SELECT *, max(e) OVER (PARTITION BY rid ORDER BY pos, e, alt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR pos > prev THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos, e, alt ROWS UNBOUNDED PRECEDING) AS isl FROM l),
c AS (SELECT rid, isl, min(pos) AS cb, max(e) AS ce, string_agg(rid || ':' || pos || ':' || ref || '/' || alt, ',' ORDER BY pos, ref, alt) AS constituents FROM i GROUP BY ALL HAVING count(*) > 1)""", f"""
m AS (SELECT c.*, {ref_seq('cb', 'ce', 'c.rid')} AS span, {ref_seq('cb', 'i.pos - 1', 'c.rid')} || i.alt || {ref_seq('i.e + 1', 'ce', 'c.rid')} AS a FROM c JOIN i ON i.rid = c.rid AND i.isl = c.isl),
k AS (SELECT *, coalesce(list_filter(range(1, least(length(span), length(a))), lambda x: span[x] <> a[x])[1], least(length(span), length(a))) - 1 AS cut FROM m),
t AS (SELECT *, min(cut) OVER (PARTITION BY rid, isl) AS least_cut FROM k)""") + " SELECT rid, CAST(cb + least_cut AS INT) AS pos, substr(span, CAST(least_cut + 1 AS INT)) AS ref, string_agg(DISTINCT substr(a, CAST(least_cut + 1 AS INT)), ',' ORDER BY substr(a, CAST(least_cut + 1 AS INT))) AS alt, constituents FROM t GROUP BY ALL")
def consolidate_multiallelics(spark, d):
    """Overlapping biallelic records that agree with one reference as one multi-allelic record."""
    ref = reference(spark, d)
    v = variant_rows(spark, d).select(F.col("rid").cast("string").alias("chrom"), "rid", "pos", F.length("ref").alias("w"), "alts").distinct()
    w = records.reference_windows(v, ref, F.col("pos"), F.col("pos") + F.col("w") - 1, 10)
    merged = regions.merge_overlapping(w.select("rid", "pos", F.col("window").alias("ref"), "alts").where("ref <> alts[0]"))
    return merged.select("rid", "pos", "ref", F.array_join(F.array_sort("alts"), ",").alias("alt"), "constituents")


@query(with_(RECORDS, CLASSED) + """, u AS (SELECT rid, pos, ref, alt, any_value(vtype) AS vtype FROM variants WHERE vtype <> 0 GROUP BY ALL)
, o AS (SELECT a.rid, a.pos, a.ref, a.alt, count(CASE WHEN b.vtype & 1 <> 0 THEN 1 END) AS n_snp, count(CASE WHEN b.vtype & 4 <> 0 THEN 1 END) AS n_indel FROM u a LEFT JOIN u b ON a.rid = b.rid AND a.pos <= b.pos + length(b.ref) - 1 AND a.pos + length(a.ref) - 1 >= b.pos AND NOT (a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt) GROUP BY ALL)
SELECT rid, pos, ref, alt, CAST(n_snp AS INT) AS n_snp, CAST(n_indel AS INT) AS n_indel, concat_ws(';', CASE WHEN n_snp > 0 THEN 'overlap_snp' END, CASE WHEN n_indel > 0 THEN 'overlap_indel' END) AS filters FROM o""")
def consolidate(spark, d):
    """Records with the kinds of records that overlap them."""
    v = A.classified_once(variant_rows(spark, d).select("rid", "pos", "ref", "alts").distinct(), ("vtype",)).where("vtype <> 0")
    out = regions.overlap_filters(v)
    return out.select("rid", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), F.get("overlaps", F.lit(0)).alias("n_snp"), F.get("overlaps", F.lit(1)).alias("n_indel"), F.array_join("filters", ";").alias("filters"))


@query(with_(RECORDS) + " SELECT rid, pos, ref, string_agg(DISTINCT alt, ',' ORDER BY alt) AS alt FROM records WHERE length(ref) = 1 AND length(alt) = 1 AND ref <> alt GROUP BY ALL HAVING count(DISTINCT alt) > 1")
def consolidate_snps(spark, d):
    """SNPs of one place as one multi-allelic record."""
    return regions.multiallelic_snps(variant_rows(spark, d)).select("rid", "pos", "ref", alts_text().alias("alt"))


@query(with_(RECORDS) + " SELECT DISTINCT ref, alt, CAST(levenshtein(ref, alt) AS INT) AS distance, CAST(levenshtein(ref, alt) AS INT) AS columns_apart, true AS whole FROM records")
def align(spark, d):
    """Global alignments of all different pairs of alleles: how far apart, in how many columns the aligned strings differ,
    and whether they give the alleles back without their gaps."""
    from stranda.operators.records import alignments

    x = alignments(variant_rows(spark, d).select("ref", F.get("alts", F.lit(0)).alias("alt")).distinct())
    apart = F.size(F.filter(F.arrays_zip(F.split("ref_aligned", "").alias("a"), F.split("alt_aligned", "").alias("b")), lambda p: ~p["a"].eqNullSafe(p["b"])))
    bare = lambda c: F.translate(c, "-", "")
    return x.select("ref", "alt", "distance", apart.alias("columns_apart"), ((bare("ref_aligned") == F.col("ref")) & (bare("alt_aligned") == F.col("alt"))).alias("whole"))


@query(with_(CALLS) + " SELECT c.row_id, c.rid + 1 AS rid, CAST(c.pos + 1000 AS INT) AS pos FROM calls c WHERE rid IS NOT NULL")
def liftover(spark, d):
    """Records moved by a chain of blocks: each contig to the next one, a thousand bases on."""
    chain = table(spark, d, "contig", "rid", (F.col("rid") + 1).alias("to_rid"), F.lit(1000).alias("shift"))
    chain = chain.select("rid", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("b"), "to_rid", "shift").select("rid", (F.col("b") * (1 << 24) + 1).alias("beg1"), ((F.col("b") + 1) * (1 << 24)).alias("end1"), "to_rid", "shift")
    return regions.lift_over(calls(spark, d).select("row_id", "rid", "pos"), chain).where("old_rid is not null").select("row_id", "rid", "pos")


# --- files brought together


@query(with_(CALLS) + f" SELECT rid, pos, {akey_sql} AS akey, min(row_id) AS row_id, count(*) AS n_records FROM calls GROUP BY rid, pos, 3")
def uniq(spark, d):
    """First records of each variant."""
    u = cogroup.unique(calls(spark, d).select("row_id", "rid", "chrom", "pos", "ref", "alts"), "row_id")
    return cogroup.keyed(u).select("rid", "pos", "akey", "row_id", "n_records")


PRESENCE = with_(RECORDS, CLASSED) + ", s AS (SELECT rid, pos, ref, alt, bit_or(1 << file_index) AS mask, any_value(ts) AS ts, any_value(tv) AS tv, any_value(ins) AS ins, any_value(del) AS del FROM variants {} GROUP BY ALL)"
SUMS = f"count(*) AS n, {big('sum(ts)')} AS ts, {big('sum(tv)')} AS tv, {big('sum(ins)')} AS ins, {big('sum(del)')} AS del"


@query(PRESENCE.format("WHERE file_index IN (0, 1)") + f" SELECT CASE mask WHEN 1 THEN 'A-B' WHEN 2 THEN 'B-A' ELSE 'A&B' END AS part, {SUMS} FROM s GROUP BY 1")
def partition(spark, d):
    """Two files: variants of the one, of both, of the other."""
    return cogroup.partition_counts(variant_rows(spark, d))


@query(PRESENCE.format("") + f" SELECT CAST(mask AS INT) AS mask, {SUMS} FROM s GROUP BY mask")
def multi_partition(spark, d):
    """Three files: variants of every combination."""
    return cogroup.venn(variant_rows(spark, d))


@query(PRESENCE.format("") + " SELECT rid, pos, ref, alt FROM s WHERE mask & 3 = 1")
def except_variants(spark, d):
    """Variants of the first file that the second lacks."""
    return cogroup.presence(variant_rows(spark, d).drop("ord"), {0}, {1}).select("rid", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"))


@query(PRESENCE.format("") + " SELECT rid, pos, ref, alt FROM s WHERE mask & 3 = 3")
def intersect_variants(spark, d):
    """Variants that the first two files share."""
    return cogroup.presence(variant_rows(spark, d).drop("ord"), {0, 1}).select("rid", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"))


@query(PRESENCE.format("") + " SELECT rid, pos, ref || ',' || alt AS akey, concat_ws(',', CASE WHEN mask & 1 <> 0 THEN 'AA' END, CASE WHEN mask & 2 <> 0 THEN 'NN' END, CASE WHEN mask & 4 <> 0 THEN 'RR' END) AS centers, CAST(bit_count(mask) AS INT) AS n_centers FROM s")
def union_variants(spark, d):
    """All variants with the centers that report them."""
    v = variant_rows(spark, d).withColumn("chrom", F.col("rid").cast("string"))
    return cogroup.union_variants(v, ["AA", "NN", "RR"]).select("rid", "pos", "akey", "centers", "n_centers")


MERGED = ("GT", "PL", "DP", "AD", "GQ")
tag_sql = lambda t: f"coalesce(string_split(val, ':')[nullif(coalesce(list_position(string_split(fmt, ':'), '{t}'), 0), 0)], '.')"


@query(with_(CALLS) + f", o AS (SELECT rid, pos, {akey_sql} AS akey, sample_id, arg_min({" || ':' || ".join(tag_sql(t) for t in MERGED)}, row_id) AS x FROM calls GROUP BY ALL) SELECT rid, pos, akey, string_agg(sample_id || '=' || x, ';' ORDER BY sample_id) AS samples FROM o GROUP BY ALL")
def merge(spark, d):
    """One row a variant with the genotypes, likelihoods, depths and qualities of all samples."""
    value = lambda t: F.get(F.split("val", ":"), F.array_position(F.split("fmt", ":"), t) - 1)
    m = cogroup.merge_samples(calls(spark, d).withColumns({f"m_{t}": value(t) for t in MERGED}), fields=tuple(f"m_{t}" for t in MERGED))
    text = lambda s: F.concat(s["sample"], F.lit("="), F.concat_ws(":", *[F.coalesce(s[f"m_{t}"], F.lit(".")) for t in MERGED]))
    return m.select("rid", "pos", "akey", F.array_join(F.transform("samples", text), ";").alias("samples"))


@query(with_(CALLS) + ", f AS (SELECT rid, pos, file_index, string_agg(ref || '>' || array_to_string(alts, ','), '|' ORDER BY row_id) AS x, count(*) AS n FROM calls GROUP BY ALL) SELECT rid, pos, string_agg(file_index || '=' || x, ';' ORDER BY file_index) AS files, CAST(count(*) AS INT) AS n_files, CAST(sum(n) AS BIGINT) AS n_records FROM f GROUP BY ALL")
def by_position(spark, d):
    """Three files brought together by position: what each has there."""
    g = cogroup.by_position(calls(spark, d), ("ref", "alts"))
    one = lambda r: F.concat(r["ref"], F.lit(">"), F.array_join(r["alts"], ","))
    text = lambda f: F.concat(f["file_index"].cast("string"), F.lit("="), F.array_join(F.transform(f["records"], one), "|"))
    n = F.aggregate("files", F.lit(0).cast("long"), lambda acc, f: acc + F.size(f["records"]))
    return g.select("rid", "pos", F.array_join(F.transform("files", text), ";").alias("files"), "n_files", n.alias("n_records"))


@query("WITH f AS (SELECT 0 AS file_index, contig_name AS contig, rid, contig_len AS length FROM contig UNION ALL SELECT 1, contig_name, rid + CASE WHEN rid % 5 = 0 THEN 1 ELSE 0 END, contig_len FROM contig UNION ALL SELECT 2, contig_name, rid, CASE WHEN rid % 7 = 0 THEN contig_len + 1 END FROM contig) SELECT b.file_index, b.contig, CAST(b.rid AS INT) AS rid, a.rid AS first_rid, CAST(b.length AS INT) AS length, a.length AS first_length FROM f b JOIN f a ON a.contig = b.contig AND a.file_index = 0 WHERE b.rid <> a.rid OR b.length <> a.length")
def contig_check(spark, d):
    """Three files' contigs: which of them have another place or length than in the first."""
    c = table(spark, d, "contig", F.col("contig_name").alias("contig"), "rid", F.col("contig_len").alias("length"))
    second = c.withColumn("rid", F.col("rid") + (F.col("rid") % 5 == 0).cast("int"))
    third = c.withColumn("length", F.when(F.col("rid") % 7 == 0, F.col("length") + 1))
    return cogroup.contig_conflicts(cogroup.stack([c, second, third]))


@query(with_(RECORDS, CLASSED) + f", k AS (SELECT * FROM variants WHERE qual >= CASE WHEN vtype & 4 <> 0 THEN 40 ELSE 30 END) SELECT rid, pos, ref || ',' || alt AS akey, count(DISTINCT sample_id) AS nsamples, {big('sum(e)')} AS esum, {big('sum(n)')} AS nsum, max(qual) AS max_qual, array_to_string(list_sort(list_distinct(list(sample_id)))[1:10], ',') AS samples FROM k GROUP BY rid, pos, 3")
def merge_candidate_variants(spark, d):
    """Candidates of many samples with their evidence."""
    m = cogroup.merge_candidates(variant_rows(spark, d), 30.0, 40.0)
    return m.withColumn("samples", F.array_join("samples", ","))


@query(with_(SAMPLED, """
f AS (SELECT pos, k % 3 AS i, arg_min(g, k) AS g, arg_min(dp, k) AS dp FROM sampled GROUP BY ALL), s AS (SELECT DISTINCT pos FROM sampled WHERE g > 0),
t AS (SELECT pos, i, CASE g WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1/1' END || '|' || g * (dp % 20 + 10) || ',' || abs(g - 1) * (dp % 20 + 10) || ',' || abs(g - 2) * (dp % 20 + 10) AS x FROM f SEMI JOIN s USING (pos))""") + " SELECT 0 AS rid, pos, 'A,C' AS akey, string_agg(i || '=' || x, ';' ORDER BY i) AS calls FROM t GROUP BY pos HAVING count(*) = 3")
def merge_genotypes(spark, d):
    """Candidate sites that all files have, with each file's genotype."""
    s = sampled(spark, d).withColumns({"rid": F.lit(0), "ref": F.lit("A"), "alts": F.array(F.lit("C")), "file_index": (F.col("k") % 3).cast("int"), "row_id": F.col("k").cast("long"), "bqsum": F.lit(None).cast("int")})
    sites = s.where("g > 0").select("rid", "pos", "ref", "alts").distinct()
    text = lambda c: F.concat(c["file_index"].cast("string"), F.lit("="), F.array_join(c["gt"], "/"), F.lit("|"), F.array_join(c["pl"], ","))
    return cogroup.merge_genotypes(sites, s, 3).select("rid", "pos", "akey", F.array_join(F.transform("calls", text), ";").alias("calls"))


@query("SELECT row_id, sample_id AS left_sample, 'F' || file_id || '_' || sample_id AS right_sample FROM genotype")
def paste(spark, d):
    """Two files pasted side by side, row by row, their places and FORMAT held against each other."""
    c = calls(spark, d).select("row_id", "rid", "pos", "fmt", "sample_id", "file_id")
    left, right = c.select("row_id", "rid", "pos", "fmt", F.array("sample_id").alias("samples")), c.select("row_id", "rid", "pos", "fmt", F.array(F.concat(F.lit("F"), "file_id", F.lit("_"), "sample_id")).alias("samples"))
    return cogroup.paste(left, right, "row_id", agree=("rid", "pos", "fmt")).select("row_id", F.get("samples", F.lit(0)).alias("left_sample"), F.get("samples", F.lit(1)).alias("right_sample"))


@query(PRESENCE.format("") + ", k AS (SELECT rid, pos, ref, alt, 'rs' || min(n) AS id FROM records WHERE file_index = 2 GROUP BY ALL) SELECT s.rid, s.pos, s.ref, s.alt, k.id FROM s LEFT JOIN k USING (rid, pos, ref, alt) WHERE s.mask & 1 <> 0")
def annotate_dbsnp_rsid(spark, d):
    """Identifiers of known variants."""
    v = variant_rows(spark, d)
    known = v.where("file_index = 2").groupBy("rid", "pos", "ref", "alts").agg(F.concat(F.lit("rs"), F.min("n")).alias("id"))
    mine = v.where("file_index = 0").select("rid", "pos", "ref", "alts").distinct()
    return cogroup.annotate_id(mine, known).select("rid", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), "id")


@query(PRESENCE.format("") + " SELECT rid, pos, ref, alt, mask & 2 <> 0 AS known FROM s WHERE mask & 1 <> 0")
def annotate_1000g(spark, d):
    """A flag for variants of a reference panel."""
    v = variant_rows(spark, d)
    mine = v.where("file_index = 0").select("rid", "pos", "ref", "alts").distinct()
    return cogroup.annotate_known(mine, v.where("file_index = 1"), "known").select("rid", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), "known")


@query(with_(SAMPLED) + " SELECT a.sample, CAST(a.g AS INT) AS g1, CAST(b.g AS INT) AS g2, count(*) AS n FROM sampled a JOIN sampled b ON a.sample = b.sample AND a.pos = b.pos + 1 GROUP BY ALL")
def compute_concordance(spark, d):
    """Genotype classes of two call sets, sample by sample; the second set is the first one base on."""
    s = sampled(spark, d).withColumns({"rid": F.lit(0), "ref": F.lit("A"), "alts": F.array(F.lit("C"))})
    return cogroup.concordance(s, s.withColumn("pos", F.col("pos") + 1))


@query(with_(SAMPLED) + """, a AS (SELECT pos, min(g) AS g FROM sampled WHERE k % 2 = 0 GROUP BY pos), b AS (SELECT pos, min(g) AS g FROM sampled WHERE k % 2 = 1 GROUP BY pos)
SELECT CASE WHEN coalesce(a.g, 0) > 0 AND coalesce(b.g, 0) > 0 THEN 'tp' WHEN coalesce(a.g, 0) > 0 THEN 'fp' WHEN coalesce(b.g, 0) > 0 THEN 'fn' ELSE 'tn' END AS status, count(*) AS n FROM a FULL JOIN b USING (pos) GROUP BY 1""")
def profile_na12878(spark, d):
    """Calls against a truth set."""
    s = sampled(spark, d).withColumns({"rid": F.lit(0), "ref": F.lit("A"), "alts": F.array(F.lit("C"))})
    return cogroup.truth_status(s.where("k % 2 = 0"), s.where("k % 2 = 1"))


@query(with_(SAMPLED) + " , a AS (SELECT pos, min(g) AS g FROM sampled WHERE k % 2 = 0 GROUP BY pos), b AS (SELECT pos, min(g) AS t FROM sampled WHERE k % 2 = 1 GROUP BY pos) SELECT CAST(coalesce(g, 3) AS INT) AS g, CAST(coalesce(t, 3) AS INT) AS t, count(*) AS n FROM a FULL JOIN b USING (pos) GROUP BY ALL")
def truth_matrix(spark, d):
    """Genotype classes of calls against those of a truth set."""
    s = sampled(spark, d).withColumns({"rid": F.lit(0), "ref": F.lit("A"), "alts": F.array(F.lit("C"))})
    return cogroup.truth_matrix(s.where("k % 2 = 0"), s.where("k % 2 = 1"))


@query(with_(SAMPLED) + " SELECT CAST(a.g AS INT) AS g1, CAST(b.g AS INT) AS g2, count(*) AS n FROM sampled a JOIN sampled b ON a.pos = b.pos AND a.k = 4 AND b.k = 5 GROUP BY ALL")
def profile_chm1(spark, d):
    """A sample's genotypes against another's at the same places."""
    s = sampled(spark, d).withColumns({"rid": F.lit(0), "ref": F.lit("A"), "alts": F.array(F.lit("C"))})
    c = cogroup.concordance(s.where("k = 4").withColumn("sample", F.lit("x")), s.where("k = 5").withColumn("sample", F.lit("x")))
    return c.groupBy("g1", "g2").agg(F.sum("n").alias("n"))


@query(with_(SAMPLED) + f", t AS (SELECT pos, {big('sum(g)')} AS ac, {big('2 * count(*)')} AS an FROM sampled WHERE k IN (1, 4, 9, 16, 25) GROUP BY pos) SELECT pos, CAST(ac AS INT) AS ac, CAST(an AS INT) AS an FROM t WHERE ac > 0 AND ac < an")
def subset(spark, d):
    """A few samples' records, allele counts anew, polymorphic ones alone."""
    s = sampled(spark, d)
    rows = s.groupBy("pos").agg(F.collect_list(F.struct("sample", "gt")).alias("samples"))
    return cogroup.subset_samples(rows, ["S1", "S4", "S9", "S16", "S25"]).select("pos", "ac", "an")


@query(with_(CALLS) + f""", l AS (SELECT file_id, rid, pos, ref, alts, lag(rid) OVER w AS prid, lag(pos) OVER w AS ppos FROM calls WINDOW w AS (PARTITION BY file_id ORDER BY row_id))
SELECT file_id, count(*) AS n, count(CASE WHEN rid = prid AND pos < ppos THEN 1 END) AS n_unordered, count(CASE WHEN rid < prid THEN 1 END) AS n_unordered_chrom,
 count(CASE WHEN NOT (regexp_full_match(ref, '[ACGTNacgtn]+') AND len(list_filter(alts, lambda a: NOT regexp_full_match(a, '[ACGTNacgtn]+|<.+>'))) = 0) THEN 1 END) AS n_bad_alleles FROM l GROUP BY file_id""")
def validate(spark, d):
    """Order and alleles of each file."""
    return profiles.validation(calls(spark, d))


# --- overlaps of files and regions


@query(with_(CALLS) + f""", k AS (SELECT row_id, rid, pos, pos + length(ref) - 1 AS e, {akey_sql} AS akey, file_index FROM calls), a AS (SELECT * FROM k WHERE file_index = 0), b AS (SELECT * FROM k WHERE file_index = 1),
 sa AS (SELECT a.row_id, max(CASE WHEN b.row_id IS NULL THEN NULL WHEN a.pos = b.pos AND a.akey = b.akey THEN 1 ELSE 0 END) AS s FROM a LEFT JOIN b ON a.rid = b.rid AND a.pos <= b.e + 1000 AND a.e >= b.pos - 1000 GROUP BY a.row_id),
 sb AS (SELECT b.row_id, max(CASE WHEN a.row_id IS NULL THEN NULL WHEN a.pos = b.pos AND a.akey = b.akey THEN 1 ELSE 0 END) AS s FROM b LEFT JOIN a ON a.rid = b.rid AND b.pos <= a.e + 1000 AND b.e >= a.pos - 1000 GROUP BY b.row_id)
SELECT CASE WHEN s = 1 THEN 'ab1' WHEN s = 0 THEN 'ap' ELSE 'a' END AS part, count(*) AS n FROM sa GROUP BY 1 UNION ALL SELECT CASE WHEN s = 1 THEN 'ab2' WHEN s = 0 THEN 'bp' ELSE 'b' END AS part, count(*) AS n FROM sb GROUP BY 1""")
def fuzzy_partition(spark, d):
    """Two files by overlap, with margins."""
    c = calls(spark, d).select("row_id", "rid", "pos", "ref", "alts", "file_index")
    return regions.overlap_partition(c.where("file_index = 0"), c.where("file_index = 1"), 1000, 1000)


VNTRS = "vn AS (SELECT vntr_id, rid, beg1, end1, motif FROM vntr WHERE rid IS NOT NULL AND end1 >= beg1)"


@query(with_(RECORDS, VNTRS) + """, r AS (SELECT DISTINCT rid, pos * 4 AS pos, ref, alt FROM records), h AS (SELECT r.*, v.vntr_id, v.beg1 AS vbeg FROM r JOIN vn v ON r.rid = v.rid AND r.pos <= v.end1 AND r.pos + length(r.ref) - 1 >= v.beg1)
SELECT r.rid, CAST(r.pos AS INT) AS pos, r.ref, r.alt, arg_min(h.vntr_id, (h.vbeg, h.vntr_id)) AS vntr_id FROM r LEFT JOIN h USING (rid, pos, ref, alt) GROUP BY ALL""")
def vntrize(spark, d):
    """Records with the first reference repeat that overlaps them."""
    v = table(spark, d, "vntr", "vntr_id", "rid", "beg1", "end1", "motif")
    r = variant_rows(spark, d).select("rid", (F.col("pos") * 4).cast("int").alias("pos"), "ref", "alts").distinct().withColumn("row_id", F.struct("rid", "pos", "ref", "alts"))
    return regions.nearest_repeat(r, v).select("rid", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), "vntr_id")


VNTRIZED = with_(RECORDS, """
k AS (SELECT DISTINCT vntr_id, rid, beg1, end1, left(upper(repeat_tract), 1) AS ref, CASE WHEN vntr_id % 2 = 0 THEN ['<VNTR>'] ELSE ['<VN2>', '<VN3>'] END AS alts FROM vntr WHERE rid IS NOT NULL AND end1 >= beg1 AND repeat_tract IS NOT NULL),
r AS (SELECT DISTINCT rid, CAST(pos * 20 AS INT) AS pos, ref, alt FROM records), h AS (SELECT r.*, k.beg1, k.vntr_id, k.ref AS kref, k.alts AS kalts, k.rid || ':' || k.beg1 || ':' || k.ref || '/' || array_to_string(k.alts, '/') AS key FROM r JOIN k ON r.rid = k.rid AND r.pos - 10 <= k.end1 AND r.pos + length(r.ref) - 1 + 10 >= k.beg1),
g AS (SELECT rid, pos, ref, alt, arg_min(beg1, (beg1, vntr_id)) AS b, arg_min(kref, (beg1, vntr_id)) AS kref, arg_min(kalts, (beg1, vntr_id)) AS kalts, string_agg(key, ',' ORDER BY beg1, vntr_id) || ',' || rid || ':' || pos || ':' || ref || '/' || alt AS overlap_variants, CAST(max(len(kalts) + 1) AS INT) AS n_repeat_allele FROM h GROUP BY rid, pos, ref, alt)""")


def made_vntrized(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vntr", "vntr_id", "rid", "beg1", "end1", F.left(F.upper("repeat_tract"), F.lit(1)).alias("ref")).where("ref is not null").distinct()
    v = v.withColumn("alts", F.when(F.col("vntr_id") % 2 == 0, F.array(F.lit("<VNTR>"))).otherwise(F.array(F.lit("<VN2>"), F.lit("<VN3>"))))
    r = variant_rows(spark, d).select("rid", (F.col("pos") * 20).cast("int").alias("pos"), "ref", "alts").distinct().withColumn("row_id", F.struct("rid", "pos", "ref", "alts"))
    return regions.vntrized(r, v, 10, 10)


@query(VNTRIZED + " SELECT r.rid, r.pos AS old_pos, coalesce(g.b, r.pos) AS pos, coalesce(g.kref, r.ref) AS ref, coalesce(array_to_string(g.kalts, ','), r.alt) AS alt, overlap_variants, CASE WHEN b IS NOT NULL THEN 2 END AS n_allele, n_repeat_allele FROM r LEFT JOIN g USING (rid, pos, ref, alt)")
def vntrize_alleles(spark, d):
    """Records with the place and alleles of the first reference repeat within ten bases."""
    return made_vntrized(spark, d).select("rid", F.col("row_id.pos").alias("old_pos"), "pos", "ref", alts_text().alias("alt"), "overlap_variants", "n_allele", "n_repeat_allele")


@query(VNTRIZED + " SELECT 2 AS n_allele, n_repeat_allele, count(*) AS n FROM g GROUP BY ALL")
def vntrize_joint(spark, d):
    """Numbers of alleles of records against those of their repeats."""
    return regions.joint_alleles(made_vntrized(spark, d))


@query(with_(REGIONS) + ", vn AS (SELECT row_id, rid, beg1, end1 FROM vntr WHERE rid IS NOT NULL AND end1 >= beg1) SELECT v.row_id, r.region_id FROM vn v JOIN regions r ON v.rid = r.rid AND v.beg1 <= r.end1 AND v.end1 >= r.beg1")
def overlap_pairs(spark, d):
    """All pairs of a repeat and a region that share a base."""
    v = table(spark, d, "vntr", "row_id", "rid", "beg1", "end1")
    r = region_rows(spark, d).select("region_id", "rid", "beg1", "end1")
    return intervals.overlap_join(v, r, "rid", "rid", ("beg1", "end1"), ("beg1", "end1")).select("row_id", F.col("r_region_id").alias("region_id"))


@query(with_(REGIONS) + ", vn AS (SELECT row_id, rid, beg1, end1 FROM vntr WHERE rid IS NOT NULL AND end1 >= beg1), h AS (SELECT v.row_id, max(CASE WHEN r.feature IN ('lcr', 'dust') THEN 1 ELSE 0 END) AS lc, max(CASE WHEN r.feature = 'cds' THEN 1 ELSE 0 END) AS cds FROM vn v JOIN regions r ON v.rid = r.rid AND v.beg1 <= r.end1 AND v.end1 >= r.beg1 GROUP BY v.row_id) SELECT coalesce(lc, 0) AS lc, coalesce(cds, 0) AS cds, count(*) AS n FROM vn LEFT JOIN h USING (row_id) GROUP BY 1, 2")
def profile_vntrs(spark, d):
    """Repeats by what regions they lie in."""
    v = table(spark, d, "vntr", "row_id", "rid", "beg1", "end1").where("rid is not null and end1 >= beg1")
    r = region_rows(spark, d)
    flag = F.when(F.col("feature").isin("lcr", "dust"), "lc").when(F.col("feature") == "cds", "cds")
    areas = r.select("rid", flag.alias("flag"), F.col("beg1").alias("b"), F.col("end1").alias("e")).where("flag is not null")
    out = intervals.overlap_flags(v, "rid", ("beg1", "end1"), areas, ["lc", "cds"])
    return out.groupBy(F.col("lc").cast("int").alias("lc"), F.col("cds").cast("int").alias("cds")).agg(F.count("*").alias("n"))


# --- profiles


@query(with_(CALLS) + " SELECT k.rid, k.contig_name, k.contig_len, count(c.row_id) AS n, count(CASE WHEN c.qual > 30 THEN 1 END) AS n_pass FROM contig k LEFT JOIN calls c ON c.rid = k.rid AND len(c.alts) = 1 GROUP BY ALL")
def profile_chrom(spark, d):
    """Biallelic records of each contig."""
    return profiles.per_contig(calls(spark, d), table(spark, d, "contig"), F.coalesce(F.col("qual") > 30, F.lit(False)))


COUNTS = with_(SAMPLED) + f", c AS (SELECT pos, {big('sum(g)')} AS ac, {big('2 * count(*)')} AS an, count(CASE WHEN g = 0 THEN 1 END) AS n00, count(CASE WHEN g = 1 THEN 1 END) AS n01, count(CASE WHEN g = 2 THEN 1 END) AS n11, count(*) AS ns FROM sampled GROUP BY pos)"


@query(COUNTS + f" SELECT least(ac, an - ac) AS mac, count(*) AS n, {big('sum(CASE WHEN ns > 20 THEN 1 ELSE 0 END)')} AS n_pass FROM c GROUP BY 1")
def profile_afs(spark, d):
    """The folded allele frequency spectrum."""
    c = profiles.allele_counts(sampled(spark, d), ["pos"])
    return profiles.allele_spectrum(c.withColumn("pass", F.col("ns") > 20))


@query(COUNTS + " SELECT * FROM c")
def allele_counts(spark, d):
    """Allele and genotype counts of each site."""
    return profiles.allele_counts(sampled(spark, d), ["pos"])


@query(COUNTS + """, q AS (SELECT *, ac / an AS p FROM c) SELECT pos, round(p, 6) AS af, round(ns * (1 - p) * (1 - p), 4) AS e00, round(2 * ns * p * (1 - p), 4) AS e01, round(ns * p * p, 4) AS e11,
 CASE WHEN p > 0 AND p < 1 THEN round(1 - n01 / (2 * ns * p * (1 - p)), 4) END AS f FROM q""")
def hardy_weinberg_counts(spark, d):
    """Genotype counts expected in Hardy-Weinberg proportions and the inbreeding coefficient from counts."""
    c = profiles.allele_counts(sampled(spark, d), ["pos"]).withColumn("p", F.col("ac") / F.col("an"))
    p, n = F.col("p"), F.col("ns")
    return c.select("pos", F.round(p, 6).alias("af"), F.round(n * (1 - p) * (1 - p), 4).alias("e00"), F.round(2 * n * p * (1 - p), 4).alias("e01"), F.round(n * p * p, 4).alias("e11"), F.when((p > 0) & (p < 1), F.round(1 - F.col("n01") / (2 * n * p * (1 - p)), 4)).alias("f"))


@query(with_(CALLS) + """, f AS (SELECT len(alts) + 1 AS n_allele, length(alts[1]) - length(ref) AS dlen, CAST(floor(coalesce(qual, 0) / 10) AS INT) AS bin FROM calls WHERE len(alts) > 0 AND alts[1] NOT LIKE '<%' AND alts[1] <> ref)
SELECT n_allele, CAST(dlen AS INT) AS dlen, bin, count(*) AS n FROM f GROUP BY ALL""")
def profile_len(spark, d):
    """Lengths of first ALTs by number of alleles and quality."""
    c = A.classified(calls(spark, d)).where((F.size("alts") > 0) & ~A.is_symbolic(F.get("alts", F.lit(0))) & (F.get("alts", F.lit(0)) != F.col("ref")))
    return c.groupBy((F.size("alts") + 1).cast("long").alias("n_allele"), F.get("alleles", F.lit(0))["dlen"].alias("dlen"), F.floor(F.coalesce("qual", F.lit(0)) / 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))


REFERENCE_SETS = PRESENCE.replace("FROM variants {}", "FROM variants WHERE file_index IN (0, 1) AND vtype = {}")


@query(REFERENCE_SETS.format(1) + f" SELECT CASE mask WHEN 1 THEN 'A-B' WHEN 2 THEN 'B-A' ELSE 'A&B' END AS part, count(*) AS n, {big('sum(ts)')} AS ts, {big('sum(tv)')} AS tv FROM s GROUP BY 1")
def profile_snps(spark, d):
    """SNPs against a reference set."""
    i = variant_rows(spark, d)
    return profiles.against_reference(i.where("file_index = 0").drop("file_index"), i.where("file_index = 1").drop("file_index"), "snp")


@query(REFERENCE_SETS.format(4) + f" SELECT CASE mask WHEN 1 THEN 'A-B' WHEN 2 THEN 'B-A' ELSE 'A&B' END AS part, count(*) AS n, {big('sum(ins)')} AS ins, {big('sum(del)')} AS del FROM s GROUP BY 1")
def profile_indels(spark, d):
    """Indels against a reference set."""
    i = variant_rows(spark, d)
    return profiles.against_reference(i.where("file_index = 0").drop("file_index"), i.where("file_index = 1").drop("file_index"), "indel")


@query(REFERENCE_SETS.format(1) + ", p AS (SELECT mask, count(*) AS n FROM s GROUP BY mask) SELECT round(sum(n) FILTER (mask = 3) / nullif(sum(n) FILTER (mask IN (1, 3)), 0), 6) AS precision, round(sum(n) FILTER (mask = 3) / nullif(sum(n) FILTER (mask IN (2, 3)), 0), 6) AS sensitivity FROM p")
def profile_rates(spark, d):
    """Precision and sensitivity of SNPs against a reference set."""
    return profiles.rates(profile_snps(spark, d))


@query(with_(RECORDS) + f", x AS (SELECT file_index AS file_id, ref <> {ref_seq('pos', 'pos + length(ref) - 1')} AS bad FROM records) SELECT CAST(file_id AS BIGINT) AS file_id, count(*) AS n, count(*) FILTER (bad) AS n_bad_refs FROM x GROUP BY file_id")
def validate_refs(spark, d):
    """Records of each file whose REF is not the reference's."""
    v = variant_rows(spark, d).select(F.col("file_index").cast("long").alias("file_id"), F.col("rid").cast("string").alias("chrom"), "rid", "pos", "ref", "alts", F.xxhash64("ord").alias("row_id"))
    return profiles.validation(v, chunks=reference(spark, d), chunk_bits=10).select("file_id", "n", "n_bad_refs")


@query(with_(SAMPLED) + " SELECT CAST(a.g AS INT) AS g1, CAST(b.g AS INT) AS g2, count(*) AS n FROM sampled a JOIN sampled b ON a.pos = b.pos AND b.k = a.k + 1 AND a.k % 2 = 0 GROUP BY ALL")
def duplicate_concordance(spark, d):
    """Genotype classes of individuals and their duplicates."""
    pairs = spark.range(15).select(F.concat(F.lit("S"), F.col("id") * 2).alias("first"), F.concat(F.lit("S"), F.col("id") * 2 + 1).alias("second"))
    return profiles.duplicate_counts(sampled(spark, d).select("pos", "sample", "g"), pairs, ["pos"])


TRIOS = with_(SAMPLED) + ", t AS (SELECT f.g AS g_father, m.g AS g_mother, c.g AS g_child, count(*) AS n FROM sampled c JOIN sampled f ON f.pos = c.pos AND f.k = c.k - 2 JOIN sampled m ON m.pos = c.pos AND m.k = c.k - 1 WHERE c.k % 3 = 2 GROUP BY ALL)"


@query(TRIOS + " SELECT * FROM t")
def profile_mendelian(spark, d):
    """Genotype classes of trios."""
    return profiles.trio_counts(sampled(spark, d).select("pos", "sample", "g"), trios(spark), ["pos"])


@query(TRIOS + f", e AS (SELECT n, g_child, g_child < CASE WHEN g_father = 2 THEN 1 ELSE 0 END + CASE WHEN g_mother = 2 THEN 1 ELSE 0 END OR g_child > CASE WHEN g_father = 0 THEN 0 ELSE 1 END + CASE WHEN g_mother = 0 THEN 0 ELSE 1 END AS bad FROM t) SELECT {big('sum(n)')} AS n_trios, {big('sum(CASE WHEN bad THEN n ELSE 0 END)')} AS n_errors, {big('sum(CASE WHEN g_child = 1 THEN n ELSE 0 END)')} AS n_het_child, round(sum(CASE WHEN bad THEN n ELSE 0 END) / sum(n), 6) AS error_rate FROM e")
def mendelian_errors(spark, d):
    """How often trios contradict inheritance."""
    return profiles.mendelian_errors(profile_mendelian(spark, d))


@query("SELECT fam, ids[1] AS child, father, mother, sex FROM pedigree WHERE father IS NOT NULL AND father <> '0' AND mother IS NOT NULL AND mother <> '0' AND len(ids) > 0")
def pedigree_trios(spark, d):
    """Trios of a pedigree."""
    return profiles.pedigree_trios(table(spark, d, "pedigree"))


@query("SELECT ids[1] AS first, unnest(ids[2:]) AS second FROM pedigree WHERE len(ids) > 1")
def pedigree_duplicates(spark, d):
    """Individuals and their duplicates."""
    return profiles.pedigree_duplicates(table(spark, d, "pedigree"))


@query(with_(CALLS) + " SELECT replace(replace(a, '<', ''), '>', '') AS prefix, 1 AS depth, count(*) AS n FROM (SELECT unnest(alts) AS a FROM calls) WHERE a LIKE '%<%' GROUP BY 1")
def sv_tree(spark, d):
    """Symbolic alleles by every level of their type."""
    return profiles.structural_tree(calls(spark, d)).select("prefix", "depth", "n")


ROTATE = "list_min(list_transform(range(1, greatest(length({0}), 1) + 1), lambda i: substr({0} || {0}, i, length({0}))))"


@query("WITH m AS (SELECT upper(motif) AS u FROM vntr WHERE motif IS NOT NULL), c AS (SELECT array_to_string(list_sort(list_distinct(string_split(u, ''))), '') AS basis, CAST(length(u) AS INT) AS mlen, " + ROTATE.format("u") + " AS motif FROM m) SELECT basis, mlen, motif, count(*) AS n FROM c GROUP BY ROLLUP (basis, mlen, motif)")
def vntr_tree(spark, d):
    """Repeats by bases, motif length and motif."""
    return profiles.repeat_tree(table(spark, d, "vntr", "motif"))


# --- repeats and sequences


INFO_SQL = "-(" + " + ".join(f"CASE WHEN {b} > 0 THEN {b} / n * log2({b} / n) ELSE 0 END" for b in "acgt") + ")"


@query("WITH t AS (SELECT row_id, upper(repeat_tract) AS s, upper(motif) AS m FROM vntr), c AS (SELECT *, " + ", ".join(f"CAST(length(s) - length(replace(s, '{b.upper()}', '')) AS DOUBLE) AS {b}" for b in "acgt") + " FROM t), e AS (SELECT *, a + c + g + t AS n FROM c) SELECT row_id, " + ROTATE.format("m") + " AS ex_motif, CAST(length(m) AS INT) AS ex_mlen, array_to_string(list_sort(list_distinct(string_split(m, ''))), '') AS ex_basis, CAST(length(s) AS INT) AS ex_rl, CASE WHEN n > 0 THEN abs(round(" + INFO_SQL + ", 2)) END AS ex_entropy FROM e")
def annotate_vntrs(spark, d):
    """Exact annotations of repeats."""
    v = repeats.annotate_repeats(table(spark, d, "vntr", "row_id", "motif", "repeat_tract"))
    return v.select("row_id", "ex_motif", "ex_mlen", "ex_basis", "ex_rl", "ex_entropy")


@query()
def annotate_vntrs_fuzzy(spark, d):
    """Repeats aligned to their motif by the repeat model; tracts delivered again are aligned once."""
    # A stated number of partitions, since adaptive execution would bring this small table into few tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = table(spark, d, "vntr", "motif", "repeat_tract").repartition(parts, "motif", "repeat_tract").distinct()
    return repeats.annotate_fuzzy(v)


def made_indels(spark: SparkSession, d: str, ref: DataFrame) -> DataFrame:
    """A deletion of one reference base at each place of records."""
    v = variant_rows(spark, d).select(F.col("rid").cast("string").alias("chrom"), "rid", "pos").distinct()
    w = records.reference_windows(v, ref, F.col("pos"), F.col("pos") + 4, 10)
    return w.select("chrom", "rid", "pos", F.substr("window", F.lit(1), F.lit(2)).alias("ref"), F.array(F.substr("window", F.lit(1), F.lit(1))).alias("alts"))


INDELS = with_(RECORDS, f"x AS (SELECT DISTINCT rid, pos, {f_ref('pos')} AS b0, {f_ref('pos + 1')} AS b FROM records)", f"""
y AS (SELECT *, coalesce(list_filter(range(0, least(64, pos)), lambda j: {f_ref('pos - j')} <> b)[1], least(64, pos)) AS l, coalesce(list_filter(range(0, 64), lambda j: {f_ref('pos + 2 + j')} <> b)[1], 64) AS r FROM x),
z AS (SELECT rid, CAST(rid AS VARCHAR) AS chrom, pos, CAST(pos + 1 - l AS INT) AS beg1, CAST(pos + 1 + r AS INT) AS end1, b AS motif, CAST(l + r + 1 AS INT) AS copies, {ref_seq('greatest(pos + 1 - l - 10, 1)', 'pos - l')} AS "left", {ref_seq('pos + 2 + r', 'pos + 11 + r')} AS "right", rid || ':' || pos || ':' || b0 || b || '/' || b0 AS indel FROM y)""")


@query(INDELS + f""", t AS (SELECT DISTINCT rid, beg1, end1, motif FROM z WHERE end1 > beg1 AND beg1 > 1), q AS (SELECT *, {f_ref('beg1 - 1')} AS b0, (beg1 % 50) AS q FROM t WHERE beg1 % 50 > 30)
 SELECT rid, CAST(beg1 - 1 AS INT) AS pos, b0 || motif || motif AS ref, array_to_string(list_sort(list_distinct([b0 || motif, b0, b0 || motif || motif || motif])), ',') AS alt, CAST(rid AS BIGINT) * 1000000000 + beg1 AS vntr_id, 3 AS n FROM q""")
def consolidate_indels(spark, d):
    """Indels that stand in one repeat as one candidate multi-allelic record: the loss of one and of two of its bases and
    the gain of one; the quality of a repeat's indels follows from its place."""
    ref = reference(spark, d)
    tracts = repeats.indel_tracts(made_indels(spark, d, ref), ref, 64, 10).where("end1 > beg1 and beg1 > 1").select("rid", "chrom", "beg1", "end1", "motif").distinct()
    tracts = tracts.withColumn("vntr_id", F.col("rid").cast("long") * 1_000_000_000 + F.col("beg1"))
    w = records.reference_windows(tracts, ref, F.col("beg1") - 1, F.col("beg1") + 1, 10)
    lead = F.substr("window", F.lit(1), F.lit(1))
    kinds = F.array(F.struct(F.substr("window", F.lit(1), F.lit(2)).alias("ref"), lead.alias("alt")), F.struct(F.col("window").alias("ref"), lead.alias("alt")), F.struct(lead.alias("ref"), F.substr("window", F.lit(1), F.lit(2)).alias("alt")))
    made = w.select("rid", "chrom", (F.col("beg1") - 1).alias("pos"), (F.col("beg1") % 50).cast("float").alias("qual"), "motif", F.explode(kinds).alias("k")).select("rid", "chrom", "pos", "qual", "motif", "k.ref", F.array("k.alt").alias("alts"))
    return regions.multiallelic_indels(made, tracts, ref, 30.0, 10).withColumn("alts", alts_text()).withColumnRenamed("alts", "alt")


@query(INDELS + " SELECT rid, chrom, beg1, end1, motif, string_agg(DISTINCT indel, ',' ORDER BY indel) AS associated FROM z WHERE end1 - beg1 + 1 >= 2 GROUP BY ALL")
def extract_vntrs(spark, d):
    """Repeats that indels stand in."""
    ref = reference(spark, d)
    return repeats.extract_repeats(made_indels(spark, d, ref), ref, "ananda2013", 64, 10)


@query(INDELS + ' SELECT rid, chrom, pos, beg1, end1, motif, copies, "left", "right", indel FROM z')
def annotate_indels(spark, d):
    """The exact repeat tract of each indel, with its flanks."""
    ref = reference(spark, d)
    return repeats.indel_tracts(made_indels(spark, d, ref), ref, 64, 10)


CANON2 = "least(" + ROTATE.format("m") + ", " + ROTATE.format("translate(reverse(m), 'ACGT', 'TGCA')") + ")"


@query("WITH v AS (SELECT rid, beg1, end1, upper(motif) AS m FROM vntr WHERE rid IS NOT NULL AND end1 >= beg1), r AS (SELECT rid, beg1, end1, coalesce(" + CANON2 + """, '') AS motif FROM v),
b AS (SELECT *, array_to_string(list_sort(list_distinct(string_split(motif, ''))), '') AS basis FROM r),
g AS (SELECT rid, beg1, max(end1) AS end1 FROM b GROUP BY ALL), l AS (SELECT *, max(end1) OVER (PARTITION BY rid ORDER BY beg1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR beg1 > prev THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY beg1 ROWS UNBOUNDED PRECEDING) AS isl FROM l),
p AS (SELECT rid, isl, min(beg1) AS cb, max(end1) AS ce FROM i GROUP BY ALL), j AS (SELECT b.*, i.isl FROM b JOIN i ON b.rid = i.rid AND b.beg1 = i.beg1)
SELECT j.rid, CAST(any_value(p.cb) AS INT) AS beg1, CAST(any_value(p.ce) AS INT) AS end1, count(*) AS n,
 CASE WHEN count(*) = 1 THEN 'isolated' WHEN min(motif) = max(motif) THEN 'merged' WHEN min(basis) = max(basis) THEN 'same_basis' ELSE 'mixed' END AS state, CASE WHEN min(motif) = max(motif) THEN min(motif) END AS motif
FROM j JOIN p ON p.rid = j.rid AND p.isl = j.isl GROUP BY j.rid, j.isl""")
def consolidate_vntrs(spark, d):
    """Clusters of overlapping repeats."""
    return repeats.consolidate_repeats(table(spark, d, "vntr", "rid", "beg1", "end1", "motif"))


@query("""WITH t AS (SELECT row_id, upper(repeat_tract) AS s FROM vntr WHERE repeat_tract <> ''), e AS (SELECT row_id, s, k, unnest(range(k + 1, length(s) + 1)) AS i FROM t, (SELECT unnest(range(1, 7)) AS k) WHERE length(s) > k),
m AS (SELECT *, i - row_number() OVER (PARTITION BY row_id, k ORDER BY i) AS run FROM e WHERE s[i] = s[i - k]), r AS (SELECT k, any_value(s) AS s, min(i) AS i, count(*) + k AS n FROM m GROUP BY row_id, k, run HAVING count(*) >= k),
u AS (SELECT k, n, substr(s, CAST(i - k AS INT), CAST(k AS INT)) AS u FROM r) SELECT """ + ROTATE.format("u") + """ AS motif, CAST(n AS INT) AS length, count(*) AS n FROM u WHERE len(list_filter(range(1, k), lambda d: k % d = 0 AND repeat(substr(u, 1, d), CAST(k // d AS INT)) = u)) = 0 GROUP BY 1, 2""")
def compute_rl_dist(spark, d):
    """How long tracts of each motif are."""
    return profiles.run_lengths(table(spark, d, "vntr", F.col("repeat_tract").alias("seq")))


@query("WITH m AS (SELECT DISTINCT upper(ru) AS m FROM vntr WHERE ru IS NOT NULL) SELECT m AS seq, translate(reverse(m), 'ACGT', 'TGCA') AS rc, " + ROTATE.format("m") + " AS canon, " + CANON2 + " AS canon2, substr(m, 2) || substr(m, 1, 1) AS shifted, length(m) > coalesce(list_filter(range(1, length(m) + 1), lambda k: length(m) % k = 0 AND repeat(substr(m, 1, k), CAST(length(m) // k AS INT)) = m)[1], length(m)) AS periodic FROM m")
def motif_functions(spark, d):
    """Functions over motifs."""
    m = table(spark, d, "vntr", F.upper("ru").alias("seq")).where("seq is not null").distinct()
    return m.select("seq", S.reverse_complement("seq").alias("rc"), S.canonical("seq").alias("canon"), S.canonical_both_strands("seq").alias("canon2"), S.shift("seq", 1).alias("shifted"), S.is_periodic("seq").alias("periodic"))


# --- statistics


@query(COUNTS + f""", p AS (SELECT *, dp % 20 + 10 AS w FROM sampled), q AS (SELECT *, pow(10.0, -(g * w) / 10.0) AS l0, pow(10.0, -(abs(g - 1) * w) / 10.0) AS l1, pow(10.0, -(abs(g - 2) * w) / 10.0) AS l2 FROM p)
SELECT pos, CAST(count(*) AS INT) AS ns, round(-10 * sum(log10(1 - l0 / (l0 + l1 + l2)))) AS qual, round(sum(g) / (2.0 * count(*)), 6) AS af FROM q GROUP BY pos""")
def compute_features(spark, d):
    """Quality and frequency of sites from likelihoods."""
    s = features.gathered(sampled(spark, d), ["pos"], ["k"])
    return features.likelihood_features(s).select("pos", "ns", "qual", "af")


@query(with_(SAMPLED).replace("WITH", "WITH RECURSIVE", 1) + """, p AS (SELECT pos, g, dp % 20 + 10 AS w FROM sampled), q AS (SELECT pos, pow(10.0, -(g * w) / 10.0) AS l0, pow(10.0, -(abs(g - 1) * w) / 10.0) AS l1, pow(10.0, -(abs(g - 2) * w) / 10.0) AS l2, count(*) AS m FROM p GROUP BY ALL),
em(pos, i, f, g0, g1, g2) AS (SELECT DISTINCT pos, 0, CAST(0.5 AS DOUBLE), CAST(1 / 3 AS DOUBLE), CAST(1 / 3 AS DOUBLE), CAST(1 / 3 AS DOUBLE) FROM q UNION ALL
 SELECT q.pos, any_value(e.i) + 1,
  sum(m * (l2 * f * f + 0.5 * l1 * 2 * f * (1 - f)) / (l0 * (1 - f) * (1 - f) + l1 * 2 * f * (1 - f) + l2 * f * f)) / sum(m),
  sum(m * l0 * g0 / (l0 * g0 + l1 * g1 + l2 * g2)) / sum(m), sum(m * l1 * g1 / (l0 * g0 + l1 * g1 + l2 * g2)) / sum(m), sum(m * l2 * g2 / (l0 * g0 + l1 * g1 + l2 * g2)) / sum(m)
 FROM em e JOIN q ON q.pos = e.pos WHERE e.i < 50 GROUP BY q.pos)
SELECT pos, round(f, 4) AS hweaf, round(g1 / 2 + g2, 4) AS mleaf FROM em WHERE i = 50""")
def estimate(spark, d):
    """Allele frequencies by EM, with and without Hardy-Weinberg proportions."""
    e = features.estimate(features.gathered(sampled(spark, d), ["pos"], ["k"]), ("MLEAF", "HWEAF"))
    return e.select("pos", F.round(F.get("hweaf", F.lit(0)), 4).alias("hweaf"), F.round(F.get("mleaf", F.lit(0)), 4).alias("mleaf"))


@query(with_(SAMPLED).replace("WITH", "WITH RECURSIVE", 1) + """, p AS (SELECT pos, dp, g * (dp % 20 + 10) AS p0, abs(g - 1) * (dp % 20 + 10) AS p1, abs(g - 2) * (dp % 20 + 10) AS p2 FROM sampled), q AS (SELECT *, pow(10.0, -p0 / 10.0) AS l0, pow(10.0, -p1 / 10.0) AS l1, pow(10.0, -p2 / 10.0) AS l2 FROM p),
u AS (SELECT pos, l0, l1, l2, count(*) AS m FROM q GROUP BY ALL),
em(pos, i, f, g0, g1, g2) AS (SELECT DISTINCT pos, 0, CAST(0.5 AS DOUBLE), CAST(1 / 3 AS DOUBLE), CAST(1 / 3 AS DOUBLE), CAST(1 / 3 AS DOUBLE) FROM u UNION ALL
 SELECT u.pos, any_value(e.i) + 1,
  sum(m * (l2 * f * f + 0.5 * l1 * 2 * f * (1 - f)) / (l0 * (1 - f) * (1 - f) + l1 * 2 * f * (1 - f) + l2 * f * f)) / sum(m),
  sum(m * l0 * g0 / (l0 * g0 + l1 * g1 + l2 * g2)) / sum(m), sum(m * l1 * g1 / (l0 * g0 + l1 * g1 + l2 * g2)) / sum(m), sum(m * l2 * g2 / (l0 * g0 + l1 * g1 + l2 * g2)) / sum(m)
 FROM em e JOIN u ON u.pos = e.pos WHERE e.i < 50 GROUP BY u.pos),
h AS (SELECT q.*, l0 * (1 - f) * (1 - f) + l1 * 2 * f * (1 - f) + l2 * f * f AS lh, l0 * g0 + l1 * g1 + l2 * g2 AS la, l1 * 2 * f * (1 - f) AS hh, l1 * g1 AS ha FROM q JOIN em ON em.pos = q.pos AND em.i = 50)
SELECT pos, round(sum(ln(lh)) - sum(ln(la)), 4) + 0.0 AS hwe_llr, CASE WHEN max(p0) > 0 AND max(p2) > 0 THEN round(1 - sum(ha / la) / sum(hh / lh), 4) + 0.0 END AS fic,
 round((0.05 + sum(ha / la * dp * (1 + (p2 - p0) / (p0 + p2 - 2.0 * p1 + 6 * dp)) / 2)) / (0.1 + sum(ha / la * dp)), 4) AS ab FROM h GROUP BY pos""")
def hwe_likelihoods(spark, d):
    """What profile_hwe rests on: the log likelihood ratio, the inbreeding coefficient (of polymorphic sites) and the allele
    balance of sites."""
    e = features.likelihood_features(features.gathered(sampled(spark, d), ["pos"], ["k"])).withColumn("fic", F.when((F.col("ac") > 0) & (F.col("ac") < F.col("an")), F.col("fic")))
    return e.select("pos", *[(F.round(c, 4) + 0.0).alias(c) for c in ("hwe_llr", "fic", "ab")])


@query()
def profile_hwe(spark, d):
    """Hardy-Weinberg tests, inbreeding and allele balance of sites."""
    e = features.likelihood_features(features.gathered(sampled(spark, d), ["pos"], ["k"]))
    return e.select("pos", "n_allele", "af", F.round("hwe_llr", 6).alias("hwe_llr"), F.round("hwe_lpval", 6).alias("hwe_lpval"), "hwe_df", F.round("fic", 6).alias("fic"), F.round("ab", 6).alias("ab"))


@query(with_(SAMPLED).replace("WITH", "WITH RECURSIVE", 1) + """, p AS (SELECT pos, k, pow(10.0, -g * (dp % 20 + 10) / 10.0) AS l0, pow(10.0, -abs(g - 1) * (dp % 20 + 10) / 10.0) AS l1, pow(10.0, -abs(g - 2) * (dp % 20 + 10) / 10.0) AS l2 FROM sampled),
t AS (SELECT c.pos, c.l0 AS c0, c.l1 AS c1, c.l2 AS c2, f.l0 AS f0, f.l1 AS f1, f.l2 AS f2, m.l0 AS m0, m.l1 AS m1, m.l2 AS m2 FROM p c JOIN p f ON f.pos = c.pos AND f.k = c.k - 2 JOIN p m ON m.pos = c.pos AND m.k = c.k - 1 WHERE c.k % 3 = 2),
q AS (SELECT pos, f0 AS l0, f1 AS l1, f2 AS l2 FROM t UNION ALL SELECT pos, m0, m1, m2 FROM t),
em(pos, i, f) AS (SELECT DISTINCT pos, 0, CAST(0.5 AS DOUBLE) FROM q UNION ALL SELECT q.pos, any_value(e.i) + 1, avg((l2 * f * f + l1 * f * (1 - f)) / (l0 * (1 - f) * (1 - f) + l1 * 2 * f * (1 - f) + l2 * f * f)) FROM em e JOIN q ON q.pos = e.pos WHERE e.i < 50 GROUP BY q.pos),
g AS (SELECT t.*, (1 - f) * (1 - f) AS g0, 2 * f * (1 - f) AS g1, f * f AS g2 FROM t JOIN em ON em.pos = t.pos AND em.i = 50),
x AS (SELECT pos, log10(greatest(f0 * g0 + f1 * g1 + f2 * g2, 1e-300)) + log10(greatest(m0 * g0 + m1 * g1 + m2 * g2, 1e-300)) + log10(greatest(c0 * g0 + c1 * g1 + c2 * g2, 1e-300)) AS u,
 log10(greatest(f0 * g0 * (m0 * g0 * c0 + m1 * g1 * (c0 + c1) / 2 + m2 * g2 * c1) + f1 * g1 * (m0 * g0 * (c0 + c1) / 2 + m1 * g1 * (c0 + 2 * c1 + c2) / 4 + m2 * g2 * (c1 + c2) / 2) + f2 * g2 * (m0 * g0 * c1 + m1 * g1 * (c1 + c2) / 2 + m2 * g2 * c2), 1e-300)) AS r FROM g)
SELECT pos, round(sum(u), 4) + 0.0 AS lud, round(sum(r), 4) + 0.0 AS lre, round(sum(r) - sum(u), 4) + 0.0 AS bf FROM x GROUP BY pos""")
def milk_filter(spark, d):
    """Family likelihoods of sites."""
    s = sampled(spark, d).select("pos", "sample", "pl")
    role = lambda name: s.select("pos", F.col("sample").alias(name), F.col("pl").alias(f"pl_{name}"))
    t = role("child").join(trios(spark), "child").join(role("father"), ["pos", "father"]).join(role("mother"), ["pos", "mother"])
    g = t.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("child", "pl_father", "pl_mother", "pl_child"))).alias("x"))
    pick = lambda c: F.transform("x", lambda r: r[c])
    f = features.family_filter(g.select("pos", pick("pl_father").alias("fathers"), pick("pl_mother").alias("mothers"), pick("pl_child").alias("children")))
    return f.select("pos", *[(F.round(c, 4) + 0.0).alias(c) for c in ("lud", "lre", "bf")])


# --- reads


def made_reads(spark: SparkSession, d: str) -> DataFrame:
    """A read of twenty bases for each row of lineitem, with one base of its own and one inserted or deleted."""
    x = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    kind, at = F.col("l_linenumber") % 3, (F.col("l_orderkey") % 16 + 2).cast("int")
    start = (F.col("l_partkey") % 500 + 1).cast("int")
    base = F.substr(F.lit("ACGTACGTACGTACGTACGTACGTACGTACGT"), (start - 1) % 4 + 1, F.lit(20))
    seq = F.concat(F.substr(base, F.lit(1), at - 1), F.lit("T"), F.substr(base, at + 1, F.lit(20)))
    same = F.substr(base, at, F.lit(1)) == "T"
    md = F.when(same, "20").otherwise(F.concat((at - 1).cast("string"), F.substr(base, at, F.lit(1)), (20 - at).cast("string")))
    return x.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("qname"), F.when(F.col("l_orderkey") % 2 == 0, 16).otherwise(0).alias("flag"),
        (F.col("l_suppkey") % 5).cast("string").alias("chrom"), start.alias("pos"), (F.floor("l_quantity")).cast("int").alias("mapq"), F.when(kind == 0, "20M").when(kind == 1, "10M1I9M").otherwise("10M1D10M").alias("cigar"),
        F.lit(None).cast("string").alias("mate_chrom"), F.lit(None).cast("int").alias("mate_pos"), seq.alias("seq"), F.lit("5" * 20).alias("qual"), F.when(kind == 0, md).alias("md"),
    )


READS = """
r AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS chrom, CAST(l_partkey % 500 + 1 AS INT) AS s, l_linenumber % 3 AS k, CAST(l_orderkey % 16 + 2 AS INT) AS own, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS strand, CAST(floor(l_quantity) AS INT) AS mq FROM lineitem WHERE floor(l_quantity) >= 20),
q AS (SELECT *, substr('ACGTACGTACGTACGTACGTACGTACGTACGT', (s - 1) % 4 + 1, 20) AS base FROM r),
w AS (SELECT *, substr(base, 1, own - 1) || 'T' || substr(base, own + 1) AS seq, CASE k WHEN 0 THEN CASE WHEN base[own] = 'T' THEN 0 ELSE 1 END ELSE 1 END AS nm, s + CASE k WHEN 0 THEN 19 WHEN 1 THEN 18 ELSE 20 END AS e FROM q),
b AS (SELECT chrom, strand, mq, nm, CAST(i AS INT) AS cy, CASE WHEN k = 0 OR i <= 10 THEN s + i - 1 WHEN k = 1 THEN s + i - 2 ELSE s + i END AS pos, seq[i] AS alt, CASE WHEN k = 0 THEN base[i] ELSE seq[i] END AS ref FROM (SELECT *, unnest(range(1, 21)) AS i FROM w) WHERE NOT (k = 1 AND i = 11)),
d AS (SELECT chrom, strand, k, s + 9 AS pos, CASE WHEN k = 1 THEN seq[10] ELSE seq[10] || 'N' END AS ref, CASE WHEN k = 1 THEN seq[10:11] ELSE seq[10] END AS alt FROM w WHERE k > 0)"""
G_ORDER = "[[1, 1], [1, 2], [2, 2], [1, 3], [2, 3], [3, 3], [1, 4], [2, 4], [3, 4], [4, 4]]"
CALLED = """
c AS (SELECT * EXCLUDE (raw), list_transform(raw, lambda v: CAST(round(v - list_min(raw)) AS INT)) AS pl FROM g),
o AS (SELECT *, len(list_filter(ad[2:], lambda x: x > 0)) > 0 AS seen FROM c)"""
TOLD = "CAST(dp AS INT) AS dp, array_to_string(ad, ',') AS ad, array_to_string(adr, ',') AS adr, CASE WHEN seen THEN array_to_string(pl, ',') END AS pl, CASE WHEN seen THEN ['0/0', '0/1', '1/1', '0/2', '1/2', '2/2', '0/3', '1/3', '2/3', '3/3'][list_position(pl, 0)] ELSE '0/0' END AS gt FROM o"
BY_COUNTS = "list_transform(" + G_ORDER + "[1:len(ad) * (len(ad) + 1) // 2], lambda t: -10 * list_sum(list_transform(ad, lambda n, i: n * CASE WHEN t[1] = t[2] AND t[1] = i THEN 0.0 WHEN i = t[1] OR i = t[2] THEN -0.30103 + log10(1.1) ELSE -1.0 END)))"


def told(g: DataFrame, *keys: str) -> DataFrame:
    """Genotypes with their lists as text."""
    return g.select(*keys, "dp", *[F.array_join(c, ",").alias(c) for c in ("ad", "adr", "pl")], "gt")


@query(with_(READS) + f" SELECT chrom, pos, {big('sum(n)')} AS depth, {', '.join(big(f'sum(n * CASE WHEN alt = {chr(39)}{x.upper()}{chr(39)} THEN 1 ELSE 0 END)') + f' AS {x}' for x in 'acgt')}, {big('sum(ins)')} AS n_ins, {big('sum(del)')} AS n_del, {big('sum(n * strand)')} AS n_reverse FROM (SELECT chrom, pos, alt, strand, 1 AS n, 0 AS ins, 0 AS del FROM b UNION ALL SELECT chrom, pos, alt, strand, 0, CASE WHEN k = 1 THEN 1 ELSE 0 END, CASE WHEN k = 2 THEN 1 ELSE 0 END FROM d) GROUP BY ALL")
def pileup(spark, d):
    """Depth and bases at every covered position."""
    return reads.pileup(reads.usable(made_reads(spark, d)))


LIKELY = "CASE WHEN {0} >= {1} AND {0} >= {2} THEN {0} WHEN {1} >= {2} THEN {1} ELSE {2} END"


@query(with_(READS, """
n AS (SELECT chrom, pos, count(*) AS n FROM b GROUP BY ALL), f AS (SELECT chrom, pos, ref, count(*) AS re FROM b WHERE ref = alt GROUP BY ALL),
x AS (SELECT chrom, pos, 'base' AS kind, ref, alt, count(*) AS e FROM b WHERE ref <> alt GROUP BY ALL UNION ALL SELECT chrom, pos, 'ins', ref, alt, count(*) FROM d WHERE k = 1 GROUP BY ALL),
y AS (SELECT x.*, coalesce(n.n, e) AS n, greatest(coalesce(n.n, e), e) AS depth, CASE WHEN kind = 'base' THEN coalesce(f.re, 0) END AS re FROM x LEFT JOIN n USING (chrom, pos) LEFT JOIN f ON f.chrom = x.chrom AND f.pos = x.pos AND f.ref = x.ref AND kind = 'base'),
l AS (SELECT *, log10(1 - 1e-3) + CASE WHEN kind = 'base' THEN re * log10(0.99) - 2.0 * e ELSE (depth - e) * log10(0.999) + e * log10(0.001) END AS r0, CASE WHEN kind = 'base' THEN re * log10(0.99) - 2.0 * e ELSE (depth - e) * log10(0.999) + e * log10(0.001) END AS rr,
  log10(1e-3 / 3) + CASE WHEN kind = 'base' THEN re + e ELSE depth END * log10(0.5) AS r1, log10(2e-3 / 3) + CASE WHEN kind = 'base' THEN e * log10(0.99) - 2.0 * re ELSE e * log10(0.999) + (depth - e) * log10(0.001) END AS r2 FROM y),
t AS (SELECT *, """ + LIKELY.format("r0", "r1", "r2") + """ AS top FROM l)""") + " SELECT chrom, CAST(pos AS INT) AS pos, ref, alt, kind, e, n, round(greatest(0.0, -10 * (rr - (top + log10(pow(10.0, r0 - top) + pow(10.0, r1 - top) + pow(10.0, r2 - top))))), 3) AS qual FROM t WHERE e >= 2")
def discover(spark, d):
    """Candidate variants of reads."""
    return reads.discover(reads.usable(made_reads(spark, d))).withColumn("qual", F.round("qual", 3))


LETTER = "'ACGT'[(p - 1) % 4 + 1]"
SITES = f"p AS (SELECT CAST(unnest(range(1, 521)) AS INT) AS p), n AS (SELECT p AS pos, {LETTER} AS ref, 'ACGT'[p % 4 + 1] AS nxt FROM p), chroms AS (SELECT unnest(['0', '1', '2', '3', '4']) AS chrom)"


def made_sites(spark: SparkSession) -> DataFrame:
    """The 520 positions of five contigs that reads can cover, with the reference's base and the one after it."""
    letter = lambda p: F.substr(F.lit("ACGT"), ((p - 1) % 4 + 1).cast("int"), F.lit(1))
    return spark.range(1, 521).select(F.explode(F.array(*[F.lit(str(i)) for i in range(5)])).alias("chrom"), F.col("id").cast("int").alias("pos"), letter(F.col("id")).alias("ref"), letter(F.col("id") + 1).alias("nxt"))


@query(with_(READS, SITES, """
z AS (SELECT chrom, pos, ref, CASE WHEN ref = 'T' THEN ['A', 'C'] WHEN pos % 3 = 0 THEN ['T', nxt] ELSE ['T'] END AS a0 FROM n, chroms), s AS (SELECT chrom, pos, ref, list_distinct(a0) AS al0, CASE WHEN len(list_distinct(a0)) = 1 THEN a0[1:1] ELSE a0 END AS alts FROM z),
k AS (SELECT chrom, pos, alt AS base, count(*) AS c, sum(strand) AS rev FROM b GROUP BY ALL), j AS (SELECT s.chrom, s.pos, s.ref, s.alts, s.i, coalesce(k.c, 0) AS c, coalesce(k.rev, 0) AS rev FROM (SELECT *, unnest(range(1, len(alts) + 2)) AS i FROM s) s LEFT JOIN k ON k.chrom = s.chrom AND k.pos = s.pos AND k.base = list_prepend(s.ref, s.alts)[s.i]),
h AS (SELECT chrom, pos, ref, alts, sum(c) AS dp, list(CAST(c AS INT) ORDER BY i) AS ad, list(CAST(rev AS INT) ORDER BY i) AS adr FROM j GROUP BY ALL HAVING sum(c) > 0),
g AS (SELECT *, list_transform(""" + G_ORDER + """[1:len(ad) * (len(ad) + 1) // 2], lambda t: -10 * list_sum(list_transform(ad, lambda n, i: n * CASE WHEN t[1] = t[2] AND t[1] = i THEN log10(0.99) WHEN t[1] <> t[2] AND (i = t[1] OR i = t[2]) THEN log10(0.5 - 0.01 / 3) ELSE log10(0.01 / 3) END))) AS raw FROM h)""", CALLED) + " SELECT chrom, pos, ref, array_to_string(alts, ',') AS alt, " + TOLD)
def genotype(spark, d):
    """Genotypes of SNP sites, a third of them multi-allelic, at each of the 520 positions reads can cover, from all usable reads."""
    alts = F.when(F.col("ref") == "T", F.array(F.lit("A"), F.lit("C"))).when((F.col("pos") % 3 == 0) & (F.col("nxt") != "T"), F.array(F.lit("T"), F.col("nxt"))).otherwise(F.array(F.lit("T")))
    g = reads.genotype_snps(reads.usable(made_reads(spark, d)), made_sites(spark).withColumn("alts", alts))
    return told(g.withColumn("alt", alts_text()), "chrom", "pos", "ref", "alt")


@query(with_(READS, SITES, """
s AS (SELECT chrom, pos, ref || nxt AS ref, CASE WHEN nxt = 'T' THEN [ref, ref || 'TT'] ELSE [ref, ref || nxt || nxt, ref || 'T' || nxt] END AS alts FROM n, chroms),
v AS (SELECT chrom, s, e, k, strand, seq[11] AS added, count(*) AS c FROM w GROUP BY ALL),
m AS (SELECT s.chrom, s.pos, s.ref, s.alts, v.c, v.strand, CASE WHEN v.k = 0 OR v.s + 9 <> s.pos THEN 1 WHEN v.k = 1 THEN list_position(list_prepend(s.ref, s.alts), s.ref[1] || v.added || s.ref[2]) ELSE 2 END AS i FROM s JOIN v ON v.chrom = s.chrom AND v.s <= s.pos AND v.e >= s.pos + 2),
k AS (SELECT chrom, pos, ref, alts, i, sum(c) AS c, sum(c * strand) AS rev FROM m WHERE i > 0 GROUP BY ALL), x AS (SELECT DISTINCT chrom, pos, ref, alts FROM k),
j AS (SELECT x.chrom, x.pos, x.ref, x.alts, x.i, coalesce(k.c, 0) AS c, coalesce(k.rev, 0) AS rev FROM (SELECT *, unnest(range(1, len(alts) + 2)) AS i FROM x) x LEFT JOIN k ON k.chrom = x.chrom AND k.pos = x.pos AND k.i = x.i),
h AS (SELECT chrom, pos, ref, alts, sum(c) AS dp, list(CAST(c AS INT) ORDER BY i) AS ad, list(CAST(rev AS INT) ORDER BY i) AS adr FROM j GROUP BY ALL),
g AS (SELECT *, """ + BY_COUNTS + " AS raw FROM h)", CALLED) + " SELECT chrom, pos, ref, array_to_string(alts, ',') AS alt, " + TOLD)
def genotype_indels(spark, d):
    """Genotypes of a deletion and one or two insertions at each of the 520 positions, from all usable reads."""
    r, n = F.col("ref"), F.col("nxt")
    alts = F.when(n == "T", F.array(r, F.concat(r, F.lit("TT")))).otherwise(F.array(r, F.concat(r, n, n), F.concat(r, F.lit("T"), n)))
    sites = made_sites(spark).withColumn("alts", alts).withColumn("ref", F.concat("ref", "nxt"))
    return told(reads.genotype_indels(reads.usable(made_reads(spark, d)), sites).withColumn("alt", alts_text()), "chrom", "pos", "ref", "alt")


@query(with_(READS, SITES, """
v AS (SELECT chrom, s, e, k, strand, count(*) AS c FROM w GROUP BY ALL),
m AS (SELECT t.chrom, n.pos, v.c, v.strand, CASE WHEN v.k > 0 AND v.s + 9 BETWEEN n.pos - 1 AND n.pos + 3 THEN 4 - v.k ELSE 1 END AS i FROM n CROSS JOIN chroms t JOIN v ON v.chrom = t.chrom AND v.s <= n.pos - 1 AND v.e >= n.pos + 4),
k AS (SELECT chrom, pos, i, sum(c) AS c, sum(c * strand) AS rev FROM m GROUP BY ALL),
j AS (SELECT x.chrom, x.pos, x.i, coalesce(k.c, 0) AS c, coalesce(k.rev, 0) AS rev FROM (SELECT DISTINCT chrom, pos, unnest([1, 2, 3]) AS i FROM k) x LEFT JOIN k USING (chrom, pos, i)),
h AS (SELECT chrom, pos, sum(c) AS dp, list(CAST(c AS INT) ORDER BY i) AS ad, list(CAST(rev AS INT) ORDER BY i) AS adr FROM j GROUP BY ALL),
g AS (SELECT *, """ + BY_COUNTS + " AS raw FROM h)", CALLED) + " SELECT chrom, pos AS beg1, CAST(pos + 3 AS INT) AS end1, '4,3,5' AS lengths, " + TOLD)
def genotype_repeats(spark, d):
    """Genotypes of tracts of four bases that may have one less or one more, told by their length."""
    sites = made_sites(spark).select("chrom", F.col("pos").alias("beg1"), (F.col("pos") + 3).alias("end1"), F.array(F.lit(3), F.lit(5)).alias("alt_lengths"))
    g = reads.genotype_repeats(reads.usable(made_reads(spark, d)), sites)
    return told(g.withColumn("lengths", F.array_join("lengths", ",")), "chrom", "beg1", "end1", "lengths")


@query(with_(READS, SITES) + f" SELECT b.chrom, n.pos, n.ref, CAST(count(*) AS INT) AS n, {big('sum(mq)')} AS mq, {big('sum(cy)')} AS cy, {big('sum(strand)')} AS n_reverse, {big('sum(CASE WHEN alt = nxt THEN 1 ELSE 0 END)')} AS n_alt, {big('sum(CASE WHEN alt NOT IN (n.ref, nxt) THEN 1 ELSE 0 END)')} AS n_other, {big('sum(nm)')} AS nm FROM b JOIN n ON n.pos = b.pos GROUP BY ALL")
def site_reads(spark, d):
    """What the reads of each site say: the lists of qualities, cycles, strands, alleles and mismatches, summed up."""
    x = reads.site_reads(reads.usable(made_reads(spark, d)), made_sites(spark).withColumn("alts", F.array("nxt")))
    total = lambda c, f=lambda v: v: F.aggregate(c, F.lit(0).cast("long"), lambda acc, v: acc + f(v))
    one = lambda c: F.when(c, 1).otherwise(0)
    return x.select("chrom", "pos", "ref", F.size("bq").alias("n"), total("mq").alias("mq"), total("cy").alias("cy"), total("st", lambda v: one(v == "R")).alias("n_reverse"), total("al", lambda v: one(v == 1)).alias("n_alt"), total("al", lambda v: one(v == -1)).alias("n_other"), total("nm").alias("nm"))


@query("WITH v AS (SELECT rid, beg1, end1 FROM vntr WHERE rid IS NOT NULL AND end1 >= beg1), e AS (SELECT rid, beg1 AS p, 1 AS x FROM v UNION ALL SELECT rid, end1 + 1, -1 FROM v), s AS (SELECT rid, p, sum(x) AS x FROM e GROUP BY ALL HAVING sum(x) <> 0), w AS (SELECT rid, p, sum(x) OVER (PARTITION BY rid ORDER BY p) AS depth, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM s) SELECT rid, CAST(p AS INT) AS beg1, CAST(nxt - 1 AS INT) AS end1, CAST(depth AS BIGINT) AS depth FROM w WHERE depth > 0")
def coverage(spark, d):
    """Stretches of constant depth of repeats."""
    return reads.coverage(table(spark, d, "vntr", "rid", "beg1", "end1"))


# --- features from reads, evidence, sessions


READ_FEATURES = with_("""
r AS (SELECT CAST(l_partkey + 1 AS INT) AS pos, l_suppkey % 30 AS k, CASE WHEN l_linenumber = 7 THEN -1 ELSE l_orderkey % 2 END AS al, least(CAST(floor(l_quantity) AS INT), 40) AS q, l_linenumber * 8 AS mq, -ln(l_linenumber + 1.0) AS td, l_partkey % 2 AS st,
  CASE WHEN l_linenumber <> 7 AND l_orderkey % 2 > 0 THEN l_linenumber - 1 ELSE l_linenumber END AS nm, CASE WHEN (l_partkey + l_suppkey % 30) % 2 = 0 THEN 1 ELSE 2 END AS g FROM lineitem)""", """
s AS (SELECT pos, k, max(g) AS g, CAST(count(*) FILTER (al >= 0) AS DOUBLE) AS n, CAST(count(*) FILTER (al > 0) AS DOUBLE) AS a, CAST(count(*) FILTER (q > 20) AS DOUBLE) AS good, CAST(count(*) FILTER (al < 0 AND q > 20) AS DOUBLE) AS odd,
  coalesce(sum(pow(10.0, -q / 10.0) * 2 / 3) FILTER (q > 20), 0) AS due, coalesce(sum(nm) FILTER (al > 0), 0) AS nma, coalesce(sum(nm) FILTER (al >= 0), 0) AS nms,
  CAST(coalesce(sum(q) FILTER (al > 0), 0) AS DOUBLE) AS bqx, CAST(coalesce(sum(q) FILTER (al >= 0), 0) AS DOUBLE) AS bq1, CAST(coalesce(sum(q * q) FILTER (al >= 0), 0) AS DOUBLE) AS bq2 FROM r GROUP BY pos, k)""") + """
SELECT pos, round(coalesce(sum(ln(n + 1) * (n - a + 0.05) / (n + 0.1)) FILTER (g = 1) / (sum(ln(n + 1)) FILTER (g = 1) + 1e-6), 0), 6) AS abe,
 round(coalesce(sum(ln(n + 1) * CASE WHEN n > 0 THEN sqrt(n) * (bqx / n - bq1 * a / n / n) / sqrt((bq2 / n - (bq1 / n) * (bq1 / n)) * (a / n - (a / n) * (a / n)) + 0.1) ELSE 0 END) FILTER (g = 1) / sqrt(sum(ln(n + 1) * ln(n + 1)) FILTER (g = 1) + 1e-6), 0), 6) AS bqz,
 round(log10(sum(ln(good + 1) * odd / (due + 1e-6)) / nullif(sum(ln(good + 1)), 0) + 1e-6), 6) AS ior,
 round(coalesce(sum(ln(a + 1) * CASE WHEN a > 0 THEN nma / a ELSE 0 END) / (sum(ln(a + 1)) + 1e-6), 0), 6) AS nm1 FROM s GROUP BY pos"""


@query(READ_FEATURES)
def paste_and_compute_features_sequential(spark, d):
    """Features of sites from the reads of many samples."""
    from stranda.operators.evidence import read_features

    x = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    k = F.col("l_suppkey") % 30
    r = x.select(
        (F.col("l_partkey") + 1).cast("int").alias("pos"), k.alias("sample"), F.when(F.col("l_linenumber") == 7, -1).otherwise(F.col("l_orderkey") % 2).alias("al"), F.floor("l_quantity").cast("int").alias("bq"), (F.col("l_linenumber") * 8).alias("mq"),
        F.col("l_linenumber").alias("cy"), (F.col("l_partkey") % 2).alias("st"), F.col("l_linenumber").alias("nm"), F.when((F.col("l_partkey") + k) % 2 == 0, 1).otherwise(2).alias("g"),
    )
    return read_features(r, ["pos"]).select("pos", "abe", "bqz", "ior", "nm1")


@query()
def paste_genotypes(spark, d):
    """Most probable genotypes of all samples of a site."""
    from stranda.operators.evidence import call_genotypes

    return call_genotypes(features.gathered(sampled(spark, d), ["pos"], ["k"])).select("pos", "gts", "gqs", "called_ac", "called_an", "called_qual")


@query(with_(RECORDS) + " SELECT n, e, e >= 2 AND e / n >= 0.2 AS enough, count(*) AS c FROM records GROUP BY ALL")
def evidence_filter(spark, d):
    """Records with enough reads behind them."""
    from stranda.operators.evidence import enough_evidence

    v = variant_rows(spark, d)
    return v.groupBy("n", "e", enough_evidence(F.col("e"), F.col("n"), 2, 0.2).alias("enough")).agg(F.count("*").alias("c"))


@query("WITH r AS (SELECT DISTINCT l_extendedprice AS q FROM lineitem) SELECT q, CAST(row_number() OVER (ORDER BY q) AS INT) AS place, count(*) OVER () AS n FROM r")
def svm_train(spark, d):
    """Places of values behind their normal scores: the preparation of a classifier's features."""
    from stranda.operators.evidence import inverse_normal, normal_share

    x = table(spark, d, "lineitem", F.col("l_extendedprice").alias("q"))
    s = inverse_normal(x, "q", "z").groupBy("q").agg(F.first("z").alias("z"))
    n = s.agg(F.count("*").alias("n"))
    return beside(s, n).select("q", F.round(normal_share(F.col("z")) * (F.col("n") + 1)).cast("int").alias("place"), "n")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, d):
    """Runs of events no more than half an hour apart."""
    from stranda.streaming.variants import sessions as sessionize

    return sessionize(table(spark, d, "events", "user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")
