"""The registered queries of the interval, reject, run, skew and drift operators, with SQL for those SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stranda.operators import drift, intervals, rejects, runs, skew
from stranda.session import table, with_rid


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    contigs = table(spark, d, "contig", "rid", "contig_name")
    v = table(spark, d, "vntr", "set_id", "rid", "chrom", "beg1", "end1").where("chrom is not null and rid is not null")
    b = with_rid(table(spark, d, "bed_record", "track_id", "chrom", "beg1", "end1"), contigs, "chrom").where("rid is not null")
    rows = v.select(F.lit("vntr").alias("src"), "set_id", "rid", "beg1", "end1").unionByName(b.select(F.lit("bed_record").alias("src"), F.col("track_id").alias("set_id"), "rid", "beg1", "end1"))
    return intervals.periods_and_gaps(rows, ["src", "set_id", "rid"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.failing(table(spark, d, "raw_call"), table(spark, d, "raw_bed"), table(spark, d, "contig"))


def p2_calls(spark: SparkSession, d: str) -> DataFrame:
    return rejects.load_lines(table(spark, d, "raw_call"), table(spark, d, "contig"), "call").where("reason is null").drop("reason")


def p2_regions(spark: SparkSession, d: str) -> DataFrame:
    return rejects.load_lines(table(spark, d, "raw_bed"), table(spark, d, "contig"), "bed").where("reason is null").drop("reason")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.repeat_runs(table(spark, d, "vntr", "row_id", "vntr_id", "set_id", "ord", "rid", "motif", "ru", "repeat_tract", "beg1", "end1"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapsed(table(spark, d, "vntr", "row_id", "vntr_id", "set_id", "ord", "rid", "motif", "ru", "repeat_tract", "beg1", "end1"))


def p4_per_contig(spark: SparkSession, d: str) -> DataFrame:
    return skew.per_contig(table(spark, d, "vntr", "rid", "beg1", "end1"), table(spark, d, "bed_record", "chrom", "beg1", "end1"), table(spark, d, "contig", "rid", "contig_name"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_contigs(p4_per_contig(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift(table(spark, d, "call_file"), table(spark, d, "genotype")).select("run_id", "file_id", "tag", "drift")


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "call_file"), table(spark, d, "genotype"))


KEY = "regexp_replace(lower(trim(chrom, ' ')), '^chr', '')"
P1_SQL = f"""
WITH every AS (
  SELECT 'vntr' AS src, set_id, rid, beg1, end1 FROM vntr WHERE chrom IS NOT NULL AND rid IS NOT NULL AND end1 >= beg1
  UNION ALL
  SELECT 'bed_record', track_id, c.rid, beg1, end1 FROM bed_record b JOIN contig c ON lower(c.contig_name) = {KEY} WHERE end1 >= beg1
), rows AS (
  SELECT src, set_id, rid, beg1, max(end1) AS end1 FROM every GROUP BY src, set_id, rid, beg1
), seen AS (
  SELECT *, max(end1) OVER (PARTITION BY src, set_id, rid ORDER BY beg1, end1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM rows
), labelled AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR beg1 > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY src, set_id, rid ORDER BY beg1, end1 ROWS UNBOUNDED PRECEDING) AS isl FROM seen
), periods AS (
  SELECT src, set_id, rid, isl, min(beg1) AS beg1, max(end1) AS end1 FROM labelled GROUP BY src, set_id, rid, isl
), gaps AS (
  SELECT src, set_id, rid, lag(end1) OVER (PARTITION BY src, set_id, rid ORDER BY beg1) + 1 AS beg1, beg1 - 1 AS end1 FROM periods
)
SELECT src, set_id, rid, 'period' AS piece, beg1, end1 FROM periods
UNION ALL SELECT src, set_id, rid, 'gap' AS piece, beg1, end1 FROM gaps WHERE beg1 IS NOT NULL
"""
P4_ROWS = f"""
WITH rows AS (
  SELECT 'vntr' AS src, CASE WHEN rid IN (SELECT rid FROM contig) THEN rid END AS rid, beg1, end1 FROM vntr
  UNION ALL
  SELECT 'bed_record', c.rid, beg1, end1 FROM bed_record b LEFT JOIN contig c ON lower(c.contig_name) = {KEY}
)
"""
P3_SQL = """
WITH one AS (
  SELECT set_id, vntr_id, min_by(ord, row_id) AS ord, min_by(rid, row_id) AS rid, min_by(upper(coalesce(motif, ru)), row_id) AS unit,
         arg_min_null(upper(repeat_tract), row_id) AS tract, arg_min_null(beg1, row_id) AS beg1, arg_min_null(end1, row_id) AS end1
  FROM vntr WHERE set_id IS NOT NULL AND vntr_id IS NOT NULL AND ord IS NOT NULL GROUP BY set_id, vntr_id
), seen AS (
  SELECT *, lag(rid) OVER w AS prid, lag(unit) OVER w AS punit, lag(tract) OVER w AS ptract FROM one WINDOW w AS (PARTITION BY set_id ORDER BY ord, vntr_id)
), marked AS (
  SELECT *, CASE WHEN rid = prid AND length(unit) = length(punit) AND contains(punit || punit, unit)
                  AND abs(length(tract) - length(ptract)) <= 2 AND levenshtein(tract, ptract) <= 2 THEN 0 ELSE 1 END AS fresh FROM seen
), runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY set_id ORDER BY ord, vntr_id ROWS UNBOUNDED PRECEDING) AS run FROM marked
)
SELECT set_id, arg_min(vntr_id, ord) AS first_id, arg_max(vntr_id, ord) AS last_id, count(*) AS n_records,
       CAST(max(end1) AS BIGINT) - min(beg1) + 1 AS n_bases
FROM runs GROUP BY set_id, run HAVING count(*) > 1
"""

P3_COLLAPSED = P3_SQL.split("SELECT set_id, arg_min(vntr_id, ord)")[0].replace("upper(repeat_tract), row_id) AS tract,", "upper(repeat_tract), row_id) AS tract, arg_min_null(motif, row_id) AS motif, arg_min_null(ru, row_id) AS ru,") + """
SELECT set_id, arg_min(vntr_id, (ord, vntr_id)) AS vntr_id, arg_min_null(rid, (ord, vntr_id)) AS rid, arg_min_null(motif, (ord, vntr_id)) AS motif, arg_min_null(ru, (ord, vntr_id)) AS ru, arg_min(ord, (ord, vntr_id)) AS ord,
       min(beg1) AS beg1, max(end1) AS end1, count(*) AS n_records, CAST(max(end1) AS BIGINT) - min(beg1) + 1 AS n_bases
FROM runs GROUP BY set_id, run"""
# The lines cut by a pattern, without a CSV reader.
WHOLE = "(regexp_full_match({0}, '[0-9]+') AND coalesce(try_cast({0} AS HUGEINT), 9999999999) <= 2147483647)"
LINES = """SELECT line_id, CASE WHEN ends_with(raw_line, chr(13)) THEN raw_line[1:-2] ELSE raw_line END AS l FROM {}"""
P2_ROWS = f"""
WITH c0 AS ({LINES.format('raw_call')}), c1 AS (
  SELECT line_id, l, regexp_full_match(l, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS well,
         list_transform(regexp_extract_all(',' || l, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS f
  FROM c0 WHERE trim(l, ' ') <> '' AND NOT starts_with(l, '#')
), c2 AS (
  SELECT line_id, l, well, f, k.rid, k.contig_len, CASE WHEN f[4] = '.' THEN 0 ELSE length(f[4]) - length(replace(f[4], ',', '')) + 1 END AS n,
         string_split(replace(f[6], '|', '/'), '/') AS a, string_split(f[8], ',') AS p
  FROM c1 LEFT JOIN contig k ON lower(k.contig_name) = regexp_replace(lower(trim(f[1], ' ')), '^chr', '')
), calls AS (
  SELECT *, CASE WHEN NOT well THEN 'quoting' WHEN len(f) <> 8 THEN 'columns' WHEN rid IS NULL THEN 'chrom' WHEN NOT {WHOLE.format('f[2]')} OR try_cast(f[2] AS BIGINT) NOT BETWEEN 1 AND contig_len THEN 'pos'
    WHEN len(a) > 2 OR len(list_filter(a, lambda x: x <> '.' AND NOT ({WHOLE.format('x')} AND try_cast(x AS BIGINT) <= n))) > 0 THEN 'gt' WHEN f[7] <> '.' AND NOT {WHOLE.format('f[7]')} THEN 'dp'
    WHEN f[8] <> '.' AND (len(list_filter(p, lambda x: x <> '.' AND NOT {WHOLE.format('x')})) > 0 OR len(p) <> CASE WHEN len(a) = 1 AND a[1] <> '.' THEN n + 1 ELSE (n + 1) * (n + 2) // 2 END) THEN 'pl' END AS reason FROM c2
), b0 AS ({LINES.format('raw_bed')}), b1 AS (
  SELECT line_id, string_split(l, chr(9)) AS f FROM b0 WHERE trim(l, ' ') <> '' AND NOT starts_with(l, '#') AND NOT starts_with(l, 'track') AND NOT starts_with(l, 'browser')
), beds AS (
  SELECT line_id, f, k.rid, CASE WHEN len(f) NOT BETWEEN 3 AND 6 THEN 'columns' WHEN k.rid IS NULL THEN 'chrom' WHEN NOT {WHOLE.format('f[2]')} THEN 'beg'
    WHEN NOT {WHOLE.format('f[3]')} OR try_cast(f[3] AS BIGINT) <= try_cast(f[2] AS BIGINT) OR try_cast(f[3] AS BIGINT) > k.contig_len THEN 'end' END AS reason
  FROM b1 LEFT JOIN contig k ON lower(k.contig_name) = regexp_replace(lower(trim(f[1], ' ')), '^chr', '')
)"""

QUERIES = {q.__name__: q for q in (p1_found, p2_found, p2_calls, p2_regions, p3_found, p3_collapsed, p4_found, p4_per_contig, p5_found, p5_unified)}
SQL = {
    "p1_found": P1_SQL,
    "p3_found": P3_SQL,
    "p4_found": P4_ROWS + ", n AS (SELECT src, rid, count(*) AS n FROM rows GROUP BY src, rid) SELECT src, rid FROM n WHERE rid IS NOT NULL AND n >= 0.05 * (SELECT sum(m.n) FROM n m WHERE m.src = n.src)",
    "p4_per_contig": P4_ROWS + """
SELECT src, rid, count(*) AS n_rows, CAST(count(CASE WHEN end1 >= beg1 THEN 1 END) AS BIGINT) AS n_valid,
       CAST(coalesce(sum(CASE WHEN end1 >= beg1 THEN end1 - beg1 + 1 END), 0) AS BIGINT) AS n_bases,
       CAST(min(CASE WHEN end1 >= beg1 THEN beg1 END) AS BIGINT) AS min_beg, CAST(max(CASE WHEN end1 >= beg1 THEN end1 END) AS BIGINT) AS max_end
FROM rows GROUP BY src, rid""",
    "p3_collapsed": P3_COLLAPSED,
    "p2_found": P2_ROWS + " SELECT 'raw_call' AS src, line_id, reason FROM calls WHERE reason IS NOT NULL UNION ALL SELECT 'raw_bed', line_id, reason FROM beds WHERE reason IS NOT NULL",
    "p2_regions": P2_ROWS + " SELECT line_id, rid, CAST(try_cast(f[2] AS INT) + 1 AS INT) AS beg1, try_cast(f[3] AS INT) AS end1, f[4] AS name, f[5] AS score, f[6] AS strand FROM beds WHERE reason IS NULL",
    "p2_calls": P2_ROWS + " SELECT line_id, rid, try_cast(f[2] AS INT) AS pos, f[3] AS ref, CASE WHEN f[4] = '.' THEN [] ELSE string_split(f[4], ',') END AS alts, f[5] AS sample, f[6] AS gt, try_cast(f[7] AS INT) AS dp, CASE WHEN f[8] <> '.' THEN list_transform(p, lambda x: try_cast(x AS INT)) END AS pl FROM calls WHERE reason IS NULL",
}
