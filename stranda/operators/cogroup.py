"""Records of several files brought together by variant: the same contig, position and set of alleles.

All operators take one DataFrame with a file_index column (or make it from a list of files), so n files cost one
shuffle, whatever n. Order inside a group is that of file_index and the input order column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stranda.functions import alleles as A

KEY = ["rid", "pos", "akey"]
PLACE = ["rid", "pos"]


def stack(files: list[DataFrame], check_samples: bool = False, sample_column: str = "samples") -> DataFrame:
    """All files' rows with their file_index, columns that a file lacks null. With check_samples files whose sample
    lists differ are an error."""
    if check_samples and len(files) > 1:
        lists = [[r[0] for r in f.select(F.transform(sample_column, lambda s: s["sample"])).limit(1).collect()] for f in files]
        if any(x and lists[0] and x != lists[0] for x in lists):
            raise ValueError("the files' samples differ")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("file_index", F.lit(i)) for i, f in enumerate(files)])


def keyed(df: DataFrame, ref: str = "ref", alts: str = "alts") -> DataFrame:
    """df with akey, REF and the ALTs in byte order, so that the order of ALTs doesn't matter."""
    return df.withColumn("akey", A.allele_key(F.col(ref), F.coalesce(F.col(alts), F.array().cast("array<string>"))))


def by_position(df: DataFrame, fields: tuple[str, ...], order: str = "row_id") -> DataFrame:
    """rid, pos, files, n_files: the records of all files at one contig and position, whatever their alleles.

    files holds (file_index, records) by file_index, records the fields of the file's records there, in input order:
    repeated positions within a file stay side by side. Null places are a place like any other. A file's records at one
    place are gathered, as many as there are alleles and repetitions at it, never those of a contig.
    """
    own = df.groupBy(*PLACE, "file_index").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *fields))), lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias("records"))
    g = own.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("file_index", "records"))).alias("files"))
    return g.withColumn("n_files", F.size("files"))


def contig_conflicts(contigs: DataFrame) -> DataFrame:
    """file_index, contig, rid, first_rid, length, first_length: contigs of a file that the file of the least index with
    that contig gives another place in its order or another length; contigs has file_index, contig, rid and length.

    Files whose conflicts are empty can be brought together by rid. A length that a header leaves out conflicts with none.
    """
    first = contigs.groupBy("contig").agg(F.min_by(F.struct("rid", "length"), "file_index").alias("f"))
    other = (F.col("rid") != F.col("f.rid")) | F.coalesce(F.col("length") != F.col("f.length"), F.lit(False))
    return contigs.join(first, "contig").where(other).select("file_index", "contig", "rid", F.col("f.rid").alias("first_rid"), "length", F.col("f.length").alias("first_length"))


def unique(df: DataFrame, order: str) -> DataFrame:
    """The first record of each variant in input order, n_records, and old_variants: the others' spellings, where they
    differ from the first's, sorted. Null positions or alleles are a key like any other."""
    columns = [c for c in df.columns]
    spelt = A.variant_key(F.coalesce(F.col("chrom"), F.lit(".")), F.coalesce("pos", F.lit(0)), F.coalesce("ref", F.lit(".")), F.coalesce(F.col("alts"), F.array().cast("array<string>")))
    g = keyed(df).withColumn("_v", spelt).groupBy(*KEY).agg(F.min_by(F.struct(*columns, "_v"), F.col(order)).alias("r"), F.count("*").alias("n_records"), F.collect_set("_v").alias("_all"))
    return g.select("r.*", "n_records", F.array_sort(F.array_except("_all", F.array("r._v"))).alias("old_variants")).drop("_v")


def venn(df: DataFrame, measures: tuple[str, ...] = ("ts", "tv", "ins", "del"), vtype: int | None = None) -> DataFrame:
    """mask, n and the sums of the measures over the variants that exactly the files of the mask have (bit i: file i),
    with vtype over those of that type alone. Variants are counted by their alleles, and each different pair of REF and
    ALTs is classified once, however many variants have it."""
    sites = keyed(df).groupBy(*KEY).agg(F.bit_or(F.expr("shiftleft(1, file_index)")).alias("mask"), F.min(F.struct("ref", "alts")).alias("x"))
    kinds = A.classified(sites.groupBy("mask", "akey").agg(F.count("*").alias("n"), F.first("x").alias("x")).select("mask", "x.ref", "x.alts", "n"))
    kept = kinds if vtype is None else kinds.where(F.col("vtype") == vtype)
    return kept.groupBy("mask").agg(F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(c) for c in measures])


def partition_counts(df: DataFrame, measures: tuple[str, ...] = ("ts", "tv", "ins", "del"), vtype: int | None = None) -> DataFrame:
    """part (A-B, A&B, B-A), n and the sums of the measures."""
    v = venn(df.where("file_index in (0, 1)"), measures, vtype)
    name = F.when(F.col("mask") == 1, "A-B").when(F.col("mask") == 2, "B-A").otherwise("A&B")
    return v.select(name.alias("part"), "n", *measures)


def presence(df: DataFrame, wanted: set[int], absent: set[int] = frozenset()) -> DataFrame:
    """The first record of each variant that all wanted files have and none of the absent ones."""
    need, bar = sum(1 << i for i in wanted), sum(1 << i for i in absent)
    columns = df.columns
    g = keyed(df).groupBy(*KEY).agg(F.bit_or(F.expr("shiftleft(1, file_index)")).alias("_mask"), F.min_by(F.struct(*columns), F.struct("file_index", *[c for c in ("ord", "row_id") if c in columns])).alias("r"))
    return g.where((F.col("_mask").bitwiseAND(need) == need) & (F.col("_mask").bitwiseAND(bar) == 0)).select("r.*")


def union_variants(df: DataFrame, labels: list[str]) -> DataFrame:
    """chrom, pos, ref, alts_key, centers (labels of the files that have the variant, in file order), n_centers."""
    label = F.array(*[F.lit(x) for x in labels])
    g = keyed(df).groupBy("chrom", *KEY).agg(F.array_sort(F.collect_set("file_index")).alias("files"))
    centers = F.array_distinct(F.transform("files", lambda i: F.get(label, i)))
    return g.select("chrom", "rid", "pos", "akey", F.array_join(centers, ",").alias("centers"), F.size(centers).alias("n_centers"))


def repeated_samples(df: DataFrame, sample: str = "sample_id") -> DataFrame:
    """sample, n_files: the sample names that stand in more than one file."""
    return df.groupBy(F.col(sample).alias("sample")).agg(F.countDistinct("file_index").alias("n_files")).where("n_files > 1")


def merge_samples(df: DataFrame, sample: str = "sample_id", fields: tuple[str, ...] = ("gt",), order: str = "row_id", strict: bool = False) -> DataFrame:
    """One row a variant with samples: (sample, fields) of all files, by name; of a sample's several records in one
    variant the first in input order counts. Absent fields are null. With strict a sample name that stands in more than
    one file is an error, found by one aggregation beforehand."""
    if strict:
        twice = [r[0] for r in repeated_samples(df, sample).limit(5).collect()]
        if twice:
            raise ValueError(f"sample names in several files: {twice}")
    one = keyed(df).groupBy(*KEY, sample).agg(F.min_by(F.struct(*fields), F.col(order)).alias("f"))
    return one.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("sample"), *[F.col(f"f.{x}").alias(x) for x in fields]))).alias("samples"))


def paste(left: DataFrame, right: DataFrame, order: str, sample_column: str = "samples", agree: tuple[str, ...] = ()) -> DataFrame:
    """Row i of one file with row i of the other: the left row with the samples of both.

    The files must have the same rows: a row without a partner, and one whose columns named in agree (such as the FORMAT)
    differ between the files, ends the query with an error that names it. Nulls agree with nulls.
    """
    r = right.select(F.col(order).alias("_o"), F.col(sample_column).alias("_s"), *[F.col(c).alias(f"_{c}") for c in agree])
    both = left.join(r, left[order] == r["_o"], "full")
    fault = F.when(F.col(order).isNull() | F.col("_o").isNull(), F.concat(F.lit("row without a partner: "), F.coalesce(F.col(order), F.col("_o")).cast("string")))
    for c in agree:
        fault = F.coalesce(fault, F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.concat(F.lit(f"{c} differs in row "), F.col(order).cast("string"))))
    samples = F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.concat(sample_column, "_s"))
    return both.select(*[samples.alias(c) if c == sample_column else F.col(f"`{c}`") for c in left.columns])


def merge_candidates(df: DataFrame, snp_cutoff: float = 30.0, indel_cutoff: float = 30.0) -> DataFrame:
    """rid, pos, akey, nsamples, samples (the first ten by name), esum, nsum, max_qual of the variants one of whose
    records reaches the cutoff of its type. df has sample_id, qual (null counts as 0), e and n."""
    q = F.coalesce("qual", F.lit(0.0).cast("float"))
    cutoff = F.when(A.has_indel(F.col("ref"), F.col("alts")), F.lit(indel_cutoff)).otherwise(F.lit(snp_cutoff))
    g = keyed(df).where(q >= cutoff).groupBy(*KEY)
    return g.agg(F.countDistinct("sample_id").alias("nsamples"), F.slice(F.array_sort(F.collect_set("sample_id")), 1, 10).alias("samples"), F.sum("e").alias("esum"), F.sum("n").alias("nsum"), F.max(q).alias("max_qual"))


def merge_genotypes(sites: DataFrame, calls: DataFrame, files: int) -> DataFrame:
    """Candidate sites that every one of the files has, with each file's first call: (file_index, gt, pl).

    A call without a PL but with a BQSUM is homozygous for REF with the likelihoods 0, BQSUM/3, BQSUM."""
    hom = F.array(F.lit(0), (F.col("bqsum") / 3).cast("int"), F.col("bqsum").cast("int"))
    c = keyed(calls).withColumn("pl", F.coalesce("pl", F.when(F.col("bqsum").isNotNull(), hom)))
    first = c.groupBy(*KEY, "file_index").agg(F.min_by(F.struct("gt", "pl"), F.col("row_id")).alias("x"))
    g = first.join(keyed(sites).select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY)
    return g.agg(F.array_sort(F.collect_list(F.struct("file_index", "x.gt", "x.pl"))).alias("calls")).where(F.size("calls") == files)


def annotate_id(df: DataFrame, known: DataFrame, column: str = "id") -> DataFrame:
    """df with the id of the known variant of the same key (the least, if there are several), null if there is none."""
    ids = keyed(known).groupBy(*KEY).agg(F.min(column).alias("_known"))
    return keyed(df).join(ids, KEY, "left").withColumn(column, F.col("_known")).drop("_known", "akey")


def annotate_known(df: DataFrame, known: DataFrame, flag: str) -> DataFrame:
    """df with a flag: whether known has the variant."""
    seen = keyed(known).select(*KEY).distinct().withColumn(flag, F.lit(True))
    return keyed(df).join(seen, KEY, "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("akey")


def genotype_class(gt: Column) -> Column:
    """0 to 2 copies of ALT of a genotype (array of alleles), 3 for one that is missing or not of two alleles."""
    complete = (F.size(gt) == 2) & F.forall(gt, lambda a: a.isNotNull())
    return F.when(complete, F.size(F.filter(gt, lambda a: a > 0))).otherwise(3)


def concordance(a: DataFrame, b: DataFrame, by: str = "sample") -> DataFrame:
    """by (sample, or the variant's key), g1, g2, n: how often file a has the genotype class g1 where b has g2.

    a and b have rid, pos, ref, alts, sample and gt; only biallelic variants and samples that both have are counted, the
    first call of a sample in a file by its gt's text."""
    def calls(df: DataFrame, name: str) -> DataFrame:
        k = keyed(df.where(F.size("alts") == 1)).select(*KEY, "sample", genotype_class(F.col("gt")).alias(name))
        return k.groupBy(*KEY, "sample").agg(F.min(name).alias(name))

    both = calls(a, "g1").join(calls(b, "g2"), [*KEY, "sample"])
    return both.groupBy(*(["sample"] if by == "sample" else KEY), "g1", "g2").agg(F.count("*").alias("n"))


def truth_status(a: DataFrame, truth: DataFrame) -> DataFrame:
    """status (tp, fp, fn, tn, other), n: whether a variant call of a is one in truth, over biallelic variants of either."""
    call = lambda df, name: keyed(df.where(F.size("alts") == 1)).groupBy(*KEY).agg(F.min(genotype_class(F.col("gt"))).alias(name))
    both = call(a, "g").join(call(truth, "t"), KEY, "full")
    g, t = F.coalesce("g", F.lit(0)), F.coalesce("t", F.lit(0))
    status = F.when((g == 3) | (t == 3), "other").when((g > 0) & (t > 0), "tp").when(g > 0, "fp").when(t > 0, "fn").otherwise("tn")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def truth_matrix(a: DataFrame, truth: DataFrame) -> DataFrame:
    """g, t, n: genotype classes of a's variants against those of truth, 3 for one that a side misses or has no whole
    genotype of; the two sides' biallelic variants, at most sixteen rows."""
    call = lambda df, name: keyed(df.where(F.size("alts") == 1)).groupBy(*KEY).agg(F.min(genotype_class(F.col("gt"))).alias(name))
    both = call(a, "g").join(call(truth, "t"), KEY, "full")
    return both.groupBy(F.coalesce("g", F.lit(3)).alias("g"), F.coalesce("t", F.lit(3)).alias("t")).agg(F.count("*").alias("n"))


def subset_samples(df: DataFrame, names: list[str]) -> DataFrame:
    """Records with the named samples alone, ac (copies of the first ALT) and an (called alleles) counted anew; records
    that are not polymorphic among them (ac 0 or all of an) go. samples holds (sample, gt)."""
    kept = F.filter("samples", lambda s: s["sample"].isin(*names))
    called = F.flatten(F.transform("samples", lambda s: F.filter(s["gt"], lambda a: a.isNotNull())))
    out = df.withColumn("samples", kept).withColumn("an", F.size(called)).withColumn("ac", F.size(F.filter(called, lambda a: a == 1)))
    return out.where((F.col("ac") > 0) & (F.col("ac") < F.col("an")))
