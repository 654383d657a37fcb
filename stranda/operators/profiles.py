"""Summaries of whole call sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stranda.functions import alleles as A
from stranda.functions import sequences as S


def peek(df: DataFrame) -> DataFrame:
    """vt, n_alt (1, 2, 3, 4 for four and more, null for the sum over all), n, ts, tv, ins, del; vt null for all types."""
    alts = F.coalesce(F.col("alts"), F.array().cast("array<string>"))
    # Records are counted by their alleles first, so that each different pair of REF and ALTs is classified once.
    pairs = A.classified(df.groupBy("ref", alts.alias("alts")).agg(F.count("*").alias("n")))
    c = pairs.select(A.type_name(F.col("vtype")).alias("vt"), F.least(F.size("alts"), F.lit(4)).alias("n_alt"), "n", *[(F.col(x) * F.col("n")).alias(x) for x in ("ts", "tv", "ins", "del")])
    return c.rollup("vt", "n_alt").agg(*[F.sum(x).alias(x) for x in ("n", "ts", "tv", "ins", "del")])


def structural_tree(df: DataFrame) -> DataFrame:
    """prefix, depth, n: symbolic alleles counted at every level of their type, <DUP:TANDEM> at DUP and DUP:TANDEM."""
    a = df.select(F.explode("alts").alias("a")).where(A.is_symbolic(F.col("a")))
    parts = F.split(F.translate("a", "<>", ""), ":")
    levels = a.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ":"))).alias("prefix"))
    return levels.groupBy("prefix").agg(F.count("*").alias("n")).withColumn("depth", F.size(F.split("prefix", ":")))


def repeat_tree(df: DataFrame) -> DataFrame:
    """basis, mlen, motif, n: repeats counted by basis, motif length and canonical motif, with the sums of each level."""
    m = df.where("motif is not null").select(S.basis(F.upper("motif")).alias("basis"), F.length("motif").alias("mlen"), S.canonical(F.upper("motif")).alias("motif"))
    return m.rollup("basis", "mlen", "motif").agg(F.count("*").alias("n"))


def validation(df: DataFrame, order: str = "row_id", chunks: DataFrame | None = None, chunk_bits: int = 16) -> DataFrame:
    """file_id, n, n_unordered, n_unordered_chrom, n_bad_alleles: records of a file before whose place another stands,
    whose contig lies before that of the record ahead, and whose alleles are no base strings or symbols.

    With a chunked reference also n_bad_refs: records whose REF differs from the reference's bases, case ignored. df has
    chrom then; bases beyond the reference's end and records on contigs it doesn't have aren't compared.

    The record ahead is found block by block of the order column, so a large file is not one task's.
    """
    from stranda.operators.ordering import with_previous

    rows = with_previous(df.select("file_id", order, "rid", "pos", "ref", "alts"), ["file_id"], order, F.struct("rid", "pos"))
    same = F.col("rid") == F.col("prev.rid")
    bad = ~F.coalesce(F.col("ref").rlike("^[ACGTNacgtn]+$") & F.forall(F.coalesce(F.col("alts"), F.array().cast("array<string>")), lambda a: a.rlike(r"^([ACGTNacgtn]+|<.+>|.*[\[\]].*|\*|\.)$")), F.lit(False))
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias
    out = rows.groupBy("file_id").agg(F.count("*").alias("n"), one(same & (F.col("pos") < F.col("prev.pos")))("n_unordered"), one(F.col("rid") < F.col("prev.rid"))("n_unordered_chrom"), one(bad)("n_bad_alleles"))
    if chunks is None:
        return out
    from stranda.operators.records import reference_windows

    placed = df.where("chrom is not null and pos >= 1 and length(ref) > 0").select("file_id", "chrom", "pos", "ref")
    held = reference_windows(placed, chunks, F.col("pos"), F.col("pos") + F.length("ref") - 1, chunk_bits)
    differs = F.substr(F.upper("ref"), F.lit(1), F.length("window")) != F.col("window")
    refs = held.groupBy(F.col("file_id").alias("_file")).agg(one(differs)("n_bad_refs"))
    return out.join(refs, F.col("file_id").eqNullSafe(F.col("_file")), "left").drop("_file").withColumn("n_bad_refs", F.coalesce("n_bad_refs", F.lit(0).cast("long")))


def per_contig(df: DataFrame, contigs: DataFrame, passed: Column) -> DataFrame:
    """rid, contig_name, contig_len, n, n_pass of the biallelic records; contigs without records too."""
    n = df.where(F.size("alts") == 1).groupBy("rid").agg(F.count("*").alias("n"), F.sum(passed.cast("int")).alias("n_pass"))
    return contigs.join(n, "rid", "left").select("rid", "contig_name", "contig_len", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("n_pass", F.lit(0).cast("long")).alias("n_pass"))


def allele_spectrum(sites: DataFrame) -> DataFrame:
    """mac, n, n_pass: the folded spectrum min(ac, an - ac) of sites with ac, an and pass."""
    return sites.groupBy(F.least("ac", F.col("an") - F.col("ac")).alias("mac")).agg(F.count("*").alias("n"), F.sum(F.col("pass").cast("int")).alias("n_pass"))


def allele_counts(calls: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ac, an, n00, n01, n11, ns of biallelic genotypes (gt: array of alleles, null for missing). A genotype with
    one allele missing counts for ac and an alone."""
    gt = F.col("gt")
    known = F.filter(gt, lambda a: a.isNotNull())
    alt = F.size(F.filter(known, lambda a: a > 0))
    whole = (F.size(gt) == 2) & (F.size(known) == 2)
    n = lambda k: F.sum((whole & (alt == k)).cast("int"))
    return calls.groupBy(*keys).agg(F.sum(alt).alias("ac"), F.sum(F.size(known)).alias("an"), n(0).alias("n00"), n(1).alias("n01"), n(2).alias("n11"), F.sum(whole.cast("int")).alias("ns"))


def run_lengths(sequences: DataFrame, max_motif: int = 6, min_copies: int = 2) -> DataFrame:
    """motif, length, n: how often a tract of each length (bases) of each repeated motif stands in the sequences.

    Tracts are maximal: at each motif length the longest stretch in which every base equals the one a motif before it,
    motifs that are repeats of a shorter one left out; the motif is the least rotation. sequences has seq; tracts do not
    reach over the rows' ends.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            seen: dict[tuple[str, int], int] = {}
            for seq in x["seq"]:
                if not seq:
                    continue
                s = np.frombuffer(seq.upper().encode("ascii", "replace"), dtype=np.uint8)
                for k in range(1, max_motif + 1):
                    if len(s) <= k:
                        continue
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], (s[k:] == s[:-k]).astype(np.int8), [0]])))
                    for a, b in zip(edge[::2], edge[1::2]):
                        n = int(b - a) + k
                        unit = s[a : a + k].tobytes().decode()
                        if n >= k * min_copies and not any(k % d == 0 and unit == unit[:d] * (k // d) for d in range(1, k)):
                            key = (min(unit[i:] + unit[:i] for i in range(k)), n)
                            seen[key] = seen.get(key, 0) + 1
            yield pd.DataFrame([(m, n, c) for (m, n), c in seen.items()], columns=["motif", "length", "c"])

    return sequences.select("seq").mapInPandas(count, "motif string, length int, c long").groupBy("motif", "length").agg(F.sum("c").alias("n"))


def trio_counts(calls: DataFrame, trios: DataFrame, site: list[str]) -> DataFrame:
    """g_father, g_mother, g_child, n: genotype classes of complete trios over all sites.

    calls has the site's columns, sample and g (copies of ALT, 0 to 2); trios has child, father, mother, a pedigree's
    small table that is broadcast where its size allows.
    """
    role = lambda name: calls.select(*site, F.col("sample").alias(name), F.col("g").alias(f"g_{name}"))
    t = role("child").join(trios, "child").join(role("father"), [*site, "father"]).join(role("mother"), [*site, "mother"])
    return t.groupBy("g_father", "g_mother", "g_child").agg(F.count("*").alias("n"))


def mendelian_errors(counts: DataFrame) -> DataFrame:
    """n_trios, n_errors, n_het_child, error_rate of trio_counts: a child's genotype its parents can't have passed on."""
    gives = lambda g: (F.when(g == 2, 1).otherwise(0), F.when(g == 0, 0).otherwise(1))
    (f0, f1), (m0, m1) = gives(F.col("g_father")), gives(F.col("g_mother"))
    ok = F.col("g_child").between(f0 + m0, f1 + m1)
    n = F.col("n")
    return counts.agg(F.sum(n).alias("n_trios"), F.coalesce(F.sum(F.when(~ok, n)), F.lit(0)).alias("n_errors"), F.coalesce(F.sum(F.when(F.col("g_child") == 1, n)), F.lit(0)).alias("n_het_child")).withColumn("error_rate", F.round(F.col("n_errors") / F.col("n_trios"), 6))


def duplicate_counts(calls: DataFrame, pairs: DataFrame, site: list[str]) -> DataFrame:
    """g1, g2, n: genotype classes of an individual and its duplicate over all sites."""
    one = lambda name, g: calls.select(*site, F.col("sample").alias(name), F.col("g").alias(g))
    return one("first", "g1").join(pairs, "first").join(one("second", "g2"), [*site, "second"]).groupBy("g1", "g2").agg(F.count("*").alias("n"))


def pedigree_trios(ped: DataFrame) -> DataFrame:
    """fam, child, father, mother, sex of the individuals both of whose parents are known; the first id of each stands."""
    known = lambda c: F.col(c).isNotNull() & (F.col(c) != "0")
    return ped.where(known("father") & known("mother") & (F.size("ids") > 0)).select("fam", F.get("ids", F.lit(0)).alias("child"), "father", "mother", "sex")


def pedigree_duplicates(ped: DataFrame) -> DataFrame:
    """first, second: each individual's first id with every other of its ids."""
    return ped.where(F.size("ids") > 1).select(F.get("ids", F.lit(0)).alias("first"), F.explode(F.slice("ids", 2, F.size("ids"))).alias("second"))


def against_reference(df: DataFrame, reference: DataFrame, kind: str) -> DataFrame:
    """part (A-B, A&B, B-A), n and measures against a reference set, of SNPs (ts, tv) or indels (ins, del)."""
    from stranda.operators.cogroup import partition_counts, stack

    bit, measures = (A.SNP, ("ts", "tv")) if kind == "snp" else (A.INDEL, ("ins", "del"))
    return partition_counts(stack([df, reference]), measures, bit)


def rates(parts: DataFrame) -> DataFrame:
    """precision and sensitivity of A against a reference of true variants B."""
    n = lambda p: F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0))
    return parts.agg(F.round(n("A&B") / F.nullif(n("A&B") + n("A-B"), F.lit(0)), 6).alias("precision"), F.round(n("A&B") / F.nullif(n("A&B") + n("B-A"), F.lit(0)), 6).alias("sensitivity"))
