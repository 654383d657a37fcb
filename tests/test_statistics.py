import math

import numpy as np

from stranda.functions import alignment, special
from stranda.operators import features, reads


def test_distributions():
    assert math.isclose(math.exp(special.chi2_log_upper(3.841458820694124, 1)), 0.05, rel_tol=1e-9)
    assert math.isclose(math.exp(special.chi2_log_upper(1.0, 1)), math.erfc(math.sqrt(0.5)), rel_tol=1e-12)
    assert math.isclose(math.exp(special.chi2_log_upper(18.307038053275146, 10)), 0.05, rel_tol=1e-9)
    assert special.chi2_log_upper(0, 3) == 0 and special.chi2_log_upper(2000, 1) < -900
    for n, k, p in ((10, 3, 0.4), (7, 0, 0.1), (12, 11, 0.9)):
        assert math.isclose(special.binomial_cdf(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-12)
    assert special.binomial_cdf(5, 5, 0.3) == 1 and special.binomial_cdf(-1, 5, 0.3) == 0
    assert math.isclose(special.normal_quantile(0.975), 1.959963984540054, rel_tol=1e-9)
    assert math.isclose(special.log10_sum(-3, -4), math.log10(0.0011), rel_tol=1e-12)


def test_em_with_certain_genotypes():
    """With likelihoods that leave no doubt the estimates are those of counting."""
    sure = lambda g: [0 if i == g else 2000 for i in range(3)]
    f = features.site_features([sure(g) for g in (0, 0, 1, 2)] + [None], [10] * 5, 2)
    assert f["ns"] == 4 and np.allclose(f["mleaf"], [3 / 8]) and np.allclose(f["hweaf"], [3 / 8]) and np.allclose(f["mlegf"], [0.5, 0.25, 0.25])
    assert abs(f["fic"]) < 1e-6  # no doubt, so the expected heterozygotes are the seen ones
    assert f["hwe_df"] == 1 and f["hwe_llr"] <= 0
    three = features.site_features([[0, 2000, 2000, 2000, 2000, 2000], [2000, 2000, 2000, 2000, 0, 2000]], None, 3)
    assert np.allclose(three["mleaf"], [0.25, 0.25])
    assert features.site_features([], None, 2) == features.site_features([None, [1, 2]], None, 2) == {}


def test_families():
    """A child its parents can't have is better explained by no kinship."""
    sure = lambda g: [0 if i == g else 250 for i in range(3)]
    others = [sure(g) for g in (0, 1, 1, 2)]
    ok = features.family_likelihoods([(sure(0), sure(2), [sure(1)])], others)
    bad = features.family_likelihoods([(sure(0), sure(0), [sure(2)])], others)
    assert ok["bf"] > 0 > bad["bf"]
    assert np.allclose(features.TRANSMISSION.sum(axis=2), 1) and np.allclose(features.TRANSMISSION[1, 1], [0.25, 0.5, 0.25])


def test_repeat_model():
    v = alignment.viterbi_repeat("ACGACGACG", "ACG")
    assert (v["copies"], v["perfect"], v["begin"], v["end"], v["path"]) == (3, 3, 0, 9, "M" * 9)
    v = alignment.viterbi_repeat("TTGACGACGACGCCT", "ACG", "TTG", "CCT")
    assert (v["copies"], v["perfect"], v["begin"], v["end"]) == (3, 3, 3, 12)
    assert alignment.viterbi_repeat("ACGATGACG", "ACG")["perfect"] == 2
    assert alignment.viterbi_repeat("", "A")["copies"] == 0
    assert alignment.detect_motifs("CAGCAGCAGCAG")[0][0] == "AGC"
    assert alignment.repeat_region("GGACAC", "AC", "ACT") == (4, 2)


def test_repeat_model_of_many():
    """Reads that walk through the model together get what each gets alone."""
    rnd = np.random.default_rng(5)
    word = lambda n: "".join(rnd.choice(list("ACGTN"), n, p=[0.3, 0.3, 0.2, 0.19, 0.01]))
    pairs = [("", "A"), ("ACG", ""), ("A", "A"), ("ACGT", "ACGTACGTAC")]
    for _ in range(60):
        motif = word(int(rnd.integers(1, 8)))
        tract = [c if rnd.random() > 0.1 else word(1) for c in motif * int(rnd.integers(1, 12)) if rnd.random() > 0.05]
        pairs.append(("".join(tract), motif))
    for cells in (1, 1 << 23):
        for (seq, unit), got in zip(pairs, alignment.align_repeats(pairs, cells=cells)):
            v = alignment.viterbi_repeat(seq, unit)
            assert got == (v["copies"], v["perfect"], v["score"]), (seq, unit)


def test_long_repeats_are_annotated(spark, sf):
    """Every distinct pair of motif and tract has a row, however long the tract; null tracts have nulls."""
    from stranda.plans import variant_queries

    rows = {(r.motif, r.repeat_tract): r for r in variant_queries.QUERIES["annotate_vntrs_fuzzy"](spark, sf).collect()}
    assert set(rows) == {tuple(r) for r in spark.read.parquet(f"{sf}/vntr.parquet").select("motif", "repeat_tract").distinct().collect()}
    assert max(len(t or "") for _, t in rows) > 40
    for (_, tract), r in rows.items():
        if tract and r.fz_motif and len(tract) < 90:
            v = alignment.viterbi_repeat(tract.upper(), r.fz_motif)
            assert (r.fz_copies, r.fz_perfect, r.fz_score) == (v["copies"], v["perfect"], round(v["score"], 4))
        assert (r.fz_copies is None) == (not tract or r.fz_motif is None)


def test_sequence_columns(spark):
    from pyspark.sql import functions as F

    from stranda.functions import sequences as S

    df = spark.createDataFrame([("ACAC",), ("aatt",), ("",), (None,), ("N",), ("ACGACG",)], "s string")
    got = [tuple(r) for r in df.select(S.entropy("s"), S.divergence("s"), S.pair_entropy("s"), S.smallest_unit("s"), S.exact_purity("s", F.lit("AC"))).collect()]
    assert got == [(1.0, 1.0, 0.92, "AC", 1.0), (1.0, 1.0, 1.58, "aatt", 0.25), (None, None, None, "", None), (None,) * 5, (None, None, None, "N", 0.0), (1.58, 0.42, 1.52, "ACG", 0.3333)]


def test_scores():
    assert reads.snp_score([30] * 20, []) == 0
    assert reads.snp_score([30] * 10, [30] * 10) > 100
    assert reads.indel_score(0, 20) == 0 and reads.indel_score(10, 20) > 100


def read(qname, pos, cigar, seq, md=None, flag=0, mapq=60, chrom="1", mate=None, qual=None):
    return (qname, flag, chrom, pos, mapq, cigar, chrom if mate else None, mate, seq, qual or "I" * len(seq), md)


SAM = "qname string, flag int, chrom string, pos int, mapq int, cigar string, mate_chrom string, mate_pos int, seq string, qual string, md string"


def test_discovery_and_genotypes(spark):
    rows = [read(f"r{i}", 10, "6M", "ACGTAC" if i % 2 else "ACTTAC", "6" if i % 2 else "2G3") for i in range(8)]
    rows += [read("i1", 10, "3M2I3M", "ACGTTTAC", "6"), read("i2", 10, "3M2I3M", "ACGTTTAC", "6"), read("d1", 10, "3M1D2M", "ACGAC", "3^T2"), read("d2", 10, "3M1D2M", "ACGAC", "3^T2")]
    rows += [read("x", 10, "6M", "AAAAAA", flag=1024), read("y", 10, "6M", "AAAAAA", mapq=3), read("z", 10, "bad", "AAAAAA")]
    df = reads.usable(spark.createDataFrame(rows, SAM))
    got = {(r.pos, r.ref, r.alt, r.e, r.n) for r in reads.discover(df).collect()}
    assert got == {(12, "G", "T", 4, 12), (12, "G", "GTT", 2, 12), (12, "GT", "G", 2, 12)}
    q = {(r.pos, r.alt): r.qual for r in reads.discover(df).collect()}
    assert math.isclose(q[12, "T"], reads.snp_score([40] * 8, [40] * 4), abs_tol=1e-3)
    assert math.isclose(q[12, "GTT"], reads.indel_score(2, 12), abs_tol=1e-3)
    sites = spark.createDataFrame([("1", 12, "G", ["T"]), ("1", 10, "A", ["C", "G"]), ("1", 99, "A", ["C"])], "chrom string, pos int, ref string, alts array<string>")
    g = {r.pos: r for r in reads.genotype_snps(df, sites).collect()}
    assert set(g) == {10, 12} and g[12].gt == "0/1" and g[12].pl[1] == 0 and g[12].dp == 12 and g[12].adf == [8, 4] and g[12].adr == [0, 0] and (g[10].gt, g[10].pl) == ("0/0", None)
    p = {r.pos: (r.depth, r.n_ins, r.n_del) for r in reads.pileup(df).collect()}
    assert p[12] == (12, 2, 2) and p[13][0] == 10


def test_mates_and_coverage(spark):
    rows = [read("a", 10, "6M", "ACGTAC", flag=65, mate=12), read("a", 12, "6M", "GTACGT", flag=129, mate=10), read("b", 10, "6M", "ACGTAC", flag=65, mate=90), read("b", 90, "6M", "ACGTAC", flag=129, mate=10)]
    assert sorted((r.qname, r.pos) for r in reads.usable(spark.createDataFrame(rows, SAM)).collect()) == [("a", 10), ("b", 10), ("b", 90)]
    spans = spark.createDataFrame([(1, 1, 5), (1, 3, 70000), (1, 70001, 70002), (1, 9, 2), (None, 1, 1)], "rid int, beg1 int, end1 int")
    assert {tuple(r) for r in reads.coverage(spans).collect()} == {(1, 1, 2, 1), (1, 3, 5, 2), (1, 6, 70002, 1)}


def test_indel_and_repeat_genotypes(spark):
    """Two insertions, two deletions and eight plain reads at a site; a read that ends at the site says nothing."""
    rows = [read(f"r{i}", 10, "6M", "ACGTAC", "6", flag=16 * (i % 2)) for i in range(8)] + [read("e", 10, "3M", "ACG", "3")]
    rows += [read(f"i{i}", 10, "3M2I3M", "ACGTTTAC", "6") for i in range(2)] + [read(f"d{i}", 10, "3M1D2M", "ACGAC", "3^T2") for i in range(2)]
    df = reads.usable(spark.createDataFrame(rows, SAM))
    sites = spark.createDataFrame([("1", 12, "GT", ["G", "GTTT"]), ("1", 12, "GT", ["GAT"]), ("1", 99, "GT", ["G"])], "chrom string, pos int, ref string, alts array<string>")
    g = {tuple(r.alts): r for r in reads.genotype_indels(df, sites).collect()}
    assert set(g) == {("G", "GTTT"), ("GAT",)} and g["GAT",].gt == "0/0" and g["GAT",].pl is None and g["GAT",].ad == [8, 0]
    r = g["G", "GTTT"]
    het = 0.30103 - math.log10(1.1)
    want = [4, 10 * het + 2, 10, 10 * het + 2, 8 + 4 * het, 10]
    assert (r.ad, r.adr, r.dp) == ([8, 2, 2], [4, 0, 0], 12) and r.pl == [round(10 * (w - min(want))) for w in want]
    tracts = spark.createDataFrame([("1", 13, 13, [0, 3])], "chrom string, beg1 int, end1 int, alt_lengths array<int>")
    t = reads.genotype_repeats(df, tracts).collect()[0]
    assert (t.lengths, t.ad, t.pl, t.gt) == ([1, 0, 3], [8, 2, 2], r.pl, r.gt)
    lists = reads.site_reads(df, spark.createDataFrame([("1", 13, "T", ["A"])], "chrom string, pos int, ref string, alts array<string>")).collect()[0]
    assert lists.al == [0] * 10 and sorted(lists.nm) == [0] * 8 + [2] * 2 and sorted(lists.cy) == [4] * 8 + [6] * 2 and lists.st.count("R") == 4 and set(lists.bq) == {40}


def test_sums_equal_events(spark, sf):
    """What the batches' sums say of bases and indels is what single events say."""
    from pyspark.sql import functions as F

    from stranda.plans import variant_queries

    df = reads.usable(variant_queries.made_reads(spark, sf))
    keys = ["chrom", "pos", "kind", "ref", "alt", "strand"]
    a = {tuple(r) for r in reads.event_sums(df, 13).groupBy(*keys).agg(F.sum("c"), F.sum("bq")).collect()}
    b = {tuple(r) for r in reads.events(df, 13).groupBy(*keys).agg(F.count("*"), F.sum("baseq")).collect()}
    assert a == b and len(a) > 1000
