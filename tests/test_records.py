import itertools
import random

from pyspark.sql import functions as F

from stranda.functions import alleles as A
from stranda.operators import records, regions
from stranda.sources import text, vcf

HEADER = [
    "##fileformat=VCFv4.2", "##contig=<ID=1,length=1000>", "##contig=<ID=2>", '##INFO=<ID=AF,Number=A,Type=Float,Description="a, b">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="">', '##FORMAT=<ID=PL,Number=G,Type=Integer,Description="">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",
]
LINES = ["2\t7\trs1\tTG\tTGG,T\t19.5\tPASS\tAF=0.5,0.1;DB\tGT:PL\t0/1:9,0,90,9,91,93\t2|2:.", "1\t5\t.\tA\t.\t.\t.\t.\tGT\t0/0\t.", "1\t3\t.\tTAAC\tGAAT\t1e-05\tq1;q2\tAF=1;AF=2\tGT\t1\t./."]


def written(tmp_path, lines, name="a.vcf"):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_vcf_round_trip(spark, tmp_path):
    df, h = vcf.read_vcf(spark, written(tmp_path, [*HEADER, *LINES]))
    assert h.samples == ["s1", "s2"] and h.contigs == [("1", 1000), ("2", None)] and h.info_types() == {"AF": "float", "DB": "flag"}
    r = {x.pos: x for x in df.collect()}
    assert (r[7].rid, r[7].alts, r[7].qual, r[7].filters, r[7].info) == (1, ["TGG", "T"], 19.5, ["PASS"], {"AF": "0.5,0.1", "DB": None})
    assert (r[5].alts, r[5].qual, r[5].filters, r[5].info, r[3].info) == ([], None, [], {}, {"AF": "1"})
    out = str(tmp_path / "out")
    vcf.write_vcf(df, h, out)
    back = [x[0] for x in spark.read.text(out).collect()]
    assert sorted(x for x in back if not x.startswith("#")) == sorted(["2\t7\trs1\tTG\tTGG,T\t19.5\tPASS\tAF=0.5,0.1;DB\tGT:PL\t0/1:9,0,90,9,91,93\t2|2:.", LINES[1], LINES[2].replace("AF=1;AF=2", "AF=1")])
    order = [x.split("\t")[1] for x in back if not x.startswith("#")]
    assert order == ["3", "5", "7"] and back[: len(HEADER)] == HEADER


def test_decompose(spark, tmp_path):
    df, _ = vcf.read_vcf(spark, written(tmp_path, [*HEADER, LINES[0], LINES[1]]))
    s = F.get("samples", F.lit(0))
    keys = F.col("format_keys")
    d = df.withColumn("gt", vcf.genotype(vcf.sample_value(s, keys, "GT"))["alleles"]).withColumn("pl", F.split(vcf.sample_value(s, keys, "PL"), ",").cast("array<int>"))
    got = [(r.pos, r.alts, r.gt, r.pl, r.old_multiallelic) for r in records.decompose(d).orderBy("pos", "alt_index").collect()]
    assert got == [(5, [], [0, 0], None, None), (7, ["TGG"], [0, 1], [9, 0, 90], "2:7:TG/TGG/T"), (7, ["T"], [0, None], [9, 9, 93], "2:7:TG/TGG/T")]


# The records below and of test_decompose are golden cases of these rewrites, which must come out so.
def blocks(spark, ref, alt, **kw):
    df = spark.createDataFrame([("1", 159030, ref, [alt])], "chrom string, pos int, ref string, alts array<string>")
    return [(r.pos, r.ref, r.alts[0]) for r in records.decompose_blocks(df, **kw).orderBy("pos").collect()]


def test_block_substitutions(spark):
    assert blocks(spark, "TAACCTTTC", "TGACCTTTT") == [(159031, "A", "G"), (159038, "C", "T")]
    assert blocks(spark, "TA", "CG") == [(159030, "T", "C"), (159031, "A", "G")]
    assert blocks(spark, "TA", "CG", distance=2) == [(159030, "TA", "CG")]
    assert blocks(spark, "TAA", "GAT", distance=2) == [(159030, "TAA", "GAT")]
    assert blocks(spark, "TAAC", "GAAT", distance=2) == [(159030, "T", "G"), (159033, "C", "T")]
    assert blocks(spark, "TAACC", "GAATG", distance=2) == [(159030, "T", "G"), (159033, "CC", "TG")]
    assert blocks(spark, "TA", "TA") == [(159030, "TA", "TA")] and blocks(spark, "T", "TA") == [(159030, "T", "TA")]


def test_aligned_pieces(spark):
    df = spark.createDataFrame([("1", 159030, "TACCTTTC", ["TGACCTTTT"]), ("1", 5, "A", ["AT"]), ("1", 9, None, None)], "chrom string, pos int, ref string, alts array<string>")
    got = [tuple(r) for r in records.decompose_aligned(df).collect()]
    assert got == [("1", 159030, "T", ["TG"]), ("1", 159037, "C", ["T"]), ("1", 5, "A", ["AT"]), ("1", 9, None, None)]


def haplotype(seq, pos, ref, alt):
    assert seq[pos - 1 : pos - 1 + len(ref)] == ref
    return seq[: pos - 1] + alt + seq[pos - 1 + len(ref) :]


def test_normal_form_keeps_the_haplotype(spark):
    """Against all forms of the same haplotype: the normal form is the one farthest left, and shortest."""
    rnd = random.Random(4)
    seq = "".join(rnd.choice("AC") for _ in range(60)) + "ACACACACACACAAAAAAAA" * 3
    chunks = spark.createDataFrame([("1", i, seq[i * 8 : i * 8 + 8]) for i in range(-(-len(seq) // 8))], "chrom string, chunk long, seq string")
    rows = []
    for _ in range(60):
        pos, n = rnd.randint(2, len(seq) - 8), rnd.randint(1, 6)
        ref = seq[pos - 1 : pos - 1 + n]
        alt = "".join(rnd.choice("AC") for _ in range(rnd.randint(1, 6)))
        if alt != ref:
            rows.append(("1", pos, ref, [alt]))
    rows += [("1", 5, "T", ["TT"]), ("1", 5, "A", ["<DEL>"]), ("1", None, "A", ["AA"]), ("9", 5, "AA", ["CA"])]
    df = spark.createDataFrame(rows, "chrom string, pos int, ref string, alts array<string>")
    out = records.normalize(df, chunks, chunk_bits=3, flank=2).collect()
    assert len(out) == len(rows)
    shifted = [r for r in out if r.old_variant and r.chrom == "1"]
    assert shifted
    for r in shifted:
        chrom, pos, both = r.old_variant.split(":")
        ref, alt = both.split("/")
        assert haplotype(seq, int(pos), ref, alt) == haplotype(seq, r.pos, r.ref, r.alts[0])
        assert r.ref[-1] != r.alts[0][-1] or r.pos == 1
        assert min(len(r.ref), len(r.alts[0])) == 1 or r.ref[0] != r.alts[0][0]
    again = records.normalize(spark.createDataFrame([(r.chrom, r.pos, r.ref, r.alts) for r in shifted], df.schema), chunks, chunk_bits=3, flank=16)
    assert again.where("old_variant is not null").count() == 0


def brute_class(ref, alt):
    r, a = ref, alt
    while len(r) > 1 and len(a) > 1 and r[-1] == a[-1]:
        r, a = r[:-1], a[:-1]
    while len(r) > 1 and len(a) > 1 and r[0] == a[0]:
        r, a = r[1:], a[1:]
    dlen, mlen = len(a) - len(r), min(len(a), len(r))
    if mlen == 1 and dlen:
        short, long_ = (a, r) if dlen < 0 else (r, a)
        pairs = [(long_[0], short)] if short not in (long_[0], long_[-1]) else []
    else:
        pairs = [(x, y) for x, y in zip(r, a) if x != y]
    ts = sum({x, y} in ({"A", "G"}, {"C", "T"}) for x, y in pairs)
    kind = (mlen == len(pairs)) * (1 if mlen == 1 else 2) | bool(dlen) * 4 | (0 < len(pairs) < mlen) * 8
    return kind, len(pairs), len(alt), dlen, mlen, ts, len(pairs) - ts


def test_classes_of_all_short_alleles(spark):
    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("ACG", repeat=n)] + ["GTTTTG", "ACACGT"]
    rows = [(r, [a]) for r in words for a in words if a != r]
    got = A.classified(spark.createDataFrame(rows, "ref string, alts array<string>")).select("ref", "alts", "alleles").collect()
    for r in got:
        x = r.alleles[0]
        assert (x.type, x["diff"], x.alen, x.dlen, x.mlen, x.ts, x.tv) == brute_class(r.ref, r.alts[0]), (r.ref, r.alts)


def test_symbolic_and_odd_alleles(spark):
    rows = [(a,) for a in (["<VNTR>"], ["<VN10>"], ["<STR>"], ["<ST3.2>"], ["<CN4>"], ["A[1:5["], ["."], ["A"], [], None, ["G", "<DEL>"], ["N"])]
    df = spark.createDataFrame(rows, "alts array<string>").withColumn("ref", F.lit("A"))
    got = [(A_.vt, A_.sv) for A_ in A.classified(df).select(A.type_name(F.col("vtype")).alias("vt"), F.get("alleles", F.lit(0))["sv_type"].alias("sv")).collect()]
    assert got == [("VNTR", "<VNTR>"), ("SV", "<VNTR>"), ("VNTR", "<STR>"), ("VNTR", "<ST3.2>"), ("SV", "<CNV>"), ("SV", "<BND>"), ("REF", None), ("REF", None), ("REF", None), ("REF", None), ("SNP/SV", None), ("SNP", None)]


def test_set_ref_probes_and_sequences(spark, tmp_path):
    path = tmp_path / "r.fa"
    seq = "ACGTTGCAAC" * 30
    path.write_text(">1 x\n" + "\n".join(seq[i : i + 7] for i in range(0, 300, 7)) + "\n>2\nacgt\n")
    chunks = text.read_fasta(spark, str(path), 4)
    assert {(r.chrom, r.s) for r in chunks.groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("s")).collect()} == {("1", seq), ("2", "ACGT")}
    spans = text.intervals(spark, ["1:14-40", "2:2", "7:1-3", "1:14-40"])
    assert {tuple(r) for r in text.subsequences(chunks, spans, 4).collect()} == {("1", 14, 40, seq[13:40]), ("2", 2, 2, "C"), ("7", 1, 3, "X")}
    df = spark.createDataFrame([("1", 20, seq[19:21], [seq[19]], (18, 24))], "chrom string, pos int, ref string, alts array<string>, t struct<beg:int,end:int>")
    r = records.widen_to_tract(df, chunks, "t", 4).collect()[0]
    assert (r.pos, r.ref, r.alts[0], r.set_ref) == (17, seq[16:25], seq[16:20] + seq[21:25], "within")
    p = records.probes(df, chunks, 6, 4).collect()[0]
    h = [seq[13:19] + x + seq[21:45] for x in (seq[19:21], seq[19])]
    n = next(i for i in range(7, 60) if h[0][:i] != h[1][:i])
    assert (p.ref_probe, p.alt_probes, p.plen) == (h[0][:n], [h[1][:n]], n)


def test_merged_overlaps(spark):
    df = spark.createDataFrame([(1, 10, "ACGT", ["A"]), (1, 12, "G", ["T"]), (1, 40, "A", ["C"]), (1, 50, "AC", ["A"]), (1, 51, "G", ["T"])], "rid int, pos int, ref string, alts array<string>")
    got = {(r.pos, r.ref, tuple(r.alts) if r.alts else None) for r in regions.merge_overlapping(df).collect()}
    assert got == {(10, "ACGT", ("A", "ACTT")), (50, None, None)} or got == {(10, "ACGT", ("A", "ACTT")), (50, None, None), }


def test_remove_and_filter(spark, tmp_path):
    df, _ = vcf.read_vcf(spark, written(tmp_path, [*HEADER, *LINES]))
    r = records.remove_fields(df, ("DB",), ("PL",), True).where("pos = 7").collect()[0]
    assert (r.info, r.format_keys, [x["values"] for x in r.samples], r.filters) == ({"AF": "0.5,0.1"}, ["GT"], [["0/1"], ["2|2"]], [])
    f = {x.pos: x.filters for x in records.add_filter(df, F.col("pos") > 4, "far").collect()}
    assert f == {7: ["far"], 5: ["far"], 3: ["q1", "q2"]}


def test_text_sources(spark, tmp_path):
    bed = written(tmp_path, ["track x", "1\t0\t10\tname", "2\t5\t6", "short"], "a.bed")
    assert [tuple(r)[:4] for r in text.read_bed(spark, bed).collect()] == [("1", 1, 10, "name"), ("2", 6, 6, None)]
    ped = written(tmp_path, ["# c", "F1 a,b 0 0 1", "F1\tc\ta\td\tfemale"], "a.ped")
    assert [tuple(r) for r in text.read_ped(spark, ped).collect()] == [("F1", ["a", "b"], "0", "0", 1), ("F1", ["c"], "a", "d", 2)]
    gtf = written(tmp_path, ["#x", 'chr1\ts\texon\t3\t9\t.\t+\t.\tgene_id "G"; gene_id "H"; n 2;', "chr1\ts\tgene\t1\t2\t.\t+\t.\tx"], "a.gtf")
    r = text.read_gtf(spark, gtf).collect()
    assert len(r) == 1 and (r[0].chrom, r[0].beg1, r[0].attributes) == ("1", 3, {"gene_id": "G", "n": "2"})
    sam = written(tmp_path, ["@HD", "q\t0\t1\t5\t60\t4M\t=\t9\t0\tACGT\tIIII\tMD:Z:4"], "a.sam")
    r = text.read_sam(spark, sam).collect()[0]
    assert (r.qname, r.chrom, r.mate_chrom, r.md) == ("q", "1", "1", "4")


def test_dataset_list(spark, tmp_path):
    path = str(tmp_path / "sets.txt")
    rows = [("a", "TP", "PASS", "x.vcf"), ("b", "FP", None, "y.vcf")]
    text.write_dataset_list(path, rows)
    assert [tuple(r) for r in text.read_dataset_list(spark, path).collect()] == rows


def test_indel_tracts(spark):
    from stranda.operators.repeats import extract_repeats, indel_tracts, is_repeat

    seq = "GTTCAGGC" + "AC" * 6 + "GGTTAACC" + "A" * 9 + "CTGT"
    chunks = spark.createDataFrame([("1", i, seq[i * 8 : i * 8 + 8]) for i in range(-(-len(seq) // 8))], "chrom string, chunk long, seq string")
    rows = [(0, "1", 8, "C", ["CAC"]), (0, "1", 14, "CAC", ["C"]), (0, "1", 28, "CA", ["C"]), (0, "1", 3, "T", ["<DEL>"]), (0, "1", 3, "TC", ["AG"]), (0, "7", 3, "T", ["TT"])]
    df = spark.createDataFrame(rows, "rid int, chrom string, pos int, ref string, alts array<string>")
    got = {(r.pos, r.beg1, r.end1, r.motif, r.copies) for r in indel_tracts(df, chunks, 16, 3).collect()}
    assert got == {(8, 8, 20, "AC", 6), (14, 8, 20, "AC", 6), (28, 29, 37, "A", 9)}
    e = {(r.beg1, r.associated) for r in extract_repeats(df, chunks, "willems2014", 16, 3).collect()}
    assert e == {(8, "1:14:CAC/C,1:8:C/CAC"), (29, "1:28:CA/C")}
    # A window that ends inside the tract is widened; of several ALTs the tracts are united.
    assert {(r.pos, r.beg1, r.end1, r.motif, r.copies) for r in indel_tracts(df, chunks, 1, 3).collect()} == got
    many = spark.createDataFrame([(0, "1", 14, "C", ["CAC", "T", "CA", "<DEL>"]), (0, "1", 36, "A", ["AA"]), (0, "1", None, "A", ["AA"]), (0, "1", 5, None, ["AA"]), (0, "1", 5, "A", None)], df.schema)
    united = [tuple(r) for r in indel_tracts(many, chunks, 2, 3).orderBy("pos").collect()]
    assert united == [(0, "1", 14, 8, 20, "AC", 6, "GTTCAGG", "GGTTAACCAA", "1:14:C/CAC/T/CA/<DEL>"), (0, "1", 36, 29, 37, "A", 9, "ACGGTTAACC", "CTGT", "1:36:A/AA")]
    sizes = spark.createDataFrame([(1, 6), (1, 5), (6, 26), (6, 27), (7, 14), (7, 13)], "m int, n int")
    held = lambda scheme: [r[0] for r in sizes.select(is_repeat(F.col("m"), F.col("n"), scheme)).collect()]
    assert held("fondon2012") == [True, False, False, True, False, False] and held("lai2003") == [True, False, True, True, True, False]


def test_alignments(spark):
    df = spark.createDataFrame([("ACGT", "AGT"), ("A", "A"), ("", "AC"), (None, "A")], "ref string, alt string")
    got = {r.ref: (r.ref_aligned, r.alt_aligned, r.distance) for r in records.alignments(df).collect()}
    assert got == {"ACGT": ("ACGT", "A-GT", 1), "A": ("A", "A", 0), "": ("--", "AC", 2), None: (None, None, None)}


def test_references_are_validated(spark):
    """A REF that differs from the reference counts in its file, also where it crosses a chunk's end."""
    from stranda.operators import profiles

    chunks = spark.createDataFrame([("1", 0, "ACGT"), ("1", 1, "TTGN")], "chrom string, chunk long, seq string")
    rows = [(1, 1, "1", 1, "ac"), (2, 1, "1", 2, "CGTA"), (3, 1, "1", 3, "GTTT"), (4, 1, "1", 8, "A"), (5, 1, "1", 7, "GNAA"), (6, 1, "1", 50, "A"), (7, 2, "2", 1, "G"), (8, 2, "1", None, "G"), (9, None, "1", 1, "C")]
    df = spark.createDataFrame([(i, f, 0, c, p, r, ["G"]) for i, f, c, p, r in rows], "row_id long, file_id long, rid int, chrom string, pos int, ref string, alts array<string>")
    assert {r.file_id: (r.n, r.n_bad_refs) for r in profiles.validation(df, chunks=chunks, chunk_bits=2).collect()} == {1: (6, 2), 2: (2, 0), None: (1, 1)}
    assert "n_bad_refs" not in profiles.validation(df).columns


def test_fasta_in_blocks(spark, tmp_path):
    """Files cut amid lines, headers and sequences give the chunks of whole files."""
    rnd = random.Random(6)
    want = {}
    for f in range(2):
        text_ = ["bases before any name", ""]
        for c in range(6):
            seq = "".join(rnd.choice("acgtN") for _ in range(rnd.choice([0, 1, 16, 200, 333])))
            text_ += [f">c{f}_{c} some words", *[seq[i : i + 23] for i in range(0, len(seq), 23)], ""]
            want.update({(f"c{f}_{c}", i // 16): seq[i : i + 16].upper() for i in range(0, len(seq), 16)})
        (tmp_path / f"f{f}.fa").write_text("\r\n".join([*text_, "> ", "ACGT", ""]))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("57b", "400b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = text.read_fasta(spark, str(tmp_path), 4).collect()
            assert {(r.chrom, r.chunk): r.seq for r in got} == want and len(got) == len(want), size
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
