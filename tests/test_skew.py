from stranda.operators.skew import heavy_contigs, per_contig

CONTIGS = [(0, "1", 10), (1, "X", 10), (5, "MT", 10)]


def test_counts_and_shares(spark):
    c = spark.createDataFrame(CONTIGS, "rid int, contig_name string, contig_len int")
    v = spark.createDataFrame([(0, 1, 5, "a")] * 90 + [(1, 3, 2, "b")] * 4 + [(None, 1, 1, None), (77, 1, 1, None)] + [(5, 2, 9, "b")] * 4, "rid int, beg1 int, end1 int, code string")
    b = spark.createDataFrame([(" chr1 ", 1, 5), ("CHRx", 2, None), (None, 1, 1), ("chrchr1", 1, 1), ("mt", 1, 1)] * 2, "chrom string, beg1 int, end1 int")
    got = {(r.src, r.rid): (r.n_rows, r.n_valid, r.n_bases, r.min_beg, r.max_end) for r in per_contig(v, b, c).collect()}
    assert got == {
        ("vntr", 0): (90, 90, 450, 1, 5), ("vntr", 1): (4, 0, 0, None, None), ("vntr", 5): (4, 4, 32, 2, 9), ("vntr", None): (2, 2, 2, 1, 1),
        ("bed_record", 0): (2, 2, 10, 1, 5), ("bed_record", 1): (2, 0, 0, None, None), ("bed_record", 5): (2, 2, 2, 1, 1), ("bed_record", None): (4, 4, 4, 1, 1),
    }
    assert {tuple(r) for r in heavy_contigs(per_contig(v, b, c)).collect()} == {("vntr", 0), ("bed_record", 0), ("bed_record", 1), ("bed_record", 5)}


def test_exactly_the_share_and_empty(spark):
    c = spark.createDataFrame(CONTIGS, "rid int, contig_name string, contig_len int")
    v = spark.createDataFrame([(0, 1, 1)] * 19 + [(1, 1, 1)], "rid int, beg1 int, end1 int")
    none = spark.createDataFrame([], "chrom string, beg1 int, end1 int")
    assert {tuple(r) for r in heavy_contigs(per_contig(v, none, c)).collect()} == {("vntr", 0), ("vntr", 1)}
    assert per_contig(v.where("false"), none, c).count() == 0
    assert per_contig(v, none, c.where("false")).collect()[0].n_rows == 20
