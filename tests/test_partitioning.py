"""Operators give one answer however their input is partitioned: plain, repartitioned, in one partition, repeated rows too."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stranda.operators import intervals, records, regions, repeats

N = 800


def ways(df):
    return {"plain": df, "repartitioned": df.repartition(8), "one": df.coalesce(1)}


def made():
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 0, 0, 1, 2, None]), rnd.choice([None, *range(1, 400)]), rnd.choice(["A", "AC", "ACG", None]), rnd.choice([["C"], ["AC"], ["C", "AT"], [], None])) for i in range(N)]
    return rows + rows[:200]


SPANS = [(0, 5, 20), (0, 18, 30), (0, 200, 201), (1, 1, 3), (1, 90, 80), (2, None, 4), (2, 300, 399), (None, 1, 400)]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(*r, str(r[1])) for r in made()], "row_id long, rid int, pos int, ref string, alts array<string>, chrom string")
    return df.repartition(3)


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame(SPANS, "rid int, beg1 int, end1 int")


@pytest.fixture(scope="module")
def chunks(spark):
    seq = "ACGTTGCAACCA" * 40
    return spark.createDataFrame([(str(c), i, seq[i * 16 : i * 16 + 16]) for c in range(3) for i in range(len(seq) // 16)], "chrom string, chunk long, seq string")


def hit(rid, b, e, left=0, right=0):
    return rid is not None and b is not None and e is not None and any(k == rid and x is not None and y >= x and b <= y + right and e >= x - left for k, x, y in SPANS)


def end(r):
    return None if r[2] is None or r[3] is None else r[2] + len(r[3]) - 1


@pytest.mark.parametrize("inverse", [False, True])
def test_select_regions(rows, areas, inverse):
    want = Counter(r[0] for r in made() if hit(r[1], r[2], end(r)) != inverse)
    for way, df in ways(rows).items():
        assert Counter(r.row_id for r in regions.select_regions(df, areas, inverse=inverse).collect()) == want, way


def test_flags(rows, areas):
    margin = lambda r, low, high: r[1] is not None and end(r) is not None and any(k == r[1] and x is not None and y >= x and r[2] <= high(x, y) and end(r) >= low(x, y) for k, x, y in SPANS)
    want = Counter((r[0], margin(r, lambda x, y: x, lambda x, y: y), margin(r, lambda x, y: x - 9, lambda x, y: x - 1), margin(r, lambda x, y: y + 1, lambda x, y: y + 4)) for r in made())
    for way, df in ways(rows).items():
        got = regions.annotate_regions(df, areas, "t", 9, 4)
        assert Counter((r.row_id, r.t, r.t_left, r.t_right) for r in got.collect()) == want, way
        assert got.columns == [*df.columns, "t", "t_left", "t_right"]


def test_types(rows, areas):
    want = Counter((r[0], hit(r[1], r[2], end(r))) for r in made())
    for way, df in ways(rows).items():
        assert Counter((r.row_id, r.lc) for r in records.annotate_types(df, areas, areas).collect()) == want, way
        assert Counter(r.lc for r in records.annotate_types(df).collect()) == {False: N + 200}


def test_lift_over(rows, spark):
    chain = spark.createDataFrame([(0, 1, 100, 7, 1000), (0, 50, 90, 8, 5), (1, 1, 400, 9, -1)], "rid int, beg1 int, end1 int, to_rid int, shift int")

    def moved(r):
        if r[2] is None:
            return None, None
        if r[1] == 0:
            return (8, r[2] + 5) if 50 <= r[2] <= 90 else (7, r[2] + 1000) if r[2] <= 100 else (None, None)
        return (9, r[2] - 1) if r[1] == 1 else (None, None)

    want = Counter((r[0], *moved(r), r[1], r[2]) for r in made())
    for way, df in ways(rows).items():
        assert Counter((r.row_id, r.rid, r.pos, r.old_rid, r.old_pos) for r in regions.lift_over(df, chain).collect()) == want, way


def test_windows(rows, chunks):
    seq = "ACGTTGCAACCA" * 40
    want = Counter((r[0], seq[max(1, r[2] - 20) - 1 : r[2] + 20] if r[1] is not None and r[2] is not None else None) for r in made())
    for way, df in ways(rows).items():
        got = records.reference_windows(df, chunks, F.col("pos") - 20, F.col("pos") + 20, 4)
        assert Counter((r.row_id, r.window) for r in got.collect()) == want, way


def text(df):
    return Counter(repr(r) for r in df.select(*[F.col(c).cast("string") for c in df.columns]).collect())


@pytest.mark.parametrize("name", ["normalize", "probes", "tract", "indels", "cluster", "nearest"])
def test_same_answer(rows, areas, chunks, name):
    indel = rows.where("pos is not null and rid is not null")
    run = {
        "normalize": lambda d: records.normalize(d, chunks, chunk_bits=4, flank=4),
        "probes": lambda d: records.probes(d, chunks, 6, 4),
        "tract": lambda d: records.widen_to_tract(d.withColumn("t", F.struct((F.col("pos") - 3).alias("beg"), (F.col("pos") + 3).alias("end"))), chunks, "t", 4),
        "indels": lambda d: repeats.indel_tracts(d.where(indel_like()), chunks, 8, 4),
        "cluster": lambda d: intervals.with_cluster(regions.with_end(d), "rid", "pos", "end1"),
        "nearest": lambda d: regions.nearest_repeat(d.dropDuplicates(["row_id"]), areas.withColumn("vntr_id", F.col("beg1").cast("long")).withColumn("motif", F.lit("A"))),
    }[name]
    answers = [text(run(d)) for d in ways(indel).values()]
    assert answers[0] and all(a == answers[0] for a in answers)


def indel_like():
    return (F.size("alts") == 1) & F.col("ref").isNotNull()


def test_start_of_a_contig(spark, chunks):
    """Windows are cut at position 1: a tract and probes there have what flank there is."""
    df = spark.createDataFrame([("0", 1, "A", ["C"], (1, 2)), ("0", 2, "CG", ["C"], (-3, 5))], "chrom string, pos int, ref string, alts array<string>, t struct<beg:int,end:int>")
    got = {(r.old, r.pos, r.ref, r.alts[0], r.set_ref) for r in records.widen_to_tract(df.withColumn("old", F.col("pos")), chunks, "t", 4).collect()}
    assert got == {(1, 1, "ACG", "CCG", "within"), (2, 1, "ACGTTG", "ACTTG", "within")}
    p = {r.pos: (r.ref_probe, r.alt_probes, r.plen) for r in records.probes(df, chunks, 3, 4).collect()}
    assert p == {1: ("ACGT", ["CCGT"], 4), 2: ("ACGT", ["ACTT"], 4)}


def test_sort_modes(spark):
    """Orders against brute force; the running maximum over many blocks of the input order."""
    from stranda.operators.ordering import sort_records, with_running_max

    rnd = random.Random(9)
    data = [(i, rnd.choice([0, 0, 1, None]), rnd.randint(1, 400)) for i in range(300)]
    df = spark.createDataFrame(data, "row_id long, rid int, pos int").repartition(7)
    most = {}
    want = {}
    for i, rid, pos in data:
        want[i] = most.get(rid)
        most[rid] = max(pos, most.get(rid, 0))
    assert {r.row_id: r.most for r in with_running_max(df, ["rid"], "row_id", "pos", block_bits=3).collect()} == want
    low = lambda x: (x is not None, x or 0)
    rows = lambda mode, **kw: [(r.row_id, r.rid, r.pos) for r in sort_records(df, mode, **kw).collect()]
    assert rows("full") == sorted(data, key=lambda r: (low(r[1]), r[2], r[0])) and rows("chrom") == sorted(data, key=lambda r: (low(r[1]), r[0]))
    at = lambda r: max(r[2], (want[r[0]] if want[r[0]] is not None else -99) - 50)
    assert rows("local", window=50) == sorted(data, key=lambda r: (low(r[1]), at(r), r[2], r[0]))
    late = {r.row_id for r in sort_records(df, "local", window=50).where("late").collect()}
    assert late == {i for i, _, pos in data if want[i] is not None and pos < want[i] - 50}
    with pytest.raises(ValueError):
        sort_records(df, "other")


def test_overlap_counts(spark):
    """Counts without pairs equal counted pairs, over many blocks, with repeated and invalid rows."""
    rnd = random.Random(11)
    data = [(rnd.choice([0, 1, None]), rnd.randint(1, 90), rnd.choice([0, 1, 3, 40, -1]), rnd.choice([1, 4, 5])) for _ in range(250)]
    df = spark.createDataFrame([(k, b, b + n, t) for k, b, n, t in data], "k int, b int, e int, t int").repartition(4)
    valid = [(k, b, b + n, t) for k, b, n, t in data if k is not None and n >= 0]
    want = {(k, b, e): tuple(sum(1 for q, x, y, t in valid if q == k and t & bit and x <= e and y >= b) for bit in (1, 4)) for k, b, e, _ in valid}
    got = regions.overlap_counts(df, {"one": F.col("t").bitwiseAND(1) != 0, "four": F.col("t").bitwiseAND(4) != 0}, "k", "b", "e", block_bits=3)
    assert {(r.k, r.b, r.e): (r.one, r.four) for r in got.collect()} == want


def test_files_brought_together(spark):
    from stranda.operators import cogroup

    rows = [(1, 0, 5, 0, "a", "A", ["C"]), (2, 0, 5, 0, "a", "A", ["G"]), (3, 0, 5, 1, "a", "A", ["C"]), (4, None, None, 2, "b", None, None)]
    df = spark.createDataFrame(rows, "row_id long, rid int, pos int, file_index int, sample_id string, ref string, alts array<string>")
    g = {r.pos: (r.n_files, [(f.file_index, [x.alts for x in f.records]) for f in r.files]) for r in cogroup.by_position(df, ("alts",)).collect()}
    assert g == {5: (2, [(0, [["C"], ["G"]]), (1, [["C"]])]), None: (1, [(2, [None])])}
    with pytest.raises(ValueError, match="'a'"):
        cogroup.merge_samples(df, strict=True, fields=("ref",))
    assert cogroup.merge_samples(df.where("file_index = 0"), strict=True, fields=("ref",)).count() == 2
    left = spark.createDataFrame([(1, "GT", ["x"]), (2, None, ["y"])], "row_id long, fmt string, samples array<string>")
    assert [r.samples for r in cogroup.paste(left, left, "row_id", agree=("fmt",)).orderBy("row_id").collect()] == [["x", "x"], ["y", "y"]]
    for other in (left.where("row_id = 1"), left.withColumn("fmt", F.lit("PL"))):
        with pytest.raises(Exception, match="partner|differs"):
            cogroup.paste(left, other, "row_id", agree=("fmt",)).collect()
    empty = df.where("false")
    assert cogroup.by_position(empty, ("alts",)).count() == 0 and cogroup.merge_samples(empty, fields=("ref",)).count() == 0


def test_vntrized_and_candidate_indels(spark, chunks):
    repeats_ = spark.createDataFrame([(0, 10, 20, 2, "C", ["<VNTR>"], "A"), (0, 10, 12, 1, "G", ["<VN2>", "<VN3>"], "A"), (0, 50, 40, 3, "T", ["<VNTR>"], "A"), (None, 1, 9, 4, "T", ["<VNTR>"], "A")], "rid int, beg1 int, end1 int, vntr_id long, ref string, alts array<string>, motif string")
    df = spark.createDataFrame([(1, 0, 11, "AC", ["A"]), (2, 0, 30, "A", ["C"]), (3, None, 11, "A", ["C"]), (4, 0, None, "A", None)], "row_id long, rid int, pos int, ref string, alts array<string>")
    got = {r.row_id: tuple(r)[1:] for r in regions.vntrized(df, repeats_).collect()}
    assert got == {1: (0, 10, "G", ["<VN2>", "<VN3>"], "0:10:G/<VN2>/<VN3>,0:10:C/<VNTR>,0:11:AC/A", 2, 3), 2: (0, 30, "A", ["C"], None, None, None), 3: (None, 11, "A", ["C"], None, None, None), 4: (0, None, "A", None, None, None, None)}
    assert [tuple(r) for r in regions.joint_alleles(regions.vntrized(df, repeats_)).collect()] == [(2, 3, 1)]
    # ACGTTGCAACCA: the bases 9 and 10 are one repeat of A... at 8 and 9, base 7 is its anchor.
    tract = spark.createDataFrame([(0, "0", 8, 9, "A", 7)], "rid int, chrom string, beg1 int, end1 int, motif string, vntr_id long")
    indels = [(0, "0", 7, "CA", ["C"], 50.0, "A"), (0, "0", 7, "C", ["CA"], 50.0, "a"), (0, "0", 7, "C", ["CA"], 50.0, "A"), (0, "0", 7, "C", ["CG"], 50.0, "G"), (0, "0", 7, "CAA", ["C"], 20.0, "A"), (0, "0", 8, "AA", ["A"], 50.0, "A"), (0, "0", 7, "C", None, 50.0, None)]
    made_ = spark.createDataFrame(indels, "rid int, chrom string, pos int, ref string, alts array<string>, qual double, motif string")
    out = [tuple(r) for r in regions.multiallelic_indels(made_, tract, chunks, chunk_bits=4).collect()]
    assert out == [(0, 7, "CA", ["C", "CAA"], 7, 2)]
    assert regions.multiallelic_indels(made_.where("false"), tract, chunks, chunk_bits=4).count() == 0 and regions.vntrized(df.where("false"), repeats_).count() == 0
