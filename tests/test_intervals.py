from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stranda.operators.intervals import overlap_join, periods_and_gaps, with_cluster

SCHEMA = "k string, beg1 int, end1 int, piece string, _k0 int"


def brute(rows):
    out = set()
    for k in {r[0] for r in rows}:
        spans = sorted((b, e) for x, b, e in rows if x == k and b is not None and e is not None and e >= b)
        last = None
        for b, e in spans:
            if last and b <= last[1] + 1:
                last[1] = max(last[1], e)
            else:
                if last:
                    out |= {(k, "period", *last), (k, "gap", last[1] + 1, b - 1)}
                last = [b, e]
        if last:
            out.add((k, "period", *last))
    return out


spot = st.one_of(st.none(), st.integers(1, 90))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", None]), spot, spot), max_size=40))
def test_periods_equal_brute_force(spark, rows):
    """Small blocks, so that periods reach over many of them; columns that clash with the operator's own names."""
    df = spark.createDataFrame([(k, b, e, "x", 7) for k, b, e in rows], SCHEMA)
    got = periods_and_gaps(df, ["k"], block_bits=3).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len(set(got))


def test_one_period_over_many_blocks(spark):
    rows = [("a", i, i + 40) for i in range(1, 2000, 30)] + [("a", 5000, 5000)]
    got = {tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, "k string, beg1 int, end1 int"), ["k"], block_bits=4).collect()}
    assert got == {("a", "period", 1, 2021), ("a", "gap", 2022, 4999), ("a", "period", 5000, 5000)}


def test_empty_and_slack(spark):
    df = spark.createDataFrame([], "k string, beg1 int, end1 int")
    assert periods_and_gaps(df, ["k"]).count() == 0
    df = spark.createDataFrame([("a", 1, 5), ("a", 6, 9)], "k string, beg1 int, end1 int")
    assert periods_and_gaps(df, ["k"], slack=0).where("piece = 'period'").count() == 2
    assert periods_and_gaps(df, ["k"], slack=1).where("piece = 'period'").count() == 1


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=st.lists(st.tuples(st.sampled_from([1, 2, None]), spot, spot), max_size=20), right=st.lists(st.tuples(st.sampled_from([1, 2]), spot, spot), max_size=20))
def test_overlap_join_equals_brute_force(spark, left, right):
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(left)], "id int, rid int, b int, e int")
    c = spark.createDataFrame([(i, *r) for i, r in enumerate(right)], "id int, rid int, b int, e int")
    ok = lambda x: None not in x and x[1] <= x[2]
    want = sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if ok(x) and ok(y) and x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1])
    span = (("b", "e"), ("b", "e"))
    assert sorted((r.id, r.r_id) for r in overlap_join(a, c, "rid", "rid", *span, levels=(1, 3, 4)).collect()) == want
    semi = {r.id for r in overlap_join(a, c, "rid", "rid", *span, levels=(1, 3, 4), how="left_semi").collect()}
    assert semi == {i for i, _ in want}
    anti = {r.id for r in overlap_join(a, c, "rid", "rid", *span, levels=(1, 3, 4), how="left_anti").collect()}
    assert anti == set(range(len(left))) - semi


def test_clusters(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 5, 8), (1, 10, 12), (1, 11, 30)], "rid int, b int, e int")
    got = {(r.b, r.cluster_beg, r.cluster_end) for r in with_cluster(df, "rid", "b", "e").collect()}
    assert got == {(1, 1, 8), (5, 1, 8), (10, 10, 30), (11, 10, 30)}


def test_pairs_of_all_regions(spark, tmp_path):
    """Regions of every feature, also of none, meet repeats on a dense contig; held against brute force."""
    from stranda.plans import variant_queries

    d = str(tmp_path)
    spark.createDataFrame([(0, "1"), (1, "2")], "rid int, contig_name string").write.parquet(f"{d}/contig.parquet")
    repeats = [(i, i % 7 // 6, i * 3 % 400, i * 3 % 400 + i % 30) for i in range(150)] + [(150, None, 1, 9), (151, 0, 9, 5)]
    spark.createDataFrame(repeats, "row_id long, rid int, beg1 int, end1 int").write.parquet(f"{d}/vntr.parquet")
    features = ["start_codon", "exon", "CDS ", "lcr", "dust", None]
    beds = [(i, "chr1" if i % 5 else "2", i * 7 % 420, i * 7 % 420 + i % 90, "n", features[i % 6]) for i in range(120)] + [(120, "1", 50, 40, "n", "exon"), (121, None, 1, 400, "n", "exon")]
    spark.createDataFrame(beds, "region_id long, chrom string, beg1 int, end1 int, region_name string, feature string").write.parquet(f"{d}/bed_record.parquet")
    rid = {"chr1": 0, "1": 0, "2": 1}
    want = sorted((v, r) for v, k, b, e in repeats for r, c, rb, re_, _, _ in beds if k is not None and rid.get(c) == k and e >= b and re_ >= rb and b <= re_ and e >= rb)
    got = sorted(tuple(x) for x in variant_queries.QUERIES["overlap_pairs"](spark, d).collect())
    assert got == want and len({r % 6 for _, r in got}) == 6
