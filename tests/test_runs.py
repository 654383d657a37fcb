from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stranda.operators.ordering import pointer_doubling, with_previous
from stranda.operators.runs import collapsed, repeat_runs

SCHEMA = "row_id long, vntr_id long, set_id long, ord long, rid int, motif string, ru string, repeat_tract string, beg1 int, end1 int, prev string, first_id int"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def brute(rows):
    one = {}
    for r in sorted(rows):
        if r[1] is not None and r[2] is not None and r[3] is not None:
            one.setdefault((r[2], r[1]), r)
    out = set()
    for s in {k[0] for k in one}:
        seq = sorted((r for k, r in one.items() if k[0] == s), key=lambda r: (r[3], r[1]))
        run = []

        def close(run=None):
            if len(run) > 1:
                ends, begs = [r[9] for r in run if r[9] is not None], [r[8] for r in run if r[8] is not None]
                out.add((s, run[0][1], run[-1][1], len(run), max(ends) - min(begs) + 1 if ends and begs else None))

        for r in seq:
            unit = lambda x: (x[5] if x[5] is not None else x[6])
            if run:
                p = run[-1]
                u, v = unit(p), unit(r)
                same = p[4] is not None and p[4] == r[4] and u is not None and v is not None and len(u) == len(v) and v.upper() in u.upper() * 2
                same = same and p[7] is not None and r[7] is not None and edits(p[7].upper(), r[7].upper()) <= 2
                if same:
                    run.append(r)
                    continue
                close(run)
            run = [r]
        close(run)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


tract = st.one_of(st.none(), st.sampled_from(["", "ACACAC", "acacac", "ACACA", "ACTCAC", "AAACACAC", "GGGG", "ACACACACAC"]))
record = st.tuples(st.integers(1, 9), st.sampled_from([1, 2, None]), st.integers(1, 12), st.sampled_from([1, 1, 1, None]), st.sampled_from(["AC", "CA", None, "G", "ac", ""]), st.sampled_from(["AC", None]), tract, st.sampled_from([None, 5, 9]), st.sampled_from([None, 20, 30]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(record, max_size=14))
def test_runs_equal_brute_force(spark, rows):
    rows = [(i, *r) for i, r in enumerate(rows)]
    assert {tuple(r) for r in repeat_runs(frame(spark, rows)).collect()} == brute(rows)


def test_long_run_over_blocks(spark):
    n = 700
    rows = [(i, i, 1, i * 37, 1, "ACG"[i % 3 :] + "ACG"[: i % 3], None, "ACGACG" + "T" * (i % 2), i, i + 5) for i in range(n)]
    got = [tuple(r) for r in repeat_runs(frame(spark, rows)).collect()]
    assert got == [(1, 0, n - 1, n, n + 5)]
    one = collapsed(frame(spark, rows)).collect()
    assert [(r.vntr_id, r.n_records, r.n_bases) for r in one] == [(0, n, n + 5)]


def test_empty(spark):
    assert repeat_runs(frame(spark, [])).count() == 0
    assert collapsed(frame(spark, [])).count() == 0


def test_previous_and_pointers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 5), (1, 9000), (1, 70), (2, 1), (1, None)], "g int, o long")
    got = {(r.g, r.o, r.p) for r in with_previous(df, ["g"], "o", F.col("o"), out="p", block_bits=4).collect()}
    assert got == {(1, 5, None), (1, 70, 5), (1, 9000, 70), (2, 1, None), (1, None, None)}
    links = spark.createDataFrame([(1, i, i - 1) for i in range(2, 40)], "g int, n int, p int")
    assert {r.p for r in pointer_doubling(links, "g", "n", "p").collect()} == {1}
