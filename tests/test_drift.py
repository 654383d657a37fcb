import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stranda.operators.drift import assign, declared, drift, unified

LINE = '##FORMAT=<ID={},Number={},Type={},Description="{}">'


def header(*tags):
    return "\n".join(["##fileformat=VCFv4.2", *(LINE.format(*t) for t in tags), "#CHROM"])


FILES = "run_id long, file_id long, file_seq int, arrived_at timestamp, header_text string, tag string"
CALLS = "row_id long, file_id long, chrom string, pos int, sample_id string, fmt string, val string"


def test_declared():
    h = '##FORMAT=<Number=1,ID=DP,Description="a \\"b\\", Type=x, ID=Q",Type=Integer>\r\n##was_FORMAT=<ID=PL,Number=G,Type=Integer,Description="x">\r\n##INFO=<ID=AD>\r\n##FORMAT=<ID=DP,Number=2,Type=Float,Description="">\n##FORMAT=<Number=1>\n##FORMAT=<ID=E,Number=1,Type=String,Description="">'
    assert declared(h) == [{"tag": "DP", "number": "1", "type": "Integer", "descr": "abtypexidq"}, {"tag": "E", "number": "1", "type": "String", "descr": ""}]
    assert declared(None) == declared("") == []


def test_changes(spark):
    rows = [
        (1, 10, 1, None, header(("GT", 1, "String", "Genotype"), ("PL", "G", "Integer", "Likelihoods."), ("AD", "R", "Integer", "Depths"), ("XX", 1, "Float", "x")), "t"),
        (1, 11, 5, None, header(("GT", 1, "String", "genotype"), ("LPL", "G", "Float", "LIKELIHOODS"), ("AD", "A", "Integer", "Depths"), ("NEW", 1, "Float", "y")), "t"),
        (1, 11, 5, None, header(("GT", 1, "String", "genotype"), ("LPL", "G", "Float", "LIKELIHOODS"), ("AD", "A", "Integer", "Depths"), ("NEW", 1, "Float", "y")), "t"),
        (1, 12, 9, None, None, "t"),
        (2, 13, 1, None, header(("GT", 1, "String", "Genotype")), "t"),
        (None, 14, 1, None, header(("Z", 1, "String", "z")), "t"),
    ]
    files = spark.createDataFrame(rows, FILES)
    calls = spark.createDataFrame([(1, 10, "1", 5, "s", "GT:PL", "0/1:1,2,3"), (2, 11, "1", 6, "s", "GT:LPL", "0/1:1.0,2.0,3.0"), (3, None, None, None, None, None, None)], CALLS)
    got = {tuple(r) for r in drift(files, calls).select("file_id", "tag", "drift", "was").collect()}
    assert got == {(11, "LPL", "renamed", "PL"), (11, "LPL", "retyped", "PL"), (11, "AD", "retyped", "AD"), (11, "XX", "removed", "XX"), (11, "NEW", "added", None), *((12, t, "removed", t) for t in ("GT", "LPL", "AD", "NEW"))}
    u = {r.row_id: r for r in unified(files, calls, ("GT", "LPL", "DP")).collect()}
    assert u[1].gt == "0/1" and u[1].lpl is None or u[1].other == []
    assert len(u) == 3 and u[3].gt is None


def test_the_assignment_decides(spark, monkeypatch):
    """Two tags of one description went, two came: types, names and values say which became which."""
    from stranda.operators import drift as module

    rows = [
        (1, 10, 1, None, header(("XA", 1, "Integer", "depth"), ("XB", 1, "String", "depth")), "t"), (1, 11, 2, None, header(("YB", 1, "String", "depth"), ("YA", 1, "Integer", "depth")), "t"),
        (2, 20, 1, None, header(("P", 1, "String", "q"), ("Q", 1, "String", "q")), "t"), (2, 21, 2, None, header(("M", 1, "String", "q"), ("N", 1, "String", "q")), "t"),
    ]
    files = spark.createDataFrame(rows, FILES)
    calls = spark.createDataFrame([(1, 20, "1", 5, "s", "P:Q", "7:aaaa,b,c"), (2, 21, "1", 6, "s", "M:N", "aaaa,b,c:7")], CALLS)
    got = lambda: {tuple(r) for r in drift(files, calls).select("file_id", "tag", "drift", "was").collect()}
    want = {(11, "YA", "renamed", "XA"), (11, "YB", "renamed", "XB"), (21, "M", "renamed", "Q"), (21, "N", "renamed", "P")}
    assert got() == want
    old, new = ([{"tag": t, "number": "1", "type": k, "descr": "d"} for t, k in side] for side in ([("XA", "Integer"), ("XB", "String")], [("YB", "String"), ("YA", "Integer")]))
    assert sorted(module.compare(old, new, {}, {})) == [("YA", "renamed", "XA"), ("YB", "renamed", "XB")]
    monkeypatch.setattr(module, "assign", lambda w: [(i, i) for i in range(min(w.shape))])
    assert ("YB", "retyped", "XA") in module.compare(old, new, {}, {})


def test_no_value_is_lost(spark):
    """Lists with either separator are read; what a column can't hold stands in other."""
    fmt = "GT:DP:PL:AD:XX"
    vals = ["0/1:7:0;0;149:10;10:z", "0/1:7.0:1,.,3:.:.", "0/1:3,4:1,x,3:9;9:q", "0/1:1e30:5:NaN:u", "0/1:.:6", "0/1:1:2:3:4:5"]
    rows = [(i, 10, "1", 5, "s", fmt, v) for i, v in enumerate(vals)] + [(6, 10, "1", 5, "s", "DP:DP:DP", "1:2:."), (7, 10, "1", 5, "s", None, "8"), (8, 10, "1", 5, "s", fmt, None)]
    u = {r.row_id: r for r in unified(spark.createDataFrame([], FILES), spark.createDataFrame(rows, CALLS), ("GT", "DP", "PL", "AD")).collect()}
    other = {k: None if r.other is None else [tuple(x) for x in r.other] for k, r in u.items()}
    assert (u[0].dp, u[0].pl, u[0].ad, other[0]) == (7, [0, 0, 149], [10, 10], [("XX", "z")])
    assert (u[1].dp, u[1].pl, u[1].ad, other[1]) == (7, [1, None, 3], None, [("XX", ".")])
    assert (u[2].dp, u[2].pl, u[2].ad, other[2]) == (None, None, [9, 9], [("DP", "3,4"), ("PL", "1,x,3"), ("XX", "q")])
    assert (u[3].dp, u[3].pl, other[3]) == (None, [5], [("DP", "1e30"), ("XX", "u")])
    assert (u[4].dp, u[4].pl, other[4]) == (None, [6], [("XX", None)])
    assert other[5] == [("XX", "4"), (None, "5")] and (u[6].dp, other[6]) == (1, [("DP", "2")])
    assert other[7] == [(None, "8")] and other[8] is None


def test_empty(spark):
    f, c = spark.createDataFrame([], FILES), spark.createDataFrame([], CALLS)
    assert drift(f, c).count() == 0 and unified(f, c).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.randoms(use_true_random=False))
def test_assignment_is_best(n, m, rnd):
    w = np.array([[rnd.choice([0, 0, 1, 2, 3.5]) for _ in range(m)] for _ in range(n)])
    got = assign(w)
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
    k = min(n, m)
    best = max(sum(w[i, j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    assert sum(w[i, j] for i, j in got) == best
