import pytest

from stranda.functions.alleles import classified
from stranda.functions.filters import FilterError, compile_filter, compile_filters

SCHEMA = "id int, ref string, alts array<string>, qual float, filters array<string>, info map<string,string>"
ROWS = [
    (1, "A", ["G"], 50.0, ["PASS"], {"AF": "0.1,0.2", "DP": "7", "DB": None, "RU": "AC"}),
    (2, "AT", ["A"], None, ["low"], {"DP": "3"}),
    (3, "A", ["G", "AT"], 10.0, [], {"AF": "0.9", "DP": "x"}),
    (4, "A", ["<VNTR>"], 99.0, ["PASS"], {}),
    (5, "N", ["A"], 1.0, ["PASS", "low"], {"DP": "5"}),
]
TYPES = {"AF": "float", "DP": "int", "DB": "flag", "RU": "string"}

CASES = {
    "": {1, 2, 3, 4, 5},
    "VTYPE==SNP": {1, 5},
    "VTYPE & INDEL": {2, 3},
    "(VTYPE&INDEL)==4": {2, 3},
    "QUAL>=10": {1, 3, 4},
    "~(QUAL>=10)": {2, 5},
    "PASS && QUAL>40": {1, 4},
    "N_ALLELE==3 || FILTER.low": {2, 3, 5},
    # && is looser than ||: PASS && (FILTER.low || N_ALLELE==2)
    "PASS && FILTER.low || N_ALLELE==2": {1, 4, 5},
    "DLEN<0": {2},
    "LEN==1": {2},
    "INFO.DP>4": {1, 5},
    "INFO.DP==3-2-1": set(),  # right to left: 3-(2-1) = 2
    "INFO.DP-2-1==6": {1},  # 7-(2-1)
    "INFO.AF[2]>0.15": {1},
    "INFO.DB": {1},
    "~INFO.DB": {2, 3, 4, 5},
    "INFO.RU=='A C'": {1},
    "REF=~'^A'": {1, 2, 3, 4},
    "REF~~'^A'": {5},
    "ALT=='G,AT'": {3},
    "VARIANT_CONTAINS_N": {5},
    "N_FILTER==0": {3},
    "QUAL/2>20": {1, 4},
    "QUAL*2+1>100": {1, 4},
    "VTYPE==V": {4},
    "QUAL==INFO.DP": set(),
    "QUAL>-1": {1, 3, 4, 5},
}


@pytest.mark.parametrize("expression", CASES)
def test_expressions(spark, expression):
    df = classified(spark.createDataFrame(ROWS, SCHEMA))
    assert {r.id for r in df.where(compile_filter(expression, TYPES)).collect()} == CASES[expression]


def test_missing_beats_or(spark):
    """A missing left side makes || missing, so the record is rejected, where SQL would keep it."""
    df = classified(spark.createDataFrame([(1, "A", ["G"], None, ["PASS"], {"DP": None})], SCHEMA))
    assert df.where(compile_filter("INFO.DP==QUAL || PASS", TYPES)).count() == 0


@pytest.mark.parametrize("bad", ["QUAL", "QUAL>", "(PASS", "PASS)", "INFO.NO==1", "REF>3", "FOO", "REF=='A", "PASS+'x'", "QUAL=~3"])
def test_errors(spark, bad):
    with pytest.raises(FilterError):
        compile_filter(bad, TYPES)


def test_lists(spark):
    assert len(compile_filters("PASS", 3)) == 3 and len(compile_filters("PASS,QUAL>3", 2)) == 2
    with pytest.raises(FilterError):
        compile_filters("PASS,PASS", 3)
