"""Every registered query runs; those with SQL agree with DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = [*entry.data_queries.QUERIES, *entry.variant_queries.QUERIES]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return tuple(sorted(v.items())) if isinstance(v, dict) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    assert rows == sorted(repr(tuple(plain(x) for x in r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["vt", "n_alt", "n", "ts", "tv", "ins", "del"] and df.count() > 0


def test_found_columns(spark, sf):
    want = {
        "p1_found": ["src", "set_id", "rid", "piece", "beg1", "end1"], "p2_found": ["src", "line_id", "reason"], "p3_found": ["set_id", "first_id", "last_id", "n_records", "n_bases"],
        "p4_found": ["src", "rid"], "p5_found": ["run_id", "file_id", "tag", "drift"],
    }
    for name, columns in want.items():
        assert entry.queries()[name](spark, sf).columns == columns


def test_sql_functions(spark):
    from stranda.functions.sequences import register

    register(spark)
    r = spark.sql("SELECT reverse_complement('ACGG'), canonical_motif('GAC'), motif_basis('TACTA'), variant_key('1', 5, 'A', array('C', 'G')), allele_key('A', array('G', 'C')), genotype_index(1, 2), vtype_name(5)").collect()[0]
    assert tuple(r) == ("CCGT", "ACG", "ACT", "1:5:A/C/G", "A,C,G", 4, "SNP/INDEL")
