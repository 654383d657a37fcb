import random

from stranda.operators.evidence import enough_evidence, inverse_normal, posterior_genotypes
from stranda.functions.special import binomial_cdf, normal_quantile
from stranda.streaming import variants

SCHEMA = "row_id long, rid int, pos int, ref string, alts array<string>, at timestamp"


def stream(spark, tmp_path, batches):
    """One file a micro-batch, so that state carries from each to the next."""
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05 * (i + 1 < len(batches)))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return [r.asDict() for r in df.sparkSession.table(name).collect()]


def test_order_is_repaired(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, i % 2, 10 * i + rnd.randint(-40, 40) + 100, "A", ["G"], None) for i in range(60)]
    rows += [(100, 0, 5, "A", ["C"], None), (101, 0, 5000, "A", ["C"], None), (102, 1, 5000, "A", ["C"], None)]
    s = stream(spark, tmp_path, [rows[:20], rows[20:40], rows[40:61], rows[61:]])
    out = drained(variants.repaired_order(s, 100), "ordered", "append", tmp_path)
    for rid in (0, 1):
        on_time = [r["pos"] for r in out if r["rid"] == rid and not r["late"]]
        assert on_time == sorted(on_time)
    assert {r["row_id"] for r in out} == {*range(60), 100}
    assert [r["row_id"] for r in out if r["late"]] == [100]


def test_running_counts_and_duplicates(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2020, 1, 1)
    a = [(1, 0, 5, "A", ["G"], t), (2, 0, 6, "A", ["AT"], t)]
    b = [(1, 0, 5, "A", ["G"], t), (3, 0, 7, "A", ["C"], t)]
    s = stream(spark, tmp_path, [a, b])
    got = {r["vt"]: (r["n"], r["ts"], r["tv"]) for r in drained(variants.running_types(s), "types", "complete", tmp_path)}
    assert got == {"SNP": (3, 2, 1), "INDEL": (1, 0, 0)}
    once = drained(variants.first_deliveries(s, ["row_id"], "at"), "once", "append", tmp_path)
    assert sorted(r["row_id"] for r in once) == [1, 2, 3]


def test_sessions(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2020, 1, 1)
    at = lambda m: t + dt.timedelta(minutes=m)
    rows = [(1, 0, 1, "A", [], at(0)), (2, 0, 1, "A", [], at(29)), (3, 0, 1, "A", [], at(60)), (4, 0, 1, "A", [], None), (5, None, 1, "A", [], at(3))]
    got = sorted((r.rid is None, r.n) for r in variants.sessions(spark.createDataFrame(rows, SCHEMA), "rid", "at").collect())
    assert got == [(False, 1), (False, 2), (True, 1)]
    s = stream(spark, tmp_path, [rows[:3], [(9, 0, 1, "A", [], at(6000))], [(10, 0, 1, "A", [], at(6001))]])
    out = drained(variants.sessions(s, "rid", "at", lateness="10 minutes"), "sess", "append", tmp_path)
    assert sorted(r["n"] for r in out) == [1, 2]


def test_evidence_and_scores(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(e, n) for n in range(1, 60) for e in range(0, n + 1)], "e int, n int")
    got = {(r.e, r.n): r.ok for r in df.withColumn("ok", enough_evidence(F.col("e"), F.col("n"), 2, bias=0.1, type2=0.05)).collect()}
    assert all(ok == (e >= 2 and binomial_cdf(e, n, 0.4) >= 0.05) for (e, n), ok in got.items())
    x = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (None,), (2.0,)], "v double")
    z = {r.v: r.z for r in inverse_normal(x, "v", "z").collect()}
    assert z[None] is None and all(abs(z[v] - normal_quantile(i / 4)) < 1e-12 for i, v in ((1, 1.0), (2, 2.0), (3, 3.0)))
    gts, gqs = posterior_genotypes([[0, 300, 300], [300, 0, 300], [300, 300, 0], None], 2)
    assert gts[:3] == [[0, 0], [0, 1], [1, 1]] and all(q > 100 for q in gqs[:3]) and len(gts) == 4
