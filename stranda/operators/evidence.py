"""Site features from reads and posterior genotypes, filters on evidence, inverse-normal scores."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stranda.functions.special import binomial_cdf, normal_quantile
from stranda.operators.features import em_hwe, pair_table, probabilities

MAX_QUALITY = 40

# What keeps ratios of empty sums apart from 0, variances, shares of reads, and an error of a genotype.
TINY, SPREAD, SHARE, LEAST_ERROR = 1e-6, 0.1, 0.05, 3.162278e-26


def correlation(n: Column, xy: Column, x1: Column, x2: Column, y1: Column, y2: Column, buffer: float = SPREAD) -> Column:
    """Correlation of two measures from their sums, the buffer added to the product of their variances; 0 for none."""
    spread = (x2 / n - (x1 / n) * (x1 / n)) * (y2 / n - (y1 / n) * (y1 / n)) + buffer
    return F.when(n > 0, (xy / n - x1 * y1 / n / n) / F.sqrt(spread)).otherwise(0.0)


def read_features(reads: DataFrame, keys: list[str], sample: str = "sample", max_quality: int = MAX_QUALITY) -> DataFrame:
    """keys, abe, abz, bqz, mqz, cyz, stz, nmz, ior, nm0, nm1 of each site, to six places.

    One row a read: al (0 for REF, 1 and more for an ALT, -1 for another base), bq, mq, cy (cycle), st (1 for reverse
    reads), nm (mismatches), g (the sample's copies of ALT). Sums by site and sample come first, then samples are joined
    by Stouffer's method, weighted by the log of their reads; both are plain aggregations with map-side parts. Measures
    of heterozygous samples alone are 0 where there are none. ior is the log10 of how much oftener other bases of quality
    over 20 are seen than their errors account for, null where there is no such base.
    """
    q = F.least(F.col("bq"), F.lit(max_quality))
    al, seen = F.col("al") > 0, F.col("al") >= 0
    td = -F.log(F.abs(F.col("cy")) + 1.0)
    nm = F.when(al, F.col("nm") - 1).otherwise(F.col("nm"))
    total = lambda c, where=seen: F.sum(F.when(where, c.cast("double")).otherwise(0.0))
    one = F.lit(1)
    sums = {"n": total(one), "a": total(one, al), "good": total(one, q > 20), "odd": total(one, ~seen & (q > 20)), "due": total(F.pow(F.lit(10.0), -q / 10) * 2 / 3, q > 20), "nma": total(nm, al), "nms": total(nm)}
    for name, c in (("bq", q), ("mq", F.col("mq")), ("cy", td), ("st", F.col("st")), ("nm", nm)):
        sums |= {f"{name}x": total(c, al), f"{name}1": total(c), f"{name}2": total(c * c)}
    s = reads.groupBy(*keys, sample).agg(F.max("g").alias("g"), *[v.alias(k) for k, v in sums.items()])
    n, a = F.col("n"), F.col("a")
    w, wq, wa, wr = (F.log(x + 1.0) for x in (n, F.col("good"), a, n - a))
    het = F.col("g") == 1
    stouffer = lambda z: F.coalesce(F.sum(F.when(het, z * w)) / F.sqrt(F.sum(F.when(het, w * w)) + TINY), F.lit(0.0))
    mean = lambda x, weight, where=None: F.coalesce(F.sum(x * weight if where is None else F.when(where, x * weight)) / (F.sum(weight if where is None else F.when(where, weight)) + TINY), F.lit(0.0))
    r = {name: F.sqrt(n) * correlation(n, F.col(f"{name}x"), F.col(f"{name}1"), F.col(f"{name}2"), a, a) for name in ("bq", "mq", "cy", "st", "nm")}
    out = {
        "abe": mean((n - a + SHARE) / (n + 2 * SHARE), w, het),
        "abz": stouffer((n - a - n * 0.5) / F.sqrt(n * 0.25 + 1e-3)),
        **{f"{name}z": stouffer(z) for name, z in r.items()},
        "ior": F.log10(F.sum(F.col("odd") / (F.col("due") + TINY) * wq) / F.nullif(F.sum(wq), F.lit(0.0)) + TINY),
        "nm1": mean(F.when(a > 0, F.col("nma") / a).otherwise(0.0), wa),
        "nm0": mean(F.when(n > a, (F.col("nms") - F.col("nma")) / (n - a)).otherwise(0.0), wr),
    }
    return s.groupBy(*keys).agg(*[F.round(v, 6).alias(k) for k, v in out.items()])


def posterior_genotypes(pls: list, n_allele: int) -> tuple[list, list]:
    """(genotypes, qualities): each sample's most probable genotype under the site's Hardy-Weinberg frequencies, and -10
    log10 of its error, at most 255; samples without likelihoods have the frequencies' best."""
    size = n_allele * (n_allele + 1) // 2
    whole = [p is not None and len(p) == size for p in pls]
    pl = np.array([list(p) if ok else [0] * size for p, ok in zip(pls, whole)], dtype=float)
    prob = probabilities(pl)
    _, gf = em_hwe(prob[np.array(whole)] if any(whole) else prob, n_allele)
    post = prob * gf
    post /= post.sum(axis=1, keepdims=True)
    best = post.argmax(axis=1)
    error = np.maximum(1 - post[np.arange(len(best)), best], LEAST_ERROR)
    pairs = pair_table(n_allele)
    return [list(pairs[b]) for b in best], np.minimum(255, np.round(-10 * np.log10(np.minimum(error, 1)))).astype(int).tolist()


def call_genotypes(sites: DataFrame) -> DataFrame:
    """sites (pls, n_allele, other columns) with gts, gqs, ac and an of the called genotypes, and qual, the best quality
    of a genotype with an ALT (0 if there is none)."""
    kept = [c for c in sites.columns if c not in ("pls", "dps")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sites.schema if f.name in kept] + ["gts array<array<int>>, gqs array<int>, called_ac int, called_an int, called_qual int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made = [posterior_genotypes(list(p), int(n)) if len(p) else ([], []) for p, n in zip(x["pls"], x["n_allele"])]
            out = x[kept].reset_index(drop=True)
            out["gts"], out["gqs"] = [m[0] for m in made], [m[1] for m in made]
            out["called_ac"] = [sum(a > 0 for g in m[0] for a in g) for m in made]
            out["called_an"] = [2 * len(m[0]) for m in made]
            out["called_qual"] = [max([q for g, q in zip(*m) if any(g)], default=0) for m in made]
            yield out

    return sites.mapInPandas(run, schema)


def enough_evidence(e: Column, n: Column, least: int = 2, fraction: float = 0.0, bias: float = 0.0, type2: float = 0.0, depth: int = 512) -> Column:
    """Whether e reads of n are enough: at least `least`, and either a fraction, or with a type II error a binomial test
    against one half less the bias. The test's least e for every n up to `depth` is a table in the plan; deeper sites use
    the normal approximation."""
    if not type2:
        return (e >= least) & (e / n >= fraction)
    p = 0.5 - bias
    table = []
    k = 0
    for d in range(depth + 1):
        while k < d and binomial_cdf(k, d, p) < type2:
            k += 1
        table.append(k)
    deep = n * p + normal_quantile(type2) * F.sqrt(n * p * (1 - p))
    need = F.when(n <= depth, F.get(F.array(*[F.lit(x) for x in table]), n.cast("int"))).otherwise(deep)
    return (e >= least) & (e >= need)


def inverse_normal(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the normal score of a value's dense rank over its number of different values, null for null.

    Ranks come from the distinct values sorted in ranges: each range counts its own, and a sum over one row a range
    gives what lies before it, so no task sorts all values.
    """
    from pyspark.sql import Window

    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct().repartitionByRange("_v")
    parts = values.withColumn("_p", F.spark_partition_id())
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_v").alias("_m"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_t", F.sum("_c").over(Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_v"))).join(before.select("_p", "_b", "_t"), "_p")

    @F.pandas_udf("double")
    def score(p: pd.Series) -> pd.Series:
        return p.map(normal_quantile)

    scores = ranked.select("_v", score((F.col("_b") + F.col("_r")) / (F.col("_t") + 1)).alias(out))
    return df.join(scores, df[column] == scores["_v"], "left").drop("_v")


def normal_share(z: Column) -> Column:
    """Probability that a standard normal variable is at most z."""

    @F.pandas_udf("double")
    def share(values: pd.Series) -> pd.Series:
        return values.map(NormalDist().cdf)

    return share(z)
