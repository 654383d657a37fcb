"""Statistics of sites from genotypes and genotype likelihoods of many samples.

A site's likelihoods come as one list of samples' PL lists; the EM runs over numpy arrays inside an Arrow batch. Sites
are gathered by their key with partial aggregation; a site holds as many samples as there are, not as many as rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stranda.functions.special import chi2_log_upper

MAX_ITERATIONS, TOLERANCE = 50, 1e-20
PL_CAP = 3236
ESTIMATES = ("AF", "MLEAF", "HWEAF", "HWE", "AB", "FIC")


def pair_table(n_allele: int) -> list[tuple[int, int]]:
    """Allele pairs in the order of a G-ordered list."""
    return [(i, j) for j in range(n_allele) for i in range(j + 1)]


def probabilities(pls: np.ndarray) -> np.ndarray:
    return 10.0 ** (-np.minimum(pls, PL_CAP) / 10.0)


def em_hwe(prob: np.ndarray, n_allele: int) -> tuple[np.ndarray, np.ndarray]:
    """Allele and genotype frequencies under Hardy-Weinberg proportions, from samples x genotypes likelihoods."""
    pairs = pair_table(n_allele)
    a, b = (np.array([p[i] for p in pairs]) for i in (0, 1))
    twice = np.where(a == b, 1.0, 2.0)
    dose = np.zeros((len(pairs), n_allele))
    np.add.at(dose, (np.arange(len(pairs)), a), 0.5)
    np.add.at(dose, (np.arange(len(pairs)), b), 0.5)
    af = np.full(n_allele, 1.0 / n_allele)
    for _ in range(MAX_ITERATIONS):
        weight = prob * (twice * af[a] * af[b])
        weight /= weight.sum(axis=1, keepdims=True)
        new = weight.mean(axis=0) @ dose
        moved = float(((new - af) ** 2).sum())
        af = new
        if moved <= TOLERANCE:
            break
    return af, twice * af[a] * af[b]


def em_free(prob: np.ndarray, n_allele: int) -> tuple[np.ndarray, np.ndarray]:
    """Allele and genotype frequencies without that assumption; an allele's frequency is half its expected dose."""
    pairs = pair_table(n_allele)
    gf = np.full(prob.shape[1], 1.0 / prob.shape[1])
    for _ in range(MAX_ITERATIONS):
        weight = prob * gf
        weight /= weight.sum(axis=1, keepdims=True)
        new = weight.mean(axis=0)
        moved = float(((new - gf) ** 2).sum())
        gf = new
        if moved <= TOLERANCE:
            break
    af = np.zeros(n_allele)
    for g, (i, j) in zip(gf, pairs):
        af[i] += g / 2
        af[j] += g / 2
    return af, gf


# What is added to the reads of REF and to all reads of heterozygotes, and the reads' share in the bend of PL.
REF_PRIOR, READ_PRIOR, BEND = 0.05, 0.10, 6


def allele_balance(pl: np.ndarray, weight: np.ndarray, depth: np.ndarray, n_allele: int) -> float:
    """Share of REF among the reads of heterozygotes, from PLs, weights (likelihood times frequency) and depths.

    For each ALT a sample counts by its posterior of being REF/ALT among REF/REF, REF/ALT and ALT/ALT; its share of REF
    reads follows from how far its PLs lean to one homozygote, against their bend at the heterozygote. Samples without
    depth, or whose three weights vanish, count nothing.
    """
    alt = np.arange(1, n_allele)
    het, hom = alt * (alt + 1) // 2, alt * (alt + 3) // 2
    ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(a, dtype=float), where=b != 0)
    ref = slice(0, 1)
    reads = ratio(weight[:, het], weight[:, ref] + weight[:, het] + weight[:, hom]) * depth[:, None]
    lean = ratio(pl[:, hom] - pl[:, ref], pl[:, ref] + pl[:, hom] - 2 * pl[:, het] + BEND * depth[:, None])
    return float((REF_PRIOR + (reads * (1 + lean) / 2).sum()) / (READ_PRIOR + reads.sum()))


def site_features(pls: list, dps: list | None, n_allele: int) -> dict:
    """All likelihood features of one site; samples with a missing or short PL list don't count."""
    size = n_allele * (n_allele + 1) // 2
    whole = [k for k, p in enumerate(pls) if p is not None and len(p) == size and not any(x is None or x != x for x in p)]
    if not whole or n_allele < 2:
        return {}
    pl = np.array([list(pls[k]) for k in whole], dtype=float)
    prob = probabilities(pl)
    hwe_af, hwe_gf = em_hwe(prob, n_allele)
    mle_af, mle_gf = em_free(prob, n_allele)
    l0, la = np.log(prob @ hwe_gf).sum(), np.log(prob @ mle_gf).sum()
    lr = float(l0 - la)
    df = size - n_allele
    het = np.array([i != j for i, j in pair_table(n_allele)])
    seen = ((prob * mle_gf)[:, het].sum(axis=1) / (prob @ mle_gf)).sum()
    due = ((prob * hwe_gf)[:, het].sum(axis=1) / (prob @ hwe_gf)).sum()
    qual = -10 * np.log10(np.maximum(1 - prob[:, 0] / prob.sum(axis=1), 1e-300)).sum()
    out = {"ns": len(whole), "hweaf": hwe_af[1:].tolist(), "hwegf": hwe_gf.tolist(), "mleaf": mle_af[1:].tolist(), "mlegf": mle_gf.tolist(), "hwe_llr": lr, "hwe_lpval": chi2_log_upper(0.0 if lr > 0 else -2 * lr, df), "hwe_df": df, "fic": float(1 - seen / due) if due else None, "qual": float(round(qual))}
    if dps is not None:
        depth = np.array([dps[k] if dps[k] is not None else np.nan for k in whole], dtype=float)
        out["ab"] = allele_balance(pl, prob * mle_gf, np.nan_to_num(depth), n_allele)
    return out


FEATURES = "ns int, hweaf array<double>, hwegf array<double>, mleaf array<double>, mlegf array<double>, hwe_llr double, hwe_lpval double, hwe_df int, fic double, qual double, ab double"


def likelihood_features(sites: DataFrame) -> DataFrame:
    """sites with the features of their likelihoods, null where no sample has any.

    sites has pls (list of PL lists), dps (list of depths) and n_allele: HWEAF and HWEGF, MLEAF and MLEGF by EM of at
    most 50 rounds, the likelihood ratio test of Hardy-Weinberg proportions (natural logs), the inbreeding coefficient
    FIC, the allele balance AB and QUAL.
    """
    kept = [c for c in sites.columns if c not in ("pls", "dps")]
    names = [x.split(" ")[0] for x in FEATURES.split(", ")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sites.schema if f.name in kept] + [FEATURES])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [site_features(list(p), list(d) if d is not None else None, int(n)) if p is not None else {} for p, d, n in zip(x["pls"], x["dps"], x["n_allele"])]
            out = x[kept].reset_index(drop=True)
            for name in names:
                values = [r.get(name) for r in rows]
                out[name] = pd.array(values, dtype="Int32") if name in ("ns", "hwe_df") else values
            yield out

    return sites.mapInPandas(run, schema)


def gathered(calls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, pls, dps, ac, an, af, n_allele of biallelic sites from one row a call (gt, pl, dp), in the given order."""
    g = calls.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "pl", "dp"))).alias("x"), F.sum(F.size(F.filter("gt", lambda a: a.isNotNull() & (a > 0)))).alias("ac"), F.sum(F.size(F.filter("gt", lambda a: a.isNotNull()))).alias("an"))
    return g.select(*keys, F.transform("x", lambda s: s["pl"]).alias("pls"), F.transform("x", lambda s: s["dp"]).alias("dps"), "ac", "an", F.when(F.col("an") > 0, F.round(F.col("ac") / F.col("an"), 6)).alias("af"), F.lit(2).alias("n_allele"))


def estimate(sites: DataFrame, estimates: tuple[str, ...] = ESTIMATES) -> DataFrame:
    """gathered sites with the columns of the named estimates alone."""
    columns = {"AF": ["ac", "an", "af"], "MLEAF": ["mleaf", "mlegf"], "HWEAF": ["hweaf", "hwegf"], "HWE": ["hwe_llr", "hwe_lpval", "hwe_df"], "AB": ["ab"], "FIC": ["fic"]}
    unknown = set(estimates) - set(columns)
    if unknown:
        raise ValueError(f"no estimates {sorted(unknown)}")
    keys = [c for c in sites.columns if c not in ("pls", "dps", "ac", "an", "af", "n_allele")]
    return likelihood_features(sites).select(*keys, "ns", *[c for e in estimates for c in columns[e]])


TRANSMISSION = np.array([[[(2 - f) * (2 - m) / 4, (f * (2 - m) + m * (2 - f)) / 4, f * m / 4] for m in range(3)] for f in range(3)])


def family_likelihoods(families: list, unrelated: list, iterations: int = MAX_ITERATIONS) -> dict:
    """lud, lre, bf: log10 likelihoods of a site's PLs with all individuals unrelated and with children bound to their
    parents, and how many the second exceeds the first by.

    families is a list of (father, mother, children) of PL triples, None for a missing one; PLs count up to 255. The
    allele frequency is that of the unrelated model over founders and single individuals.
    """
    as_prob = lambda p: 10.0 ** (-np.minimum(np.asarray(p, dtype=float), 255) / 10) if p is not None and len(p) == 3 else np.ones(3)
    fams = [(as_prob(f), as_prob(m), [as_prob(c) for c in kids]) for f, m, kids in families]
    alone = [as_prob(u) for u in unrelated]
    founders = [x for f, m, _ in fams for x in (f, m)] + alone
    if not founders:
        return {"lud": 0.0, "lre": 0.0, "bf": 0.0}
    _, gf = em_hwe(np.array(founders), 2)
    lone = sum(math.log10(max(p @ gf, 1e-300)) for p in alone)
    lud = lone + sum(math.log10(max(p @ gf, 1e-300)) for f, m, kids in fams for p in (f, m, *kids))
    lre = lone
    for f, m, kids in fams:
        both = np.outer(f * gf, m * gf)
        for c in kids:
            both = both * (TRANSMISSION @ c)
        lre += math.log10(max(both.sum(), 1e-300))
    return {"lud": lud, "lre": lre, "bf": lre - lud}


def family_filter(sites: DataFrame) -> DataFrame:
    """sites with lud, lre and bf; sites has fathers, mothers, children: lists of PL triples, place i one trio's."""
    kept = [c for c in sites.columns if c not in ("fathers", "mothers", "children")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sites.schema if f.name in kept] + ["lud double, lre double, bf double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [family_likelihoods([(f, m, [c]) for f, m, c in zip(fs, ms, cs)], []) for fs, ms, cs in zip(x["fathers"], x["mothers"], x["children"])]
            out = x[kept].reset_index(drop=True)
            for name in ("lud", "lre", "bf"):
                out[name] = [r[name] for r in rows]
            yield out

    return sites.mapInPandas(run, schema)
