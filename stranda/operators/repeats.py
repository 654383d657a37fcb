"""Tandem repeats: their annotation, extraction from indels, and consolidation of overlapping ones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stranda.functions import alleles as A
from stranda.functions import sequences as S
from stranda.operators.intervals import with_cluster
from stranda.session import cut

# Least tract length for motifs of one to six bases in each published scheme, and for longer motifs the
# least length, TWICE for two motifs, or None if they are no repeats.
TWICE = -1
SCHEMES = {
    "willems2014": ((6, 11, 14, 14, 16, 17), TWICE),
    "montgomery2014": ((6, 9, 11, 13, 14, 16), 18),
    "ananda2013": ((2, 4, 6, 8, 10, 12), TWICE),
    "fondon2012": ((6, 13, 20, 23, 27, 27), None),
    "kelkar2008": ((6, 10, 6, 8, 10, 12), TWICE),
    "lai2003": ((6, 8, 12, 16, 20, 24), TWICE),
}


def annotate_repeats(df: DataFrame, motif: str = "motif", tract: str = "repeat_tract") -> DataFrame:
    """df with ex_motif (least rotation), ex_ru (unit with which the tract starts), ex_basis, ex_mlen, ex_comp, ex_entropy,
    ex_entropy2, ex_kl, ex_rl (tract length), ex_ll (whole units times motif length) and ex_purity.

    All built of column expressions, so the plan keeps them in the JVM. Null motifs or tracts have null annotations.
    """
    m, t = F.upper(motif), F.upper(tract)
    return (
        df.withColumn("ex_motif", S.canonical(m))
        .withColumn("ex_ru", F.substr(t, F.lit(1), F.length(m)))
        .withColumn("ex_basis", S.basis(m))
        .withColumn("ex_mlen", F.length(m))
        .withColumn("ex_comp", S.counts(t))
        .withColumn("ex_entropy", S.entropy(t))
        .withColumn("ex_entropy2", S.pair_entropy(t))
        .withColumn("ex_kl", S.divergence(t))
        .withColumn("ex_rl", F.length(t))
        .withColumn("ex_ll", (F.length(t) / F.length(m)).cast("int") * F.length(m))
        .withColumn("ex_purity", S.exact_purity(t, F.substr(t, F.lit(1), F.length(m))))
    )


ALIGNED = "fz_motif string, fz_purity double, fz_copies int, fz_perfect int, fz_score double"


def annotate_fuzzy(df: DataFrame, tract: str = "repeat_tract", motif: str = "motif") -> DataFrame:
    """df with the motif that fits the tract best (the record's own where it has one), and what the repeat model says of
    the tract: purity (share of perfect copies), copies, perfect copies, log score. Null tracts have nulls."""
    from stranda.functions.alignment import align_repeats, detect_motifs

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [ALIGNED])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            seqs = [t.upper() if t else "" for t in x[tract]]
            units = [(m.upper() if m else next((c for c, _, _ in detect_motifs(seq)), "")) if seq else "" for seq, m in zip(seqs, x[motif])]
            found = align_repeats(list(zip(seqs, units)))
            rows = [(unit, round(perfect / max(1, copies), 4), copies, perfect, round(score, 4)) if unit else (None,) * 5 for unit, (copies, perfect, score) in zip(units, found)]
            out = x.reset_index(drop=True)
            for i, name in enumerate(("fz_motif", "fz_purity", "fz_copies", "fz_perfect", "fz_score")):
                values = [r[i] for r in rows]
                out[name] = pd.array(values, dtype="Int32") if name in ("fz_copies", "fz_perfect") else values
            yield out

    return df.mapInPandas(run, schema)


def is_repeat(mlen: Column, rl: Column, scheme: str, perfect: Column | None = None, score: Column | None = None) -> Column:
    """Whether a tract of rl bases of a motif of mlen bases is a repeat under a scheme.

    exact_vntr and fuzzy_vntr take every tract; tan_kang2015 asks for six bases beyond the motif, two perfect copies and
    a score over 0.9, or 0.75 for motifs of more than one base; the others have a least length by motif length.
    """
    if scheme in ("exact_vntr", "fuzzy_vntr"):
        return F.lit(True)
    if scheme == "tan_kang2015":
        enough = F.lit(True) if perfect is None else perfect >= 2
        fits = F.lit(True) if score is None else score > F.when(mlen == 1, 0.9).otherwise(0.75)
        return (rl - mlen >= 6) & enough & fits
    least, longer = SCHEMES[scheme]
    long_enough = F.lit(False) if longer is None else rl >= 2 * mlen if longer == TWICE else rl >= longer
    return F.when(mlen > len(least), long_enough).otherwise(rl >= F.get(F.array(*[F.lit(x) for x in least]), mlen - 1))


def indel_tracts(df: DataFrame, chunks: DataFrame, flank: int = 256, chunk_bits: int = 16) -> DataFrame:
    """rid, chrom, pos, beg1, end1, motif, copies, left, right, indel: the exact repeat tract of each indel.

    An indel's sequence can be moved left and right as far as the reference repeats it; that stretch is the tract, the
    sequence's smallest unit, in its least rotation, the motif; left and right are ten bases to either side of the tract.
    Of several ALTs the tracts are united, and the motif is that of the longest, the first of equals. A record whose tract
    reaches its window of `flank` bases is done again with a window 16 times as wide, until none does. Records without an
    ALT anchored by a shared first base, one side of it that base alone, or where there is no reference, are left out.
    """
    from stranda.functions.alignment import repeat_region
    from stranda.operators.records import reference_windows

    alts = F.coalesce(F.col("alts"), F.array().cast("array<string>"))
    indel = lambda a: ~A.is_symbolic(a) & (F.length("ref") != F.length(a)) & (F.least(F.length("ref"), F.length(a)) == 1) & (F.substr(a, F.lit(1), F.lit(1)) == F.substr("ref", F.lit(1), F.lit(1)))
    rest = df.where(F.exists(alts, indel) & F.col("pos").isNotNull()).select("rid", "chrom", "pos", "ref", "alts", F.filter(alts, indel).alias("_indels"))
    names = ["rid", "chrom", "pos", "beg1", "end1", "motif", "copies", "left", "right", "indel"]
    schema = "rid int, chrom string, pos int, beg1 int, end1 int, motif string, copies int, left string, right string, indel string, ref string, alts array<string>, _indels array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for rid, chrom, pos, ref, every, some, window, beg in zip(x["rid"], x["chrom"], x["pos"], x["ref"], x["alts"], x["_indels"], x["window"], x["window_beg"]):
                if not window:
                    continue
                pos, beg, gone = int(pos), int(beg), len(ref) - 1
                at = pos - beg + 1
                tracts, short = [], False
                for alt in some:
                    seq = (alt if len(alt) > len(ref) else ref)[1:].upper()
                    left, right = repeat_region(window[:at], seq, window[at + gone :])
                    after = len(window) - at - gone
                    short |= left + 10 > at and beg > 1 or right + 10 > after and after == flank + 11
                    tracts.append((pos + 1 - left, pos + gone + right, seq))
                if short:
                    out.append((rid, chrom, pos, *[None] * 7, ref, list(every), list(some)))
                    continue
                seq = max(tracts, key=lambda t: t[1] - t[0])[2]
                unit = next(seq[:k] for k in range(1, len(seq) + 1) if len(seq) % k == 0 and seq[:k] * (len(seq) // k) == seq)
                motif = min(unit[i:] + unit[:i] for i in range(len(unit)))
                b, e = min(t[0] for t in tracts), max(t[1] for t in tracts)
                at, size = b - beg, max(0, e - b + 1)
                out.append((rid, chrom, pos, b, e, motif, size // len(motif), window[max(0, at - 10) : at], window[at + size : at + size + 10], f"{chrom}:{pos}:{'/'.join([ref, *every])}", None, None, None))
            yield pd.DataFrame(out, columns=[*names, "ref", "alts", "_indels"])

    done = []
    while True:
        # Ten bases more to each side, so that a tract that ends inside the window has its flanks there too.
        rows = reference_windows(rest, chunks, F.col("pos") - flank - 10, F.col("pos") + F.length("ref") + flank + 10, chunk_bits)
        found = cut(rows.mapInPandas(run, schema))
        done.append(found.where("indel is not null").select(*names))
        rest = found.where("indel is null").select("rid", "chrom", "pos", "ref", "alts", "_indels")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        flank *= 16


def extract_repeats(df: DataFrame, chunks: DataFrame, scheme: str = "willems2014", flank: int = 256, chunk_bits: int = 16) -> DataFrame:
    """rid, chrom, beg1, end1, motif, associated: the repeats that indels of the table stand in, one row a place.

    Tracts that are no repeat under the scheme are left out; associated are the indels of a tract.
    """
    found = indel_tracts(df, chunks, flank, chunk_bits)
    kept = found.where(is_repeat(F.length("motif"), F.col("end1") - F.col("beg1") + 1, scheme))
    return kept.groupBy("rid", "chrom", "beg1", "end1", "motif").agg(F.array_join(F.array_sort(F.collect_set("indel")), ",").alias("associated"))


def consolidate_repeats(df: DataFrame) -> DataFrame:
    """rid, beg1, end1, n, state, motif: clusters of overlapping repeats; state is isolated, merged (one canonical motif
    in the cluster), same_basis (one set of bases) or mixed; motif is given for the first two. df has rid, beg1, end1 and
    motif; null motifs count as a motif of their own."""
    rows = df.select("rid", "beg1", "end1", F.coalesce(S.canonical_both_strands(F.upper("motif")), F.lit("")).alias("motif"))
    rows = rows.withColumn("basis", S.basis(F.col("motif")))
    g = with_cluster(rows, "rid", "beg1", "end1").groupBy("rid", "cluster_beg", "cluster_end")
    out = g.agg(F.count("*").alias("n"), F.min("motif").alias("m0"), F.max("motif").alias("m1"), F.min("basis").alias("b0"), F.max("basis").alias("b1"))
    state = F.when(F.col("n") == 1, "isolated").when(F.col("m0") == F.col("m1"), "merged").when(F.col("b0") == F.col("b1"), "same_basis").otherwise("mixed")
    return out.select("rid", F.col("cluster_beg").alias("beg1"), F.col("cluster_end").alias("end1"), "n", state.alias("state"), F.when(F.col("m0") == F.col("m1"), F.col("m0")).alias("motif"))
