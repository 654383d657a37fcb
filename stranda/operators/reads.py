"""Aligned reads: filtering, pile-up, discovery of candidate variants, genotyping of known sites."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stranda.functions.special import log10_sum
from stranda.operators.intervals import overlap_join

EXCLUDED_FLAGS, MIN_MAPQ, MIN_BASEQ = 0x0F04, 20, 13
CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
MD_PART = re.compile(r"(\d+)|\^([A-Za-z]+)|([A-Za-z])")
EVENTS = "chrom string, pos int, kind string, ref string, alt string, strand int, baseq int, mapq int, cycle int, nm int"

# Prior of a variant site, and its shares of heterozygous and homozygous ones.
THETA, HET_SHARE, HOM_SHARE = 1e-3, 1 / 3, 2 / 3


def usable(df: DataFrame, excluded: int = EXCLUDED_FLAGS, mapq: int = MIN_MAPQ) -> DataFrame:
    """Reads without an excluded flag, with the least mapping quality and a whole CIGAR; of two mates that overlap the
    one that begins first, the first in the pair of equal begins."""
    ok = df.where((F.col("flag").bitwiseAND(excluded) == 0) & (F.col("mapq") >= mapq) & F.col("pos").isNotNull() & F.col("cigar").rlike("^([0-9]+[MIDNSHP=X])+$") & F.col("seq").isNotNull())
    spans = F.aggregate(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MDN=X]"), F.lit(1)), F.lit(0), lambda acc, x: acc + x.cast("int"))
    rows = ok.withColumn("end1", F.col("pos") + spans - 1)
    second = (F.col("mate_chrom") == F.col("chrom")) & ((F.col("mate_pos") < F.col("pos")) | ((F.col("mate_pos") == F.col("pos")) & (F.col("flag").bitwiseAND(128) != 0)))
    firsts = rows.where(F.col("mate_chrom") == F.col("chrom")).groupBy("qname", "chrom").agg(F.min("pos").alias("_p"), F.min_by("end1", "pos").alias("_e"))
    return rows.join(firsts, ["qname", "chrom"], "left").where(~F.coalesce(second & (F.col("_e") >= F.col("pos")) & (F.col("_p") <= F.col("pos")), F.lit(False))).drop("_p", "_e")


def _cigar(text: str) -> tuple[tuple[int, str], ...]:
    return tuple((int(n), op) for n, op in CIGAR.findall(text))


def _md(text: str) -> tuple[tuple[tuple[int, str], ...], tuple[str, ...]]:
    """The places, among the matched bases, and letters of mismatches, and the deleted stretches."""
    differs, deleted, k = [], [], 0
    for n, gone, base in MD_PART.findall(text):
        if n:
            k += int(n)
        elif gone:
            deleted.append(gone.upper())
        else:
            differs.append((k, base.upper()))
            k += 1
    return tuple(differs), tuple(deleted)


class Walked:
    """The matched bases of a batch of reads as arrays, one element a base, and its insertions and deletions as lists.

    The reference base of a match comes from MD, and is the read's own where MD is absent. Reads whose sequence is shorter
    than their CIGAR give what there is.
    """

    def __init__(self, batch: pa.RecordBatch):
        x = {n: batch.column(n).to_pylist() for n in ("pos", "cigar", "seq", "qual", "md")}
        seqs, quals, at_byte = [], [], 0
        owner, first, source, count, changed, letters = [], [], [], [], [], []
        self.indels: list[tuple[int, int, str, str, str, int, int]] = []  # row, position, kind, REF, ALT, quality, cycle
        nm, total = np.zeros(batch.num_rows, np.int32), 0
        cigars = {c: _cigar(c) for c in set(x["cigar"])}
        mds = {m: _md(m) for m in set(x["md"]) if m and not m.isdigit()}
        for row, (pos, cigar, seq, qual, md) in enumerate(zip(x["pos"], x["cigar"], x["seq"], x["qual"], x["md"])):
            seq = seq.upper().encode("ascii", "replace")
            q = (qual or "").encode("ascii", "replace").ljust(len(seq), b"!")[: len(seq)]
            differs, deleted = mds.get(md, ((), ()))
            at, i, k, d, last = pos, 0, 0, 0, "N"
            nm[row] = len(differs)
            for n, op in cigars[cigar]:
                if op in "M=X":
                    m = min(n, len(seq) - i)
                    if m > 0:
                        owner.append(row)
                        first.append(at)
                        source.append(at_byte + i)
                        count.append(m)
                        last = chr(seq[i + m - 1])
                        for place, base in differs:
                            if k <= place < k + m:
                                changed.append(total + place - k)
                                letters.append(ord(base))
                                if place == k + m - 1:
                                    last = base
                        total += m
                    at, i, k = at + n, i + n, k + n
                elif op == "I":
                    added = seq[i : i + n].decode()
                    if added:
                        self.indels.append((row, at - 1, "ins", last, last + added, q[i] - 33, i + 1))
                    nm[row] += n
                    i += n
                elif op == "D":
                    gone = deleted[d] if d < len(deleted) else "N" * n
                    d += 1
                    if seq:
                        self.indels.append((row, at - 1, "del", last + gone, last, q[min(i, len(q) - 1)] - 33, i))
                    nm[row] += n
                    at += n
                elif op == "N":
                    at += n
                elif op == "S":
                    i += n
            seqs.append(seq)
            quals.append(q)
            at_byte += len(seq)
        starts = np.cumsum([0, *map(len, seqs)])[:-1] if seqs else np.zeros(0, np.int64)
        n = np.array(count, dtype=np.int64)
        step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        self.row = np.repeat(np.array(owner, dtype=np.int64), n)
        self.pos = np.repeat(np.array(first, dtype=np.int64), n) + step
        at = np.repeat(np.array(source, dtype=np.int64), n) + step
        self.alt = np.frombuffer(b"".join(seqs), dtype=np.uint8)[at] if total else np.zeros(0, np.uint8)
        self.ref = self.alt.copy()
        self.ref[np.array(changed, dtype=np.int64)] = np.array(letters, dtype=np.uint8)
        self.qual = np.frombuffer(b"".join(quals), dtype=np.uint8)[at].astype(np.int32) - 33 if total else np.zeros(0, np.int32)
        self.cycle = (at - starts[self.row] + 1).astype(np.int32) if total else np.zeros(0, np.int32)
        self.nm = nm
        self.strand = (batch.column("flag").to_numpy(zero_copy_only=False).astype(np.int32) >> 4) & 1


LETTERS = pa.array([chr(i) for i in range(256)], pa.string())
READ = ("chrom", "pos", "cigar", "seq", "qual", "md", "flag", "mapq")


def events(reads: DataFrame, baseq: int = 0) -> DataFrame:
    """One row for each base, insertion and deletion of each read; strand is 1 for reverse reads, nm the read's mismatches
    and inserted and deleted bases. Bases of a lower quality than baseq are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Walked(batch)
            good = np.flatnonzero(w.qual >= baseq) if baseq else np.arange(len(w.row))
            rows, d = np.concatenate([w.row[good], np.array([e[0] for e in w.indels], np.int64)]), w.indels
            text = lambda codes, i: pa.concat_arrays([LETTERS.take(pa.array(codes[good].astype(np.int32))), pa.array([e[i] for e in d], pa.string())])
            ints = lambda own, i: pa.array(np.concatenate([own[good], np.array([e[i] for e in d], np.int64)]).astype(np.int32))
            kind = pa.concat_arrays([pa.repeat("base", len(good)), pa.array([e[2] for e in d], pa.string())])
            chrom, mapq = (batch.column(c).take(pa.array(rows)) for c in ("chrom", "mapq"))
            yield pa.RecordBatch.from_arrays(
                [chrom, ints(w.pos, 1), kind, text(w.ref, 3), text(w.alt, 4), pa.array(w.strand[rows]), ints(w.qual, 5), mapq, ints(w.cycle, 6), pa.array(w.nm[rows])],
                ["chrom", "pos", "kind", "ref", "alt", "strand", "baseq", "mapq", "cycle", "nm"],
            )

    return reads.select(*READ).mapInArrow(run, EVENTS)


SUMS = "chrom string, pos int, kind string, ref string, alt string, strand int, c long, bq long, good double, half double"


def event_sums(reads: DataFrame, baseq: int = 0) -> DataFrame:
    """chrom, pos, kind, ref, alt, strand, c, bq, good, half: partial sums of events, one row for each group of a batch.

    c counts the events, bq sums their base qualities, good and half are the sums of log10(1 - e) and log10(1/2 - e/3) for
    the error e of the quality. What leaves Python are a batch's sums, not its bases; sums of all batches follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Walked(batch)
            chrom = batch.column("chrom").dictionary_encode()
            code = chrom.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            names = [None, *chrom.dictionary.to_pylist()]
            keep = w.qual >= baseq
            row, q = w.row[keep], w.qual[keep]
            # contig and strand in the high part of a key, position and letters in the low one
            place = (w.pos[keep] << 16) | (w.ref[keep].astype(np.int64) << 8) | w.alt[keep]
            owner = code[row] * 2 + w.strand[row]
            order = np.lexsort((place, owner))
            place, owner, q = place[order], owner[order], q[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(owner) != 0)])) if len(place) else np.zeros(0, np.int64)
            e = 10.0 ** (-q / 10)
            total = lambda v: np.add.reduceat(v, first) if len(first) else np.zeros(0, v.dtype)
            c, bq = total(np.ones(len(q), np.int64)), total(q.astype(np.int64))
            good, half = total(np.log10(np.maximum(1 - e, 1e-300))), total(np.log10(np.maximum(0.5 - e / 3, 1e-300)))
            place, owner, d = place[first], owner[first], w.indels
            letters = lambda codes, i: pa.concat_arrays([LETTERS.take(pa.array((codes & 255).astype(np.int32))), pa.array([x[i] for x in d], pa.string())])
            rows = np.array([x[0] for x in d], np.int64)
            longs = lambda v, own: pa.array(np.concatenate([v, np.array(own, v.dtype)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()).take(pa.array(np.concatenate([owner // 2, code[rows]]))), pa.array(np.concatenate([place >> 16, np.array([x[1] for x in d], np.int64)]).astype(np.int32)),
                    pa.concat_arrays([pa.repeat("base", len(first)), pa.array([x[2] for x in d], pa.string())]), letters(place >> 8, 3), letters(place, 4),
                    pa.array(np.concatenate([owner % 2, w.strand[rows]]).astype(np.int32)), longs(c, [1] * len(d)), longs(bq, [x[5] for x in d]), longs(good, [0.0] * len(d)), longs(half, [0.0] * len(d)),
                ],
                ["chrom", "pos", "kind", "ref", "alt", "strand", "c", "bq", "good", "half"],
            )

    return reads.select(*READ).mapInArrow(run, SUMS)


def pileup(reads: DataFrame, baseq: int = MIN_BASEQ) -> DataFrame:
    """chrom, pos, depth, a, c, g, t, n_ins, n_del, n_reverse: counts at every covered position."""
    e = event_sums(reads, baseq)
    base = F.col("kind") == "base"
    count = lambda which: F.sum(F.when(which, F.col("c")).otherwise(0))
    return e.groupBy("chrom", "pos").agg(count(base).alias("depth"), *[count(base & (F.col("alt") == b.upper())).alias(b) for b in "acgt"], count(F.col("kind") == "ins").alias("n_ins"), count(F.col("kind") == "del").alias("n_del"), count(base & (F.col("strand") == 1)).alias("n_reverse"))


def snp_score(ref_quals: list[int], alt_quals: list[int]) -> float:
    """-10 log10 of the likelihood ratio of no variant and a variant, at least 0."""
    right = lambda q: math.log10(max(1 - 10 ** (-q / 10), 1e-300))
    rr = sum(map(right, ref_quals)) - sum(alt_quals) / 10
    ra = math.log10(0.5) * (len(ref_quals) + len(alt_quals))
    aa = sum(map(right, alt_quals)) - sum(ref_quals) / 10
    variant = log10_sum(math.log10(HET_SHARE * THETA) + ra, math.log10(HOM_SHARE * THETA) + aa)
    return max(0.0, -10 * (rr - log10_sum(math.log10(1 - THETA) + rr, variant)))


def indel_score(evidence: int, reads: int) -> float:
    """The same of an indel with evidence in so many of the reads, an error counting as one in a thousand."""
    good, bad = math.log10(0.999), math.log10(0.001)
    rr = (reads - evidence) * good + evidence * bad
    ra = reads * math.log10(0.5)
    aa = evidence * good + (reads - evidence) * bad
    variant = log10_sum(math.log10(HET_SHARE * THETA) + ra, math.log10(HOM_SHARE * THETA) + aa)
    return max(0.0, -10 * (rr - log10_sum(math.log10(1 - THETA) + rr, variant)))


def _score(rr: Column, ra: Column, aa: Column) -> Column:
    """Column form of the two scores, from the log10 likelihoods of the three genotypes."""
    terms = F.array(F.lit(math.log10(1 - THETA)) + rr, F.lit(math.log10(HET_SHARE * THETA)) + ra, F.lit(math.log10(HOM_SHARE * THETA)) + aa)
    top = F.array_max(terms)
    both = top + F.log10(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.pow(F.lit(10.0), t - top)))
    return F.greatest(F.lit(0.0), -10 * (rr - both))


def discover(reads: DataFrame, baseq: int = MIN_BASEQ, evidence: int = 2, fraction: float = 0.0, min_qual: float = 0.0) -> DataFrame:
    """chrom, pos, ref, alt, kind, e (reads with the allele), n (reads at the place), qual: candidates of usable reads.

    One row an alternative base, insertion and deletion; alleles with other letters than A, C, G, T are left out. The
    scores are functions of sums: counts and two sums of log errors an allele, taken over batches, then over all; no
    qualities are gathered, and the reference's sums reach a place's few alleles as numbers.
    """
    one = event_sums(reads, baseq).groupBy("chrom", "pos", "kind", "ref", "alt").agg(F.sum("c").alias("e"), F.sum("good").alias("good"), F.sum("bq").alias("bq"))
    # Reads whose reference base is unknown stand for one of their own: an allele is held against reads of its REF.
    place, letter = Window.partitionBy("chrom", "pos"), Window.partitionBy("chrom", "pos", F.substr("ref", F.lit(1), F.lit(1)))
    same = (F.col("kind") == "base") & (F.col("ref") == F.col("alt"))
    of_ref = lambda c: F.coalesce(F.max(F.when(same, F.col(c))).over(letter), F.lit(0))
    placed = one.withColumns({"n": F.sum(F.when(F.col("kind") == "base", F.col("e"))).over(place), "re": of_ref("e"), "rg": of_ref("good"), "rb": of_ref("bq")})
    alts = placed.where((F.col("ref") != F.col("alt")) & F.col("alt").rlike("^[ACGT]+$") & F.col("ref").rlike("^[ACGT]+$"))
    n, e = F.coalesce("n", "e"), F.col("e")
    depth, snp = F.greatest(n, e), F.col("kind") == "base"
    good, bad = math.log10(0.999), math.log10(0.001)
    rr = F.when(snp, F.col("rg") - F.col("bq") / 10).otherwise((depth - e) * good + e * bad)
    ra = F.when(snp, F.col("re") + e).otherwise(depth) * math.log10(0.5)
    aa = F.when(snp, F.col("good") - F.col("rb") / 10).otherwise(e * good + (depth - e) * bad)
    out = alts.withColumn("qual", F.round(_score(rr, ra, aa), 4))
    return out.where((e >= evidence) & (e >= fraction * n) & (F.col("qual") >= min_qual)).select("chrom", "pos", "ref", "alt", "kind", "e", n.alias("n"), "qual")


def _called(counted: DataFrame, likelihoods: Column, alleles: Column) -> DataFrame:
    """gt and pl from the log10 likelihoods of the genotypes, in the order of a G-ordered list; 0/0 and no pl where no read
    has an ALT. counted has ad, the reads of each allele."""
    raw = F.transform(likelihoods, lambda v: -10 * v)
    pl = F.transform(raw, lambda v: F.round(v - F.array_min(raw)).cast("int"))
    n = F.size(alleles)
    names = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.transform(F.sequence(F.lit(0), j), lambda i: F.concat_ws("/", i, j))))
    seen = F.exists(F.slice("ad", 2, n), lambda x: x > 0)
    return counted.withColumn("pl", F.when(seen, pl)).withColumn("gt", F.when(~seen, "0/0").otherwise(F.element_at(names, F.array_position(pl, F.lit(0)).cast("int"))))


def _genotypes(alleles: Column, value) -> Column:
    """value(i, j) for the genotypes i/j of the alleles, in the order of a G-ordered list."""
    last = F.size(alleles) - 1
    return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda j: F.transform(F.sequence(F.lit(0), j), lambda i: value(i, j))))


def genotype_snps(reads: DataFrame, sites: DataFrame, baseq: int = 1) -> DataFrame:
    """chrom, pos, ref, alts, dp, ad, adf, adr, bqsum, pl, gt of known SNP sites with one or more ALTs.

    Likelihoods are sums over the reads that cover a site, the least taken off: of a genotype of one allele log10(1 - e)
    for its bases and log10(e / 3) for others, of two alleles log10(1/2 - e/3) for either's bases. pl is G-ordered, null
    where no read differs from REF, then gt is 0/0. Bases that are no allele of the site, and those of quality 0, don't
    count; sites no read covers are left out. A site has the sums of at most eight bases and strands, however deep.
    """
    e = event_sums(reads, baseq).where("kind = 'base'").groupBy("chrom", "pos", F.col("alt").alias("base"), "strand").agg(*[F.sum(c).alias(c) for c in ("c", "bq", "good", "half")])
    alleles = F.concat(F.array("ref"), F.col("alts"))
    wanted = sites.select("chrom", "pos", "ref", "alts", F.posexplode(alleles).alias("i", "base"))
    x = wanted.join(e, ["chrom", "pos", "base"]).withColumn("third", -F.col("bq") / 10 - F.col("c") * math.log10(3))
    held = F.struct("i", "strand", "c", "bq", "good", "half", "third")
    g = x.groupBy("chrom", "pos", "ref", "alts").agg(F.collect_list(held).alias("x"))
    total = lambda what, where: F.aggregate(F.filter("x", where), F.lit(0.0), lambda acc, r: acc + what(r))
    depth = lambda where: F.transform(F.sequence(F.lit(0), F.size("alts")), lambda a: total(lambda r: r["c"], lambda r: (r["i"] == a) & where(r)).cast("int"))
    one = lambda i: total(lambda r: F.when(r["i"] == i, r["good"]).otherwise(r["third"]), lambda r: F.lit(True))
    two = lambda i, j: total(lambda r: F.when((r["i"] == i) | (r["i"] == j), r["half"]).otherwise(r["third"]), lambda r: F.lit(True))
    counted = g.withColumns({"ad": depth(lambda r: F.lit(True)), "adf": depth(lambda r: r["strand"] == 0), "adr": depth(lambda r: r["strand"] == 1), "dp": total(lambda r: r["c"], lambda r: F.lit(True)).cast("int"), "bqsum": total(lambda r: r["bq"], lambda r: F.lit(True)).cast("long")})
    called = _called(counted, _genotypes(alleles, lambda i, j: F.when(i == j, one(i)).otherwise(two(i, j))), alleles)
    return called.select("chrom", "pos", "ref", "alts", "dp", "ad", "adf", "adr", "bqsum", "pl", "gt")


SPANS = "chrom string, beg1 int, end1 int, strand int, indels array<struct<pos:int,ref:string,alt:string>>, c long"

# How much less likely, in log10, a read is under another allele than its own, and one half.
OTHER, HALF = -1.0, -0.30103


def read_spans(reads: DataFrame) -> DataFrame:
    """chrom, beg1, end1, strand, indels, c: the places of reads with their insertions and deletions, anchored, and how
    many reads are alike in all of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Walked(batch)
            mine: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, pos, _, ref, alt, _, _ in w.indels:
                mine[row].append({"pos": pos, "ref": ref, "alt": alt})
            pos = batch.column("pos").to_pylist()
            end = [p - 1 + sum(n for n, op in _cigar(c) if op in "MDN=X") for p, c in zip(pos, batch.column("cigar").to_pylist())]
            kind = pa.list_(pa.struct([("pos", pa.int32()), ("ref", pa.string()), ("alt", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("chrom"), pa.array(pos, pa.int32()), pa.array(end, pa.int32()), pa.array(w.strand.astype(np.int32)), pa.array(mine, kind)], ["chrom", "beg1", "end1", "strand", "indels"])

    return reads.select(*READ).mapInArrow(run, SPANS.removesuffix(", c long")).groupBy("chrom", "beg1", "end1", "strand", "indels").agg(F.count("*").alias("c"))


def _from_counts(seen: DataFrame, keys: list[str], alleles: Column) -> DataFrame:
    """Genotypes of sites from the reads of each allele: seen has the keys, allele (null for none of the site's), strand, c."""
    n = F.size(alleles)
    per = seen.where("allele is not null").groupBy(*keys, "allele", "strand").agg(F.sum("c").alias("c")).groupBy(*keys).agg(F.collect_list(F.struct("allele", "strand", "c")).alias("x"))
    depth = lambda where: F.transform(F.sequence(F.lit(0), n - 1), lambda a: F.aggregate(F.filter("x", lambda r: (r["allele"] == a) & where(r)), F.lit(0).cast("long"), lambda acc, r: acc + r["c"]).cast("int"))
    counted = per.withColumns({"ad": depth(lambda r: F.lit(True)), "adf": depth(lambda r: r["strand"] == 0), "adr": depth(lambda r: r["strand"] == 1)})
    weight = lambda a, i, j: F.when((i == j) & (a == i), 0.0).when((a == i) | (a == j), HALF + math.log10(1 + 10**OTHER)).otherwise(OTHER)
    likely = lambda i, j: F.aggregate(F.transform("ad", lambda c, a: c * weight(a, i, j)), F.lit(0.0), lambda acc, v: acc + v)
    called = _called(counted, _genotypes(alleles, likely), alleles)
    return called.select(*keys, F.aggregate("ad", F.lit(0), lambda acc, v: acc + v).alias("dp"), "ad", "adf", "adr", "pl", "gt")


def genotype_indels(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """chrom, pos, ref, alts, dp, ad, adf, adr, pl, gt of known indel sites (anchored by a shared first base), one or more
    ALTs, from the reads that cover REF and a base to its right.

    A read has an ALT if it has that very insertion or deletion at the site, REF if it has none there; reads with another
    one don't count. A read is one tenth as likely under an allele that isn't its own. Reads meet sites in bins of
    positions; counts are aggregated by site, allele and strand before they meet. pl and gt as in genotype_snps.
    """
    wide = sites.withColumn("_e", F.col("pos") + F.length("ref")).withColumn("_alleles", F.concat(F.array("ref"), F.col("alts")))
    met = overlap_join(wide, read_spans(reads), "chrom", "chrom", ("pos", "_e"), ("beg1", "end1")).where((F.col("r_beg1") <= F.col("pos")) & (F.col("r_end1") >= F.col("_e")))
    here = F.filter("r_indels", lambda d: d["pos"] == F.col("pos"))
    # An indel is the site's if it leaves the same bases: REF with what the read lost or gained behind its first base.
    spelt = lambda d: F.concat(F.substr("ref", F.lit(1), F.lit(1)), F.substr(d["alt"], F.lit(2), F.length(d["alt"])), F.substr("ref", F.length(d["ref"]) + 1, F.length("ref")))
    own = F.array_position("_alleles", spelt(F.get(here, F.lit(0)))) - 1
    allele = F.when(F.size(here) == 0, 0).when((F.size(here) == 1) & (own > 0), own).cast("int")
    return _from_counts(met.select("chrom", "pos", "ref", "alts", allele.alias("allele"), F.col("r_strand").alias("strand"), F.col("r_c").alias("c")), ["chrom", "pos", "ref", "alts"], F.concat(F.array("ref"), F.col("alts")))


def genotype_repeats(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """chrom, beg1, end1, lengths, dp, ad, adf, adr, pl, gt of tandem repeats, alleles told by the tract's length.

    sites has chrom, beg1, end1 and alt_lengths, the tract's other lengths in bases; lengths has the reference's first. A
    read counts if it covers the tract and a base to each side; its length is the reference's with all its insertions and
    deletions inside, wherever an aligner put them; reads of no listed length don't count.
    """
    own = F.col("end1") - F.col("beg1") + 1
    wide = sites.select("chrom", "beg1", "end1", F.concat(F.array(own.cast("int")), F.col("alt_lengths").cast("array<int>")).alias("lengths"), (F.col("beg1") - 1).alias("_b"), (F.col("end1") + 1).alias("_e"))
    met = overlap_join(wide, read_spans(reads), "chrom", "chrom", ("_b", "_e"), ("beg1", "end1")).where((F.col("r_beg1") <= F.col("_b")) & (F.col("r_end1") >= F.col("_e")))
    inside = F.filter("r_indels", lambda d: (d["pos"] >= F.col("_b")) & (d["pos"] <= F.col("end1")))
    size = own + F.aggregate(inside, F.lit(0), lambda acc, d: acc + F.length(d["alt"]) - F.length(d["ref"]))
    place = F.array_position("lengths", size.cast("int"))
    allele = F.when(place > 0, (place - 1).cast("int"))
    return _from_counts(met.select("chrom", "beg1", "end1", "lengths", allele.alias("allele"), F.col("r_strand").alias("strand"), F.col("r_c").alias("c")), ["chrom", "beg1", "end1", "lengths"], F.col("lengths"))


def site_reads(reads: DataFrame, sites: DataFrame, baseq: int = 1) -> DataFrame:
    """chrom, pos, ref, alts, bq, mq, cy, st, al, nm of SNP sites: of each read that covers the site, in the order of
    these values, base quality, mapping quality, cycle, strand (F or R), allele (-1 for none of the site's) and number of
    mismatches. A site's lists are as long as it is deep; only reads at sites are looked at."""
    e = events(reads, baseq).where("kind = 'base'").select("chrom", "pos", F.col("alt").alias("base"), "baseq", "mapq", "cycle", "strand", "nm")
    x = sites.select("chrom", "pos", "ref", "alts").join(e, ["chrom", "pos"])
    place = F.array_position(F.concat(F.array("ref"), F.col("alts")), F.col("base"))
    one = F.struct(F.col("baseq").alias("bq"), F.col("mapq").alias("mq"), F.col("cycle").alias("cy"), F.when(F.col("strand") == 1, "R").otherwise("F").alias("st"), (place - 1).cast("int").alias("al"), "nm")
    g = x.groupBy("chrom", "pos", "ref", "alts").agg(F.array_sort(F.collect_list(one)).alias("x"))
    pick = lambda c: F.transform("x", lambda r: r[c]).alias(c)
    return g.select("chrom", "pos", "ref", "alts", *[pick(c) for c in ("bq", "mq", "cy", "st", "al", "nm")])


def coverage(spans: DataFrame, key: str = "rid", beg: str = "beg1", end: str = "end1") -> DataFrame:
    """key, beg1, end1, depth: stretches of constant depth of closed intervals, from sums of begins and ends.

    Running sums are taken block by block of positions with the earlier blocks' balance as a first row, so the depth of a
    whole contig needs no task that sees all its intervals, and no interval is spelled out base by base.
    """
    valid = spans.where(F.col(key).isNotNull() & (F.col(end) >= F.col(beg)))
    at = valid.select(key, F.col(beg).cast("long").alias("p"), F.lit(1).cast("long").alias("d")).unionByName(valid.select(key, (F.col(end).cast("long") + 1).alias("p"), F.lit(-1).cast("long").alias("d")))
    steps = at.groupBy(key, "p").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("blk", F.shiftright("p", 16))
    earlier = Window.partitionBy(key).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(key).orderBy(F.col("blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = steps.groupBy(key, "blk").agg(F.sum("d").alias("d"), F.min("p").alias("first"))
    sums = blocks.select(key, "blk", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("d"), F.min("first").over(later).alias("next"))
    inside = Window.partitionBy(key, "blk").orderBy(F.col("p").asc_nulls_first())
    both = steps.select(key, "blk", "p", "d", F.lit(None).cast("long").alias("next")).unionByName(sums.select(key, "blk", F.lit(None).cast("long").alias("p"), "d", "next"))
    run = both.withColumn("depth", F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.lead("p").over(inside)).withColumn("after", F.coalesce("after", F.first("next").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    return run.where("p is not null and depth > 0 and after is not null").select(key, F.col("p").cast("int").alias("beg1"), (F.col("after") - 1).cast("int").alias("end1"), "depth")
