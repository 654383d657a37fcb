"""Columns over DNA strings: complements, canonical motifs, periods, composition and information."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from stranda.functions.alleles import let


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: Column | str) -> Column:
    return F.translate(F.reverse(_col(seq)), "ACGTacgt", "TGCAtgca")


def _rotations(seq: Column) -> Column:
    double = F.concat(seq, seq)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1))), lambda i: F.substr(double, i, F.length(seq)))


def shift(seq: Column | str, n: Column | int) -> Column:
    """The string with its first n letters moved to its end."""
    s, k = _col(seq), F.lit(n) if isinstance(n, int) else n
    k = F.pmod(k, F.greatest(F.length(s), F.lit(1)))
    return F.concat(F.substr(s, k + 1, F.length(s)), F.substr(s, F.lit(1), k))


def canonical(seq: Column | str) -> Column:
    """The least rotation; equal for all rotations of a motif."""
    return F.array_min(_rotations(_col(seq)))


def canonical_both_strands(seq: Column | str) -> Column:
    """The least rotation of the motif and of its reverse complement."""
    return F.least(canonical(seq), canonical(reverse_complement(seq)))


def smallest_unit(seq: Column | str) -> Column:
    """The shortest prefix that, repeated, gives the string; the string itself if there is none shorter."""
    s = _col(seq)
    n = F.length(s)
    fits = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (n % k == 0) & (F.repeat(F.substr(s, F.lit(1), k), (n / k).cast("int")) == s))
    return F.when(n > 0, F.substr(s, F.lit(1), F.get(fits, F.lit(0)))).otherwise(s)


def is_periodic(seq: Column | str) -> Column:
    return F.length(smallest_unit(seq)) < F.length(_col(seq))


def basis(seq: Column | str) -> Column:
    """The different letters in order: ACT of TACTA."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(_col(seq), ""))), "")


def counts(seq: Column | str) -> Column:
    """How many A, C, G and T."""
    return let(F.upper(_col(seq)), lambda s: F.array(*[F.length(s) - F.length(F.translate(s, b, "")) for b in "ACGT"]))


def _information(numbers: Column, against: float | None) -> Column:
    """Bits of the shares of some numbers, or what an even distribution has more (against: its bits); to two places."""

    def of(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0), lambda acc, x: acc + x)
        return let(total, lambda n: F.when(n > 0, shares(c, n)))

    def shares(c: Column, n: Column) -> Column:
        bits = F.aggregate(F.filter(c, lambda x: x > 0), F.lit(0.0), lambda acc, x: acc - x / n * F.log2(x / n))
        return F.abs(F.round(bits if against is None else F.lit(against) - bits, 2))

    return let(numbers, of)


def entropy(seq: Column | str) -> Column:
    """Bits of information of a base, to two places; null for a string without bases."""
    return _information(counts(seq), None)


def divergence(seq: Column | str) -> Column:
    """Kullback-Leibler divergence of the base composition from an even one, to two places."""
    return _information(counts(seq), 2.0)


def pair_counts(seq: Column | str) -> Column:
    """How many of each of the 16 pairs of neighbouring bases, in the order AA, AC, ..., TT."""

    def of(s: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2))), tally)

    def tally(pairs: Column) -> Column:
        count = lambda ab: F.size(F.filter(pairs, lambda p: p == ab))
        return F.array(*[count(a + b) for a in "ACGT" for b in "ACGT"])

    return let(F.upper(_col(seq)), of)


def pair_entropy(seq: Column | str) -> Column:
    """Bits of information of a pair of neighbouring bases, to two places."""
    return _information(pair_counts(seq), None)


def exact_purity(tract: Column | str, unit: Column | str) -> Column:
    """Share of the tract's bases that an endless repetition of the unit from its start would have."""
    t, u = F.upper(_col(tract)), F.upper(_col(unit))
    n = F.length(t)
    endless = F.substr(F.repeat(u, (n / F.greatest(F.length(u), F.lit(1))).cast("int") + 1), F.lit(1), n)
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(t, i, F.lit(1)) == F.substr(endless, i, F.lit(1))))
    return F.when((n > 0) & (F.length(u) > 0), F.round(same / n, 4))


def register(spark: SparkSession) -> None:
    """The functions under SQL names, as SQL functions that the optimizer inlines."""
    from stranda.functions.sql import DEFINITIONS

    for statement in DEFINITIONS:
        spark.sql(statement)
