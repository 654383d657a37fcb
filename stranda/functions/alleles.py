"""Columns over a record's alleles: classification, keys, normal form, genotype indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits of a variant's type, and their names in the order they are written.
REF, SNP, MNP, INDEL, CLUMPED, VNTR, SV = 0, 1, 2, 4, 8, 16, 32
TYPE_NAMES = {SNP: "SNP", MNP: "MNP", INDEL: "INDEL", CLUMPED: "CLUMPED", VNTR: "VNTR", SV: "SV"}


def _shared(n: Column, same) -> Column:
    """The largest i in 0..n-1 for which same(i), which holds up to some i and for none beyond it: found by halving steps."""
    steps = F.transform(F.sequence(F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda acc, step: F.when((acc + step < n) & same(acc + step), acc + step).otherwise(acc))


def right_trim(a: Column, b: Column) -> Column:
    """How many last bases two alleles share, one base of the shorter kept."""
    return _shared(F.least(F.length(a), F.length(b)), lambda i: F.right(a, i) == F.right(b, i))


def left_trim(a: Column, b: Column, cut: Column) -> Column:
    """How many first bases two alleles share once cut bases are off their right, one base of the shorter kept."""
    return _shared(F.least(F.length(a), F.length(b)) - cut, lambda i: F.left(a, i) == F.left(b, i))


def is_symbolic(alt: Column) -> Column:
    return F.contains(alt, F.lit("<"))


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _allele(ref: Column, alt: Column) -> Column:
    """Type, diff, alen, dlen, mlen, ts, tv of one ALT against REF, after both are trimmed."""

    def trimmed(cut: Column) -> Column:
        return let(left_trim(ref, alt, cut), lambda skip: parts(cut, skip))

    def parts(cut: Column, skip: Column) -> Column:
        short = lambda s: F.substr(s, skip + 1, F.length(s) - cut - skip)
        return let(F.struct(short(ref).alias("r"), short(alt).alias("a")), compared)

    def compared(p: Column) -> Column:
        r, a = p["r"], p["a"]
        rl, al = F.length(r), F.length(a)
        lone, long_ = F.when(rl > al, a).otherwise(r), F.when(rl > al, r).otherwise(a)
        first, last = F.substr(long_, F.lit(1), F.lit(1)), F.substr(long_, F.length(long_), F.lit(1))
        base = lambda s, i: F.substr(s, i, F.lit(1))
        off = F.transform(F.filter(F.sequence(F.lit(1), F.least(rl, al)), lambda i: base(r, i) != base(a, i)), lambda i: F.concat(base(r, i), base(a, i)))
        ends = F.when((first != lone) & (last != lone), F.array(F.concat(first, lone))).otherwise(F.array().cast("array<string>"))
        mlen, dlen = F.least(rl, al), al - rl
        differing = F.when((mlen == 1) & (dlen != 0), ends).otherwise(off)
        measures = F.struct(mlen.alias("mlen"), dlen.alias("dlen"), F.size(differing).alias("diff"), F.size(F.filter(differing, lambda x: x.isin("AG", "GA", "CT", "TC"))).alias("ts"))
        return let(measures, named)

    def named(m: Column) -> Column:
        mlen, dlen, diff, ts = m["mlen"], m["dlen"], m["diff"], m["ts"]
        kind = (
            F.when(mlen == diff, F.when(mlen == 1, SNP).otherwise(MNP)).otherwise(0)
            .bitwiseOR(F.when(dlen != 0, INDEL).otherwise(0))
            .bitwiseOR(F.when((diff > 0) & (diff < mlen), CLUMPED).otherwise(0))
        )
        return F.struct(kind.alias("type"), diff.alias("diff"), F.length(alt).alias("alen"), dlen.alias("dlen"), mlen.alias("mlen"), ts.alias("ts"), (diff - ts).alias("tv"), F.lit(None).cast("string").alias("sv_type"))

    # Nothing can be trimmed off an allele of one base, and two of one base differ in it: the usual cases need no search.
    whole = F.struct(ref.alias("r"), alt.alias("a"))
    zero, one = F.lit(0), F.lit(1)
    is_ts = F.concat(ref, alt).isin("AG", "GA", "CT", "TC").cast("int")
    snp = F.struct(F.lit(SNP).alias("type"), one.alias("diff"), one.alias("alen"), zero.alias("dlen"), one.alias("mlen"), is_ts.alias("ts"), (1 - is_ts).alias("tv"), F.lit(None).cast("string").alias("sv_type"))
    short = F.least(F.length(ref), F.length(alt)) == 1
    return F.when(short & (F.length(ref) == F.length(alt)), snp).when(short, let(whole, compared)).otherwise(let(right_trim(ref, alt), trimmed))


def _named(alt: Column, kind: int, name: Column) -> Column:
    zero = F.lit(0)
    return F.struct(F.lit(kind).alias("type"), zero.alias("diff"), zero.alias("alen"), zero.alias("dlen"), zero.alias("mlen"), zero.alias("ts"), zero.alias("tv"), name.alias("sv_type"))


def alleles(ref: Column, alts: Column) -> Column:
    """One struct for each ALT that is neither REF itself nor `.`.

    A symbolic ALT is a VNTR if it is <STR>, <ST and a digit..> or <VN and more than digits..>, else an SV; one with a
    breakend bracket is the SV <BND>. Null alts have no alleles.
    """
    vntr = lambda a: a.rlike(r"^<VN[^>]*[^0-9>]") | (a == "<STR>") | a.rlike(r"^<ST[0-9]")
    reduced = lambda a: F.when(a.rlike(r"^<CN[0-9]+>$"), F.lit("<CNV>")).when(a.rlike(r"^<VN[0-9]+>$"), F.lit("<VNTR>")).otherwise(a)
    kept = F.filter(F.coalesce(alts, F.array().cast("array<string>")), lambda a: a.isNotNull() & ~a.startswith(".") & (a != ref))
    return F.transform(
        kept,
        lambda a: F.when(is_symbolic(a) & vntr(a), _named(a, VNTR, a))
        .when(is_symbolic(a), _named(a, SV, reduced(a)))
        .when(F.contains(a, F.lit("[")) | F.contains(a, F.lit("]")), _named(a, SV, F.lit("<BND>")))
        .otherwise(_allele(ref, a)),
    )


def variant_type(ref: Column, alts: Column, classes: Column) -> Column:
    """The record's type: its alleles' types together, and MNP if all alleles have REF's length of two or more."""
    together = F.aggregate(classes, F.lit(0), lambda acc, x: acc.bitwiseOR(x["type"]))
    even = F.forall(alts, lambda a: is_symbolic(a) | (F.length(a) == F.length(ref))) & (F.length(ref) > 1)
    return let(together, lambda t: F.when((t.bitwiseAND(VNTR | SV) == 0) & (t != REF) & even, t.bitwiseOR(MNP)).otherwise(t))


def classified(df, ref: str = "ref", alts: str = "alts"):
    """df with alleles, vtype, ts, tv, ins, del, max_dlen, min_dlen and contains_n; ins and del count alleles."""
    r, a = F.col(ref), F.col(alts)
    out = df.withColumn("alleles", alleles(r, a))
    c = F.col("alleles")
    total = lambda what: F.aggregate(c, F.lit(0), lambda acc, x: acc + what(x))
    return (
        out.withColumn("vtype", variant_type(r, F.coalesce(a, F.array().cast("array<string>")), c))
        .withColumn("ts", total(lambda x: x["ts"]))
        .withColumn("tv", total(lambda x: x["tv"]))
        .withColumn("ins", total(lambda x: (x["dlen"] > 0).cast("int")))
        .withColumn("del", total(lambda x: (x["dlen"] < 0).cast("int")))
        .withColumn("max_dlen", F.coalesce(F.array_max(F.transform(c, lambda x: x["dlen"])), F.lit(0)))
        .withColumn("min_dlen", F.coalesce(F.array_min(F.transform(c, lambda x: x["dlen"])), F.lit(0)))
        .withColumn("contains_n", F.contains(r, F.lit("N")) | F.exists(F.coalesce(a, F.array().cast("array<string>")), lambda x: ~is_symbolic(x) & F.contains(x, F.lit("N"))))
    )


def has_indel(ref: Column, alts: Column) -> Column:
    """Whether the INDEL bit of the record's type is set, from the lengths alone: an explicit ALT of another length."""
    explicit = lambda a: a.isNotNull() & ~is_symbolic(a) & ~F.contains(a, F.lit("[")) & ~F.contains(a, F.lit("]")) & ~a.startswith(".")
    return F.exists(F.coalesce(alts, F.array().cast("array<string>")), lambda a: explicit(a) & (F.length(a) != F.length(ref)))


CLASSES = ("alleles", "vtype", "ts", "tv", "ins", "del", "max_dlen", "min_dlen", "contains_n")


def classified_once(df, columns: tuple[str, ...] = CLASSES):
    """classified, each different pair of REF and ALTs worked out once and joined to the records; Spark broadcasts the
    pairs where their size allows. For tables that hold many more records than pairs of alleles."""
    key = F.concat_ws("\x1f", F.concat(F.array(F.coalesce("ref", F.lit("\x00"))), F.coalesce("alts", F.array(F.lit("\x00")))))
    # Alleles come out of the aggregation, not of its key, so that no filter on a class is worked out for each record.
    pairs = df.groupBy(key.alias("_alleles")).agg(F.first("ref").alias("ref"), F.first("alts").alias("alts"))
    pairs = classified(pairs).select("_alleles", *columns)
    return df.withColumn("_alleles", key).join(pairs, "_alleles", "left").drop("_alleles")


def type_name(vtype: Column) -> Column:
    """SNP/INDEL and so on; REF for 0."""
    return F.when(vtype == 0, F.lit("REF")).otherwise(F.concat_ws("/", *[F.when(vtype.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in TYPE_NAMES.items()]))


def variant_key(chrom: Column, pos: Column, ref: Column, alts: Column) -> Column:
    return F.concat(chrom, F.lit(":"), pos.cast("string"), F.lit(":"), F.concat_ws("/", F.concat(F.array(ref), alts)))


def allele_key(ref: Column, alts: Column) -> Column:
    """REF and the ALTs in byte order: equal for records that differ in the order of their ALTs alone."""
    return F.concat_ws(",", F.concat(F.array(ref), F.array_sort(alts)))


def is_normalized(ref: Column, alts: Column) -> Column:
    """No last base that all alleles share, and no shared first base unless an allele has but one base."""
    last = lambda s: F.substr(s, F.length(s), F.lit(1))
    first = lambda s: F.substr(s, F.lit(1), F.lit(1))
    same_last = F.forall(alts, lambda a: last(a) == last(ref))
    same_first = F.forall(alts, lambda a: first(a) == first(ref))
    longer = (F.length(ref) > 1) & F.forall(alts, lambda a: F.length(a) > 1)
    return ~same_last & ~(longer & same_first)


def genotype_index(i: Column, j: Column) -> Column:
    """Place of the unordered genotype i/j in a G-ordered list."""
    a, b = F.least(i, j), F.greatest(i, j)
    return (b * (b + 1) / 2).cast("int") + a


def genotype_count(n_allele: Column, ploidy: int = 2) -> Column:
    """How many genotypes there are of n alleles."""
    out = F.lit(1).cast("long")
    for k in range(ploidy):
        out = out * (n_allele + k)
    for k in range(2, ploidy + 1):
        out = (out / k).cast("long")
    return out.cast("int")
