"""Records and regions of a contig that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stranda.functions import alleles as A
from stranda.functions import sequences as S
from stranda.operators.intervals import overlap_flags, overlap_join, with_cluster


def with_end(df: DataFrame) -> DataFrame:
    """df with end1, the last base of REF."""
    return df.withColumn("end1", F.col("pos") + F.length("ref") - 1)


def select_regions(df: DataFrame, regions: DataFrame, left: int = 0, right: int = 0, inverse: bool = False) -> DataFrame:
    """The records that overlap a region of rid, beg1, end1 widened by left and right bases, or with inverse the others."""
    wide = regions.select("rid", (F.col("beg1") - left).alias("beg1"), (F.col("end1") + right).alias("end1"))
    rows = with_end(df) if "end1" not in df.columns else df
    out = overlap_join(rows, wide, "rid", "rid", ("pos", "end1"), ("beg1", "end1"), how="left_anti" if inverse else "left_semi")
    return out.select(*df.columns)


def annotate_regions(df: DataFrame, regions: DataFrame, tag: str, left: int = 0, right: int = 0) -> DataFrame:
    """df with the flags tag (overlaps a region), tag_left and tag_right (overlaps only what a region is widened by).
    Null or reversed regions have neither an inside nor margins."""
    areas = {tag: (F.col("beg1"), F.col("end1"))}
    if left:
        areas[f"{tag}_left"] = (F.col("beg1") - left, F.col("beg1") - 1)
    if right:
        areas[f"{tag}_right"] = (F.col("end1") + 1, F.col("end1") + right)
    every = F.array(*[F.struct(F.lit(name).alias("flag"), b.alias("b"), e.alias("e")) for name, (b, e) in areas.items()])
    spread = regions.where("end1 >= beg1").select("rid", F.explode(every).alias("a")).select("rid", "a.*")
    return overlap_flags(df.withColumn("_end1", F.col("pos") + F.length("ref") - 1), "rid", ("pos", "_end1"), spread, list(areas)).drop("_end1")


def first_of_overlaps(df: DataFrame, order: str, window: int = 0) -> DataFrame:
    """The first record of each cluster of overlapping records, filters `overlap` where the cluster has more than one,
    n_cluster. window widens each record to its right."""
    rows = with_end(df)
    clustered = with_cluster(rows, "rid", "pos", "end1", slack=window)
    place = F.struct("pos", order)
    g = clustered.groupBy("rid", "cluster_beg").agg(F.min_by(F.struct(*df.columns), place).alias("r"), F.count("*").alias("n_cluster"))
    return g.select("r.*", F.when(F.col("n_cluster") > 1, "overlap").alias("overlap_filter"), "n_cluster")


def merge_overlapping(df: DataFrame, window: int = 0) -> DataFrame:
    """One multi-allelic record for each cluster of two or more overlapping biallelic explicit records.

    rid, pos, ref, alts, constituents: ref spans the cluster, put together from the members' REFs, each ALT is the span
    with one member's ALT in its member's place; bases that all alleles share on the left are trimmed. A cluster whose
    REFs disagree or leave a hole (possible with a window) has null ref and alts.
    """
    explicit = df.where((F.size("alts") == 1) & ~A.is_symbolic(F.get("alts", F.lit(0))))
    clustered = with_cluster(with_end(explicit), "rid", "pos", "end1", slack=window)
    g = clustered.groupBy("rid", "cluster_beg", "cluster_end").agg(F.array_sort(F.collect_set(F.struct("pos", "ref", F.get("alts", F.lit(0)).alias("alt")))).alias("m")).where(F.size("m") > 1)
    # The span grows member by member: what a member's REF has beyond the span so far is appended.
    beg = F.col("cluster_beg")
    start = F.struct(F.lit("").alias("s"), F.lit(True).alias("ok"))
    grown = F.aggregate(
        "m",
        start,
        lambda acc, x: F.struct(
            F.concat(acc["s"], F.substr(x["ref"], F.greatest(F.length(acc["s"]) - (x["pos"] - beg) + 1, F.lit(1)), F.length(x["ref"]))).alias("s"),
            (acc["ok"] & (x["pos"] - beg <= F.length(acc["s"])) & (F.substr(acc["s"], x["pos"] - beg + 1, F.length(x["ref"])) == F.substr(x["ref"], F.lit(1), F.least(F.length(x["ref"]), F.greatest(F.length(acc["s"]) - (x["pos"] - beg), F.lit(0)))))).alias("ok"),
        ),
    )
    out = g.withColumn("_g", grown).withColumn("_ref", F.when(F.col("_g.ok"), F.col("_g.s")))
    put = lambda x: F.concat(F.substr("_ref", F.lit(1), x["pos"] - beg), x["alt"], F.substr("_ref", x["pos"] - beg + F.length(x["ref"]) + 1, F.length("_ref")))
    out = out.withColumn("_alts", F.array_distinct(F.transform("m", put)))
    shared = F.array_min(F.transform("_alts", lambda a: A.left_trim(F.col("_ref"), a, F.lit(0))))
    out = out.withColumn("_cut", F.coalesce(shared, F.lit(0)))
    rest = lambda s: F.substr(s, F.col("_cut") + 1, F.length(s))
    names = F.transform("m", lambda x: F.concat_ws("/", F.concat_ws(":", F.col("rid").cast("string"), x["pos"].cast("string"), x["ref"]), x["alt"]))
    return out.select("rid", (beg + F.col("_cut")).cast("int").alias("pos"), rest(F.col("_ref")).alias("ref"), F.when(F.col("_ref").isNotNull(), F.transform("_alts", rest)).alias("alts"), F.array_join(names, ",").alias("constituents"))


COUNT_BITS = 16


def overlap_counts(df: DataFrame, kinds: dict[str, Column], key: str, beg: str, end: str, block_bits: int = COUNT_BITS) -> DataFrame:
    """key, beg, end and a column for each kind: of each different valid interval, how many rows of that kind overlap it,
    rows with that very interval counted in.

    No pairs are made: what overlaps an interval are the rows that begin up to its end less those that end before its
    begin. Running numbers of both stand at every place where one begins or ends, taken block by block of positions with
    the earlier blocks' sums as a first row, and intervals look up the two places that are their own.
    """
    valid = df.where(F.col(key).isNotNull() & (F.col(end) >= F.col(beg)))
    names = [f"_n{i}" for i in range(len(kinds))]
    spans = valid.groupBy(F.col(key).alias("_k"), F.col(beg).cast("long").alias("_b"), F.col(end).cast("long").alias("_e")).agg(*[F.sum(c.cast("long")).alias(n) for c, n in zip(kinds.values(), names)])
    sides = F.explode(F.array(F.struct(F.col("_b").alias("_p"), *[F.col(n).alias(f"_s{n}") for n in names], *[F.lit(0).cast("long").alias(f"_f{n}") for n in names]), F.struct((F.col("_e") + 1).alias("_p"), *[F.lit(0).cast("long").alias(f"_s{n}") for n in names], *[F.col(n).alias(f"_f{n}") for n in names])))
    sums = [f"{x}{n}" for x in ("_s", "_f") for n in names]
    steps = spans.select("_k", sides.alias("_x")).select("_k", "_x.*").groupBy("_k", "_p").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("_blk", F.shiftright("_p", block_bits))
    earlier = Window.partitionBy("_k").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = steps.groupBy("_k", "_blk").agg(*[F.sum(c).alias(c) for c in sums]).select("_k", F.lit(None).cast("long").alias("_p"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums], "_blk")
    inside = Window.partitionBy("_k", "_blk").orderBy(F.col("_p").asc_nulls_first())
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    running = steps.unionByName(carry).select("_k", "_p", *[(F.sum(f"_s{n}").over(upto) - F.col(f"_s{n}")).alias(f"_s{n}") for n in names], *[F.sum(f"_f{n}").over(upto).alias(f"_f{n}") for n in names]).where("_p is not null")
    # Begun before the base after the end, less ended before the begin.
    begun = running.select("_k", (F.col("_p") - 1).alias("_e"), *[f"_s{n}" for n in names])
    ended = running.select("_k", F.col("_p").alias("_b"), *[f"_f{n}" for n in names])
    out = spans.select("_k", "_b", "_e").join(begun, ["_k", "_e"]).join(ended, ["_k", "_b"])
    return out.select(F.col("_k").alias(key), F.col("_b").alias(beg), F.col("_e").alias(end), *[(F.col(f"_s{n}") - F.col(f"_f{n}")).alias(k) for k, n in zip(kinds, names)])


def overlap_filters(df: DataFrame) -> DataFrame:
    """df (classified) with overlaps, the numbers of other SNPs, indels and VNTRs that overlap the record, and filters
    overlap_snp, overlap_indel, overlap_vntr for those that aren't 0. A record delivered twice overlaps its repetition."""
    kinds = {"snp": A.SNP, "indel": A.INDEL, "vntr": A.VNTR}
    rows = df.withColumn("_k", F.col("rid")).withColumn("_b", F.col("pos").cast("long")).withColumn("_e", (F.col("pos") + F.length("ref") - 1).cast("long"))
    is_kind = {k: F.col("vtype").bitwiseAND(bit) != 0 for k, bit in kinds.items()}
    out = rows.join(overlap_counts(rows, {f"_{k}": c for k, c in is_kind.items()}, "_k", "_b", "_e"), ["_k", "_b", "_e"], "left")
    count = lambda k: F.coalesce((F.col(f"_{k}") - is_kind[k].cast("int")).cast("int"), F.lit(0))
    tags = F.array_compact(F.array(*[F.when(count(k) > 0, F.lit(f"overlap_{k}")) for k in kinds]))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.array(*[count(k) for k in kinds]).alias("overlaps"), tags.alias("filters"))


def multiallelic_snps(df: DataFrame) -> DataFrame:
    """rid, pos, ref, alts: one record for each place with two or more different SNPs, ALTs in byte order, from the
    biallelic records."""
    alt = F.get("alts", F.lit(0))
    snps = df.where((F.size("alts") == 1) & (F.length("ref") == 1) & (F.length(alt) == 1) & (alt != F.col("ref")) & (alt != "."))
    g = snps.groupBy("rid", "pos", "ref").agg(F.array_sort(F.collect_set(alt)).alias("alts"))
    return g.where(F.size("alts") > 1)


def multiallelic_indels(indels: DataFrame, repeats: DataFrame, chunks: DataFrame, min_qual: float = 30.0, chunk_bits: int = 16) -> DataFrame:
    """rid, pos, ref, alts, vntr_id, n: one candidate record for each repeat in which two or more indels stand.

    indels has rid, chrom, pos, ref, alts (one), qual and motif, the indel's unit; repeats has rid, beg1, end1, motif and
    vntr_id. An indel counts if it overlaps exactly one repeat, begins on the base before it, has its motif (least
    rotations are compared) and a quality over min_qual. REF is the reference from the first begin to the last end of a
    repeat's indels, each ALT that stretch with the indel in its place; ALTs are different ones in byte order. Counting by
    repeat is aggregated; a repeat's indels that begin on one base are as many as it has alleles, repetitions once.
    """
    from stranda.operators.records import reference_windows

    alt = F.get("alts", F.lit(0))
    rows = indels.where((F.size("alts") == 1) & ~A.is_symbolic(alt)).select("rid", "chrom", "pos", "ref", alt.alias("alt"), "qual", S.canonical(F.upper("motif")).alias("motif"), (F.col("pos") + F.length("ref") - 1).alias("end1")).distinct()
    # What an indel changes begins behind its anchor; an insertion stands at that place.
    met = overlap_join(rows.withColumn("_b", F.col("pos") + 1).withColumn("_e", F.greatest("end1", F.col("pos") + 1)), repeats.select("rid", "beg1", "end1", S.canonical(F.upper("motif")).alias("motif"), "vntr_id"), "rid", "rid", ("_b", "_e"), ("beg1", "end1"))
    one = met.groupBy("rid", "chrom", "pos", "ref", "alt", "qual", "motif", "end1").agg(F.count("*").alias("n"), F.min(F.struct("r_vntr_id", "r_beg1", "r_motif")).alias("r"))
    kept = one.where((F.col("n") == 1) & (F.col("qual") > min_qual) & (F.col("pos") == F.col("r.r_beg1") - 1) & (F.col("motif") == F.col("r.r_motif")))
    g = kept.groupBy("rid", "chrom", F.col("r.r_vntr_id").alias("vntr_id")).agg(F.min("pos").alias("pos"), F.max("end1").alias("_end"), F.array_sort(F.collect_set(F.struct("pos", "ref", "alt"))).alias("m")).where(F.size("m") > 1)
    w = reference_windows(g, chunks, F.col("pos"), F.col("_end"), chunk_bits)
    put = lambda x: F.concat(F.substr("window", F.lit(1), x["pos"] - F.col("pos")), x["alt"], F.substr("window", x["pos"] - F.col("pos") + F.length(x["ref"]) + 1, F.length("window")))
    return w.select("rid", "pos", F.col("window").alias("ref"), F.array_sort(F.array_distinct(F.transform("m", put))).alias("alts"), "vntr_id", F.size("m").alias("n"))


def overlap_partition(a: DataFrame, b: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """part, n: records of a without an overlap in b (a), with a partial one alone (ap), with an exact one (ab1), and the
    same of b (b, bp, ab2). Exact is the same rid, pos and alleles."""
    from stranda.operators.cogroup import keyed

    def side(x: DataFrame, y: DataFrame, alone: str, partial: str, exact: str) -> DataFrame:
        x = with_end(keyed(x)).select("row_id", "rid", F.col("pos").alias("b"), F.col("end1").alias("e"), "pos", "akey")
        y = with_end(keyed(y)).select("rid", (F.col("pos") - left).alias("b"), (F.col("end1") + right).alias("e"), "pos", "akey")
        hits = overlap_join(x, y, "rid", "rid", ("b", "e"), ("b", "e"))
        same = ((F.col("pos") == F.col("r_pos")) & (F.col("akey") == F.col("r_akey"))).cast("int")
        state = hits.groupBy("row_id").agg(F.max(same).alias("same"))
        part = F.when(F.col("same") == 1, exact).when(F.col("same") == 0, partial).otherwise(alone)
        return x.select("row_id").join(state, "row_id", "left").groupBy(part.alias("part")).agg(F.count("*").alias("n"))

    return side(a, b, "a", "ap", "ab1").unionByName(side(b, a, "b", "bp", "ab2"))


def nearest_repeat(df: DataFrame, repeats: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """df (with row_id) with the first repeat, by begin and vntr_id, that overlaps the record: vntr_id, motif and the
    repeat's place as beg1, end1; null where none does."""
    r = repeats.select("rid", "vntr_id", "motif", (F.col("beg1") - left).alias("b"), (F.col("end1") + right).alias("e"), "beg1", "end1")
    hits = overlap_join(with_end(df).select("row_id", "rid", "pos", "end1"), r, "rid", "rid", ("pos", "end1"), ("b", "e"))
    best = hits.groupBy("row_id").agg(F.min(F.struct(F.col("r_beg1").alias("beg1"), F.col("r_vntr_id").alias("vntr_id"), F.col("r_motif").alias("motif"), F.col("r_end1").alias("end1"))).alias("v"))
    return df.join(best, "row_id", "left").select(*df.columns, "v.vntr_id", "v.motif", "v.beg1", "v.end1")


def vntrized(df: DataFrame, repeats: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """df (with row_id) whose records that overlap reference repeats have the place and alleles of the first of them.

    repeats has rid, beg1, end1, ref, alts and vntr_id; the first is the one of the least begin and vntr_id. Added are
    overlap_variants, the keys of all repeats that overlap the record widened by left and right, in that order, and of the
    record as it was; n_allele, its alleles before; and n_repeat_allele, the most that one of its repeats has. All three
    are null, and the record stays, where no repeat overlaps. A record's repeats are gathered, as many as lie on it.
    """
    name = lambda pos, ref, alts: A.variant_key(F.col("rid").cast("string"), pos, ref, alts)
    r = repeats.select("rid", "beg1", "end1", "vntr_id", "ref", "alts", name(F.col("beg1"), F.col("ref"), F.col("alts")).alias("key"))
    wide = with_end(df).select("row_id", "rid", (F.col("pos") - left).alias("_b"), (F.col("end1") + right).alias("_e"))
    hits = overlap_join(wide, r, "rid", "rid", ("_b", "_e"), ("beg1", "end1"))
    one = F.struct(F.col("r_beg1").alias("beg1"), F.col("r_vntr_id").alias("vntr_id"), F.col("r_ref").alias("ref"), F.col("r_alts").alias("alts"), F.col("r_key").alias("key"))
    found = hits.groupBy("row_id").agg(F.array_sort(F.collect_list(one)).alias("_v"), F.max(F.size("r_alts") + 1).alias("_n"))
    rows = df.join(found, "row_id", "left").withColumn("_f", F.get("_v", F.lit(0)))
    keys = F.array_join(F.concat(F.transform("_v", lambda v: v["key"]), F.array(name(F.col("pos"), F.col("ref"), F.col("alts")))), ",")
    moved = {"pos": F.coalesce("_f.beg1", "pos"), "ref": F.coalesce("_f.ref", "ref"), "alts": F.coalesce("_f.alts", "alts")}
    known = lambda c: F.when(F.col("_v").isNotNull(), c)
    return rows.select(*[moved[c].alias(c) if c in moved else F.col(f"`{c}`") for c in df.columns], known(keys).alias("overlap_variants"), known(F.size("alts") + 1).alias("n_allele"), F.col("_n").alias("n_repeat_allele"))


def joint_alleles(df: DataFrame) -> DataFrame:
    """n_allele, n_repeat_allele, n: how many records of so many alleles stand in repeats of so many, of vntrized records."""
    return df.where("n_repeat_allele is not null").groupBy("n_allele", "n_repeat_allele").agg(F.count("*").alias("n"))


def lift_over(df: DataFrame, chain: DataFrame) -> DataFrame:
    """df with rid and pos moved by the chain block that holds them (rid, beg1, end1, to_rid, shift), old_rid and old_pos;
    records in no block come out with null places. Of several blocks the one that begins last counts."""
    places = df.select("rid", "pos").distinct()
    hits = overlap_join(places, chain, "rid", "rid", ("pos", "pos"), ("beg1", "end1"))
    best = hits.groupBy(F.col("rid").alias("old_rid"), F.col("pos").alias("old_pos")).agg(F.max(F.struct(F.col("r_beg1"), F.col("r_to_rid").alias("rid"), (F.col("pos") + F.col("r_shift")).alias("pos"))).alias("_t"))
    out = df.withColumnsRenamed({"rid": "old_rid", "pos": "old_pos"}).join(best, ["old_rid", "old_pos"], "left")
    moved = {"rid": F.col("_t.rid"), "pos": F.col("_t.pos")}
    return out.select(*[moved[c].alias(c) if c in moved else F.col(f"`{c}`") for c in df.columns], "old_rid", "old_pos")
