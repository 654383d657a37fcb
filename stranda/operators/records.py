"""Rewrites of single records: decomposition, normal form, annotation of types, removal of fields."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stranda.functions import alleles as A
from stranda.session import cut

EMPTY = "array<string>"


def decompose(df: DataFrame, ref: str = "ref", alts: str = "alts", smart: dict[str, str] | None = None) -> DataFrame:
    """One row for each ALT, with alt_index, old_multiallelic (null for biallelic records) and rewritten sample fields.

    Of the columns gt (array of int, null for a missing allele), pl and gl (G-ordered) and dp, those present are rewritten:
    the row's ALT becomes allele 1, other ALTs missing; pl and gl keep the three genotypes of REF and that ALT. smart maps
    further array columns to A, R or G and slices them alike. Records without an ALT keep their one row.
    """
    smart = {"pl": "G", "gl": "G"} | (smart or {})
    alt_list = F.coalesce(F.col(alts), F.array().cast(EMPTY))
    n = F.size(alt_list)
    # Read before the explode replaces the list of ALTs by the row's one ALT.
    old = F.when(n > 1, A.variant_key(F.col("chrom"), F.col("pos"), F.col(ref), alt_list)) if "chrom" in df.columns and "pos" in df.columns else F.lit(None).cast("string")
    rows = df.withColumn("old_multiallelic", old).select("*", n.alias("_n"), F.posexplode_outer(alt_list).alias("_i", "_alt"))
    i = F.col("_i") + 1
    out = rows.withColumn("alt_index", F.col("_i") + 1).withColumn(alts, F.when(F.col("_alt").isNull(), F.array().cast(EMPTY)).otherwise(F.array("_alt")))
    many = F.col("_n") > 1
    if "gt" in df.columns:
        out = out.withColumn("gt", F.when(many, F.transform("gt", lambda a: F.when(a == i, 1).when(a == 0, 0))).otherwise(F.col("gt")))
    het, hom = (i * (i + 1) / 2).cast("int"), (i * (i + 1) / 2).cast("int") + i
    for c, number in smart.items():
        if c in df.columns:
            pick = {"G": [F.lit(0), het, hom], "A": [i - 1], "R": [F.lit(0), i]}[number]
            out = out.withColumn(c, F.when(many & F.col(c).isNotNull(), F.array(*[F.get(F.col(c), k) for k in pick])).otherwise(F.col(c)))
    return out.drop("_n", "_i", "_alt")


def decompose_blocks(df: DataFrame, ref: str = "ref", alts: str = "alts", distance: int | None = None) -> DataFrame:
    """Biallelic records with alleles of one length over 1 become one row for each mismatch, with old_clumped.

    With a distance mismatches at most that many bases apart stay together in one row, from the first to the last of
    them. All rows of a record share phase_set, the position of its first mismatch. Other records keep their row.
    """
    r, a = F.col(ref), F.get(F.col(alts), F.lit(0))
    base = lambda s, i: F.substr(s, i, F.lit(1))
    blocky = (F.size(alts) == 1) & (F.length(r) == F.length(a)) & (F.length(r) > 1) & ~A.is_symbolic(a)
    places = F.filter(F.sequence(F.lit(1), F.length(r)), lambda i: base(r, i) != base(a, i))
    if distance is None:
        spans = F.transform(places, lambda i: F.struct(i.alias("b"), i.alias("e")))
    else:
        # A place opens a span if the one before it lies farther off; the span ends before the next that opens one.
        opens = F.filter(places, lambda i: ~F.exists(places, lambda j: (j < i) & (i - j <= distance)))
        spans = F.transform(opens, lambda b: F.struct(b.alias("b"), F.array_max(F.filter(places, lambda j: (j >= b) & ~F.exists(opens, lambda o: (o > b) & (o <= j)))).alias("e")))
    whole = F.array(F.struct(F.lit(0).alias("b"), F.lit(0).alias("e")))
    out = df.withColumn("_spans", F.when(blocky & (F.size(places) > 0), spans).otherwise(whole)).withColumn("_first", F.array_min(places))
    old = A.variant_key(F.col("chrom"), F.col("pos"), r, F.col(alts))
    out = out.withColumn("_blocky", blocky & (F.size(places) > 0)).withColumn("old_clumped", F.when(F.col("_blocky"), old))
    out = out.withColumn("phase_set", F.when(F.col("_blocky"), F.col("pos") + F.col("_first") - 1)).select("*", F.explode("_spans").alias("_s"))
    cut = lambda s: F.substr(s, F.col("_s.b"), F.col("_s.e") - F.col("_s.b") + 1)
    return (
        out.withColumn("_ref", F.when(F.col("_blocky"), cut(r)).otherwise(r))
        .withColumn(alts, F.when(F.col("_blocky"), F.array(cut(a))).otherwise(F.col(alts)))
        .withColumn(ref, F.col("_ref"))
        .withColumn("pos", F.when(F.col("_blocky"), F.col("pos") + F.col("_s.b") - 1).otherwise(F.col("pos")))
        .drop("_spans", "_first", "_blocky", "_s", "_ref")
    )


def needleman_wunsch(a: str, b: str, match: int = 0, mismatch: int = -1, gap: int = -1) -> tuple[str, str]:
    """One best global alignment of two strings, gaps as '-'; of equal moves the diagonal, then the gap in b."""
    n, m = len(a), len(b)
    score = [[gap * j for j in range(m + 1)]] + [[gap * i] + [0] * m for i in range(1, n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score[i][j] = max(score[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), score[i - 1][j] + gap, score[i][j - 1] + gap)
    x, y, i, j = [], [], n, m
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            x.append(a[i])
            y.append(b[j])
        elif i and score[i][j] == score[i - 1][j] + gap:
            i -= 1
            x.append(a[i])
            y.append("-")
        else:
            j -= 1
            x.append("-")
            y.append(b[j])
    return "".join(reversed(x)), "".join(reversed(y))


def alignments(df: DataFrame) -> DataFrame:
    """ref, alt, ref_aligned, alt_aligned, distance: one best global alignment of each pair, null for a null allele."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made = [needleman_wunsch(r, a) if r is not None and a is not None else (None, None) for r, a in zip(x["ref"], x["alt"])]
            gaps = [None if p is None else sum(u != v for u, v in zip(p, q)) for p, q in made]
            yield pd.DataFrame({"ref": x["ref"], "alt": x["alt"], "ref_aligned": [p for p, _ in made], "alt_aligned": [q for _, q in made], "distance": pd.array(gaps, dtype="Int32")})

    return df.select("ref", "alt").mapInPandas(run, "ref string, alt string, ref_aligned string, alt_aligned string, distance int")


def _aligned_pieces(pos: int, ref: str, alt: str) -> list[tuple[int, str, str]]:
    """The differing pieces of an alignment in which the first bases stand together.

    A column with a base on both sides begins a piece, gaps after it belong to it; pieces without a difference go.
    """
    x, y = needleman_wunsch(ref[1:], alt[1:])
    pieces: list[list] = []
    at = pos
    for r, a in zip(ref[0] + x, alt[0] + y):
        if r != "-" and a != "-":
            pieces.append([at, r, a])
        else:
            pieces[-1][1] += r.strip("-")
            pieces[-1][2] += a.strip("-")
        at += r != "-"
    return [(p, r, a) for p, r, a in pieces if r != a]


def decompose_aligned(df: DataFrame, ref: str = "ref", alts: str = "alts") -> DataFrame:
    """Biallelic records with alleles of different lengths over 1 become the differing pieces of their alignment, each
    mismatch and each gap a record of its own. Other records keep their row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keep, pieces = [], []
            for i, (pos, r, a) in enumerate(zip(x["pos"], x[ref], x[alts])):
                plain = r is not None and a is not None and len(a) == 1 and "<" not in a[0] and "[" not in a[0] and "]" not in a[0] and len(r) != len(a[0]) and min(len(r), len(a[0])) > 1
                for piece in (_aligned_pieces(int(pos), r, a[0]) if plain else [(pos, r, None if a is None else list(a))]) or [(pos, r, list(a))]:
                    keep.append(i)
                    pieces.append(piece)
            out = x.iloc[keep].reset_index(drop=True)
            out["pos"], out[ref] = [p[0] for p in pieces], [p[1] for p in pieces]
            out[alts] = [[p[2]] if isinstance(p[2], str) else p[2] for p in pieces]
            yield out

    return df.mapInPandas(run, df.schema)


def left_normalize(pos: int, alleles: list[str], before) -> tuple[int, list[str], bool, bool]:
    """pos, alleles, whether the left was extended, whether the left was trimmed: the parsimonious left-aligned form.

    before(pos) gives the reference base at a position; the record stops at position 1.
    """
    alleles, extended, trimmed = [a.upper() for a in alleles], False, False
    while True:
        if all(alleles) and len({a[-1] for a in alleles}) == 1 and (min(map(len, alleles)) > 1 or pos > 1):
            alleles = [a[:-1] for a in alleles]
        elif not all(alleles):
            pos -= 1
            base = before(pos)
            alleles = [base + a for a in alleles]
            extended = True
        else:
            break
    while min(map(len, alleles)) > 1 and len({a[0] for a in alleles}) == 1:
        alleles = [a[1:] for a in alleles]
        pos += 1
        trimmed = True
    return pos, alleles, extended, trimmed


CHUNK_BITS = 16


def reference_windows(df: DataFrame, chunks: DataFrame, beg: Column, end: Column, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """df with window and window_beg: the reference bases from beg to end, from a chunked reference.

    chunks has chrom, chunk, seq, each chunk holding 2**chunk_bits bases. A row asks only for the chunks its window
    touches, so neither the whole reference nor a contig travels with a task.
    """
    keyed = df.withColumn("_b", F.greatest(beg, F.lit(1)).cast("long")).withColumn("_e", end.cast("long"))
    # Each different window is put together once, and rows get it by its place, however they are read or partitioned.
    places = keyed.where(F.col("chrom").isNotNull() & (F.col("_e") >= F.col("_b"))).select("chrom", "_b", "_e").distinct()
    asks = places.select("chrom", "_b", "_e", F.explode(F.sequence(F.shiftright(F.col("_b") - 1, chunk_bits), F.shiftright(F.col("_e") - 1, chunk_bits))).alias("chunk"))
    offset = F.col("chunk") * (1 << chunk_bits)
    part = F.substr("seq", F.greatest(F.col("_b") - offset, F.lit(1)), F.least(F.col("_e") - offset, F.lit(1 << chunk_bits)) - F.greatest(F.col("_b") - offset, F.lit(1)) + 1)
    got = asks.join(chunks.select("chrom", F.col("chunk").cast("long").alias("chunk"), "seq"), ["chrom", "chunk"]).select("chrom", "_b", "_e", "chunk", part.alias("part"))
    window = got.groupBy("chrom", "_b", "_e").agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    joined = keyed.join(window.select("chrom", "_b", "_e", F.upper(F.array_join(F.transform("parts", lambda p: p["part"]), "")).alias("window")), ["chrom", "_b", "_e"], "left")
    return joined.select(*df.columns, "window", F.col("_b").alias("window_beg"))


def normalize(df: DataFrame, chunks: DataFrame, ref: str = "ref", alts: str = "alts", flank: int = 512, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Left-aligned, parsimonious records with old_variant and change (null, lt, rt, rt_la, lt_rt).

    Records with symbolic alleles, null fields, or a REF the reference doesn't have keep their form; ref_mismatch tells
    the last. Records that are normal already need no reference and are not joined to it. If a shift reaches the start
    of its window of `flank` bases, that record is done again with a window 16 times as wide, until none does.
    """
    symbolic = F.exists(F.coalesce(F.col(alts), F.array().cast(EMPTY)), lambda a: A.is_symbolic(a) | F.contains(a, F.lit("[")) | F.contains(a, F.lit("]")))
    todo = F.col(ref).isNotNull() & F.col("pos").isNotNull() & (F.size(alts) > 0) & ~symbolic & ~A.is_normalized(F.col(ref), F.col(alts))
    todo = F.coalesce(todo, F.lit(False))
    fields = [*df.columns, "old_variant", "change", "ref_mismatch"]
    blank = df.where(~todo).withColumn("old_variant", F.lit(None).cast("string")).withColumn("change", F.lit(None).cast("string")).withColumn("ref_mismatch", F.lit(False))
    done, rest = [blank.select(*fields)], df.where(todo)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["old_variant string, change string, ref_mismatch boolean, _short boolean"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for chrom, pos, r, a, window, beg in zip(x["chrom"], x["pos"], x[ref], x[alts], x["window"], x["window_beg"]):
                window, pos, a = window or "", int(pos), list(a)
                held = window[pos - beg : pos - beg + len(r)]
                if held and held != r.upper():
                    rows.append((pos, r, a, None, None, True, False))
                    continue
                here = {"short": False}

                def before(p: int, window=window, beg=beg, here=here) -> str:
                    if p < beg or p - beg >= len(window):
                        here["short"] = True
                        return "N"
                    return window[p - beg]

                new_pos, new, extended, trimmed = left_normalize(pos, [r, *a], before)
                if here["short"]:
                    # Too short a window is widened; a contig without a reference has none.
                    rows.append((pos, r, a, None, None, not window, bool(window) and beg > 1))
                    continue
                if (new_pos, new) == (pos, [x.upper() for x in (r, *a)]):
                    rows.append((pos, r, a, None, None, False, False))
                    continue
                right = len(r) > len(new[0]) or extended
                change = "rt_la" if extended else "lt_rt" if trimmed and right else "lt" if trimmed else "rt"
                rows.append((new_pos, new[0], new[1:], f"{chrom}:{pos}:{'/'.join([r, *a])}", change, False, False))
            out = x.drop(columns=["window", "window_beg"]).reset_index(drop=True)
            for i, c in enumerate(("pos", ref, alts, "old_variant", "change", "ref_mismatch", "_short")):
                out[c] = [row[i] for row in rows]
            yield out[[*fields, "_short"]]

    while True:
        windows = reference_windows(rest, chunks, F.col("pos") - flank, F.col("pos") + F.length(ref) - 1, chunk_bits)
        out = cut(windows.mapInPandas(run, schema))
        done.append(out.where("not _short").select(*fields))
        rest = out.where("_short").select(*df.columns)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        flank *= 16


def annotate_types(df: DataFrame, low_complexity: DataFrame | None = None, coding: DataFrame | None = None, regions: tuple[str, str, str] = ("rid", "beg1", "end1")) -> DataFrame:
    """df, classified, with VT (type names), LC (overlaps a low-complexity region) and, for indels in coding regions, FS:
    FS1 if an indel's length is no multiple of three, else NFS. Rows without a place overlap nothing."""
    from stranda.operators.intervals import overlap_flags

    key, beg, end = regions
    out = A.classified(df).withColumn("vt", A.type_name(F.col("vtype"))).withColumn("_end1", F.col("pos") + F.length("ref") - 1)
    spread = [x.select(F.col(key).alias("rid"), F.lit(flag).alias("flag"), F.col(beg).alias("b"), F.col(end).alias("e")) for x, flag in ((low_complexity, "lc"), (coding, "_cds")) if x is not None]
    if spread:
        out = overlap_flags(out, "rid", ("pos", "_end1"), reduce(DataFrame.unionByName, spread), ["lc", "_cds"])
    else:
        out = out.withColumn("lc", F.lit(False)).withColumn("_cds", F.lit(False))
    shifted = F.exists("alleles", lambda x: F.abs(x["dlen"]) % 3 != 0)
    indel = F.col("vtype").bitwiseAND(A.INDEL) != 0
    return out.withColumn("fs", F.when(F.col("_cds") & indel, F.when(shifted, "FS1").otherwise("NFS"))).drop("_end1", "_cds")


def remove_fields(df: DataFrame, info: tuple[str, ...] = (), format_: tuple[str, ...] = (), filters: bool = False) -> DataFrame:
    """Drops INFO tags from the map info, FORMAT tags from the parallel arrays format_keys and the samples' values, and
    with filters all filters."""
    out = df
    if info:
        out = out.withColumn("info", F.map_filter("info", lambda k, _: ~k.isin(*info)))
    if format_ and "format_keys" in df.columns:
        kept = lambda values: F.transform(F.filter(F.arrays_zip(F.col("format_keys").alias("k"), values.alias("v")), lambda p: ~p["k"].isin(*format_)), lambda p: p["v"])
        if "samples" in df.columns:
            out = out.withColumn("samples", F.transform("samples", lambda s: F.struct(s["sample"].alias("sample"), kept(s["values"]).alias("values"))))
        out = out.withColumn("format_keys", F.filter("format_keys", lambda k: ~k.isin(*format_)))
    return out.withColumn("filters", F.array().cast(EMPTY)) if filters else out


def add_filter(df: DataFrame, condition: Column, tag: str, replace: bool = False) -> DataFrame:
    """All records; those that meet the condition get the tag among their filters, or with replace as their only one."""
    old = F.coalesce(F.col("filters"), F.array().cast(EMPTY))
    new = F.array(F.lit(tag)) if replace else F.array_union(F.filter(old, lambda f: f != "PASS"), F.array(F.lit(tag)))
    return df.withColumn("filters", F.when(condition, new).otherwise(F.col("filters")))


def widen_to_tract(df: DataFrame, chunks: DataFrame, tract: str, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Indels that lie inside the tract (struct of beg and end) widened by one base to each side of it; set_ref is within,
    partial or none. Alleles get the tract's flanks, pos becomes the tract's begin less one."""
    t = F.col(tract)
    beg, end = t["beg"] - 1, t["end"] + 1
    last = F.col("pos") + F.length("ref") - 1
    state = F.when(t.isNull() | (F.col("pos") > end) | (last < beg), "none").when((F.col("pos") >= beg) & (last <= end), "within").otherwise("partial")
    rows = df.withColumn("set_ref", state)
    inside = reference_windows(rows.where("set_ref = 'within'"), chunks, beg, end, chunk_bits)
    left = F.substr("window", F.lit(1), F.col("pos") - F.col("window_beg"))
    right = F.substr("window", last - F.col("window_beg") + 2, F.length("window"))
    wide = (
        inside.withColumn("_l", left).withColumn("_r", right)
        .withColumn("alts", F.transform("alts", lambda a: F.concat("_l", a, "_r")))
        .withColumn("ref", F.concat("_l", "ref", "_r")).withColumn("pos", F.col("window_beg").cast("int"))
        .drop("_l", "_r", "window", "window_beg")
    )
    return wide.select(*rows.columns).unionByName(rows.where("set_ref <> 'within'"))


def probes(df: DataFrame, chunks: DataFrame, flank: int = 20, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """ref_probe, alt_probes and plen: each allele between `flank` bases of its left and right neighbourhood, cut to the
    shortest length, over flank, at which all of them differ; null if even the whole windows don't differ, or hold an N."""
    last = F.col("pos") + F.length("ref") - 1
    rows = reference_windows(df, chunks, F.col("pos") - flank, last + 4 * flank, chunk_bits)
    left = F.substr("window", F.lit(1), F.col("pos") - F.col("window_beg"))
    right = F.substr("window", last - F.col("window_beg") + 2, F.lit(4 * flank))
    hap = F.transform(F.concat(F.array("ref"), F.coalesce(F.col("alts"), F.array().cast(EMPTY))), lambda a: F.concat(left, a, right))
    out = rows.withColumn("_h", hap)
    # Haplotypes that agree up to a length agree up to every shorter one: what counts is the last pair to part.
    apart = lambda x, y: A.left_trim(x, y, F.lit(0)) + 1
    latest = F.array_max(F.flatten(F.transform("_h", lambda x, i: F.transform(F.slice("_h", i + 2, F.greatest(F.size("_h") - i - 1, F.lit(0))), lambda y: apart(x, y)))))
    shortest = F.array_min(F.transform("_h", lambda h: F.length(h)))
    differ = F.size(F.array_distinct("_h")) == F.size("_h")
    plen = F.greatest(latest, F.lit(flank + 1))
    out = out.withColumn("_p", plen).withColumn("plen", F.when(differ & (F.col("_p") <= shortest), F.col("_p")))
    ok = F.col("plen").isNotNull() & ~F.exists("_h", lambda h: F.contains(h, F.lit("N"))) & F.col("window").isNotNull()
    cut = lambda h: F.substr(h, F.lit(1), F.col("plen"))
    return (
        out.withColumn("ref_probe", F.when(ok, cut(F.get("_h", F.lit(0)))))
        .withColumn("alt_probes", F.when(ok, F.transform(F.slice("_h", 2, F.greatest(F.size("_h") - 1, F.lit(1))), cut)))
        .withColumn("plen", F.when(ok, F.col("plen")))
        .drop("_h", "_p", "window", "window_beg")
    )
