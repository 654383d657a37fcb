"""Schemas that drift between files: what changes from file to file, and one consistent table over all files.

The tags of a file are its columns. Each file is profiled: what its header declares, and for every tag a sketch of its
values. The tags that only one of two neighbouring files has are the two sides of a bipartite graph, and the assignment
of largest total weight names the renames.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stranda.operators.ordering import with_previous

TAGS = "array<struct<tag:string,number:string,type:string,descr:string>>"
ATTRIBUTE = r'\s*([^=,"]+?)\s*=\s*("(?:[^"\\]|\\.)*"|[^,]*)\s*(?:,|$)'
CHANGES = "run_id long, file_id long, tag string, drift string, was string"
COLUMNS = ("GT", "DP", "PL", "AD", "BQSUM", "GQ")


def declared(header: str | None) -> list[dict]:
    """The FORMAT tags a header declares; of lines with the same ID the first counts, a line without ID declares none.

    A description is brought to its letters and digits in lower case; it is None where the line has none.
    """
    out: dict[str, dict] = {}
    for line in re.split(r"\r\n|\n|\r", header or ""):
        if line.startswith("##FORMAT=<") and line.endswith(">"):
            found: dict[str, str] = {}
            for name, value in re.findall(ATTRIBUTE, line[len("##FORMAT=<") : -1]):
                found.setdefault(name, re.sub(r"\\(.)", r"\1", value[1:-1]) if value.startswith('"') else value.strip())
            if found.get("ID"):
                text = found.get("Description")
                descr = None if text is None else "".join(c for c in text.lower() if c.isalnum())
                out.setdefault(found["ID"], {"tag": found["ID"], "number": found.get("Number"), "type": found.get("Type"), "descr": descr})
    return list(out.values())


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield pd.DataFrame({"run_id": x["run_id"], "file_id": x["file_id"], "file_seq": x["file_seq"], "tags": [declared(h) for h in x["header_text"]]})


def file_tags(files: DataFrame) -> DataFrame:
    """run_id, file_id, file_seq, tags: one row for each file_id, the earliest delivery of those that differ."""
    one = files.where("file_id is not null").groupBy("file_id").agg(F.min_by(F.struct("run_id", "file_seq", "header_text"), F.struct("arrived_at", "header_text")).alias("r"))
    return one.select("r.run_id", "file_id", "r.file_seq", "r.header_text").mapInPandas(_parse, f"run_id long, file_id long, file_seq int, tags {TAGS}")


def value_sketches(genotypes: DataFrame) -> DataFrame:
    """file_id, sketches: for every tag of a file the share of missing values, mean arity and mean length of its values,
    and a bitmap of 63 hashed values. Aggregated in the JVM, before and after one shuffle of (file, tag) rows."""
    pairs = genotypes.where("fmt is not null and val is not null").select("file_id", F.explode(F.arrays_zip(F.split("fmt", ":").alias("t"), F.split("val", ":").alias("v"))).alias("p"))
    rows = pairs.select("file_id", F.col("p.t").alias("tag"), F.col("p.v").alias("v")).where("tag is not null")
    missing = F.col("v").isNull() | (F.col("v") == ".")
    return (
        rows.groupBy("file_id", "tag")
        .agg(
            F.count("*").alias("n"),
            F.sum(missing.cast("long")).alias("missing"),
            F.sum(F.when(~missing, F.length("v"))).alias("chars"),
            F.sum(F.when(~missing, F.length("v") - F.length(F.translate("v", ",", "")))).alias("commas"),
            F.bit_or(F.when(~missing, F.expr("shiftleft(1L, pmod(hash(v), 63))"))).alias("bits"),
        )
        .groupBy("file_id")
        .agg(F.collect_list(F.struct("tag", "n", "missing", "chars", "commas", "bits")).alias("sketches"))
    )


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the largest total weight; pairs of weight 0 are no pairs.

    Shortest augmenting paths with potentials, for matrices of a few dozen rows.
    """
    if weight.size == 0:
        return []
    turned = weight.shape[0] > weight.shape[1]
    cost = -(weight.T if turned else weight)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            done[col] = True
            free = ~done[1:]
            slack = cost[owner[col] - 1] - u[owner[col]] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], col
            nxt = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            delta = least[nxt]
            u[owner[done]] += delta
            v[done] -= delta
            least[1:][free] -= delta
            col = nxt
            if owner[col] == 0:
                break
        while col:
            owner[col], col = owner[back[col]], back[col]
    pairs = [(owner[c] - 1, c - 1) for c in range(1, m + 1) if owner[c]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs if cost[a, b] < 0)


def name_likeness(a: str, b: str) -> float:
    """Share of letter pairs two names have in common, case ignored."""
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or {s}
    x, y = grams(f"^{a.lower()}$"), grams(f"^{b.lower()}$")
    return 2 * len(x & y) / (len(x) + len(y))


def sketch_likeness(a, b) -> float:
    """0 to 1; 0.5 where one of the two tags has no values."""
    if a is None or b is None or not a["n"] or not b["n"]:
        return 0.5
    close = lambda x, y: 1 / (1 + abs(x - y))
    part = lambda s, what: (s[what] or 0) / max(1, s["n"] - s["missing"])
    x, y = int(a["bits"] or 0), int(b["bits"] or 0)
    bits = (x & y).bit_count() / max(1, (x | y).bit_count())
    return (close(part(a, "chars"), part(b, "chars")) + close(part(a, "commas"), part(b, "commas")) + close(a["missing"] / a["n"], b["missing"] / b["n"]) + bits) / 4


def compare(old: list, new: list, old_sketches: dict, new_sketches: dict) -> list[tuple[str, str, str | None]]:
    """(tag, drift, was) between the tags of two files. Only tags whose descriptions agree can be a rename; which of
    several candidates is the partner, likeness of names and of value sketches decides. A tag whose description agrees
    with one that went to another partner is a rename as well, by the letter of the rule."""
    before, after = {t["tag"]: t for t in old}, {t["tag"]: t for t in new}
    gone, came = [t for t in before if t not in after], [t for t in after if t not in before]
    kind = lambda t: (t["number"], t["type"])
    out = [(t, "retyped", t) for t in after if t in before and kind(after[t]) != kind(before[t])]
    weight = np.zeros((len(gone), len(came)))
    for i, a in enumerate(gone):
        for j, b in enumerate(came):
            if before[a]["descr"] is not None and before[a]["descr"] == after[b]["descr"]:
                weight[i, j] = 1 + name_likeness(a, b) + sketch_likeness(old_sketches.get(a), new_sketches.get(b)) + (kind(before[a]) == kind(after[b]))
    partner = {j: i for i, j in assign(weight)}
    for j, b in enumerate(came):
        if j not in partner and len(gone) and weight[:, j].max() > 0:
            partner[j] = int(weight[:, j].argmax())
        if j not in partner:
            out.append((b, "added", None))
            continue
        a = gone[partner[j]]
        out.append((b, "renamed", a))
        if kind(before[a]) != kind(after[b]):
            out.append((b, "retyped", a))
    out += [(a, "removed", a) for i, a in enumerate(gone) if not (len(came) and weight[i].max() > 0)]
    return out


def _changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    of = lambda s: {x["tag"]: x for x in s} if s is not None else {}
    for x in batches:
        rows = [
            (run, file, *change)
            for run, file, new, old, a, b in zip(x["run_id"], x["file_id"], x["tags"], x["old"], x["old_sketches"], x["new_sketches"])
            for change in compare(list(old), list(new), of(a), of(b))
        ]
        yield pd.DataFrame(rows, columns=["run_id", "file_id", "tag", "drift", "was"])


def drift(files: DataFrame, genotypes: DataFrame) -> DataFrame:
    """run_id, file_id, tag, drift, was: each change between a file and the one of the next lower file_seq of its run.

    drift is added, removed, renamed or retyped; tag is the later file's ID, for removed the earlier one's; was is the
    earlier file's ID, null for added. A file_id delivered again counts once, files without run_id or file_seq have no
    neighbours, equal file_seqs stand in the order of file_id. Files without values are compared by their headers alone.
    Where several tags with one description went or came, likeness of types, names and values decides which became which;
    where one went and one came, the assignment has no choice, whatever the sketches say.
    """
    tags = file_tags(files.select("run_id", "file_id", "file_seq", "arrived_at", "header_text"))
    pairs = with_previous(tags.where("run_id is not null and file_seq is not null"), ["run_id"], "file_seq", F.struct("file_id", "tags"), tie="file_id").where("prev is not null")
    # Only files whose tags differ are matched and have their sketches joined.
    names = lambda c: F.array_sort(F.transform(c, lambda t: t["tag"]))
    kinds = lambda c: F.array_sort(F.transform(c, lambda t: F.struct(t["tag"], t["number"], t["type"])))
    moved = pairs.where((names(F.col("tags")) != names(F.col("prev.tags"))) | ~kinds(F.col("tags")).eqNullSafe(kinds(F.col("prev.tags"))))
    moved = moved.select("run_id", "file_id", "tags", F.col("prev.file_id").alias("old_id"), F.col("prev.tags").alias("old"))
    s = value_sketches(genotypes.select("file_id", "fmt", "val"))
    both = moved.join(s.withColumnRenamed("sketches", "new_sketches"), "file_id", "left").join(s.select(F.col("file_id").alias("old_id"), F.col("sketches").alias("old_sketches")), "old_id", "left")
    return both.select("run_id", "file_id", "tags", "old", "old_sketches", "new_sketches").mapInPandas(_changes, CHANGES)


def unified(files: DataFrame, genotypes: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """One table over all files: row_id, file_id, run_id, chrom, pos, sample_id, a typed column for each of columns, other.

    Tags with one description are one column, under the name most files give it; a file that declares two tags with one
    description keeps their own names. gt is a string, dp an int, the rest arrays of doubles, since Number and Type
    differ by file; missing values are null. All other values come out in other, as (tag, value). Rows of a file without
    a header, and tags a header doesn't declare, keep their tags' names. Late and repeated rows stay.
    """
    tags = file_tags(files.select("run_id", "file_id", "file_seq", "arrived_at", "header_text"))
    flat = tags.select("file_id", F.explode("tags").alias("t")).select("file_id", "t.tag", "t.descr")
    usual = flat.where("descr is not null").groupBy("descr", "tag").agg(F.count("*").alias("n")).groupBy("descr").agg(F.max_by("tag", F.struct("n", "tag")).alias("usual"))
    alone = flat.groupBy("file_id", "descr").agg(F.count("*").alias("n"), F.first("tag").alias("tag")).where("n = 1 and descr is not null").join(usual, "descr")
    names = alone.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "usual"))).alias("names"))
    head = tags.select("file_id", "run_id").join(names, "file_id", "left")
    g = genotypes.select("row_id", "file_id", "chrom", "pos", "sample_id", F.split("fmt", ":").alias("_t"), F.split("val", ":").alias("_v")).join(head, "file_id", "left")
    g = g.withColumn("_t", F.when(F.col("names").isNull(), F.col("_t")).otherwise(F.transform("_t", lambda t: F.coalesce(F.element_at(F.col("names"), t), t))))
    value = lambda tag: F.nullif(F.get("_v", F.array_position("_t", tag) - 1), F.lit("."))
    parts = lambda tag: F.transform(F.split(value(tag), "[,;]"), lambda x: F.nullif(x, F.lit(".")))
    fails = lambda tag: F.exists(parts(tag), lambda x: x.isNotNull() & x.try_cast("double").isNull())
    numbers = lambda tag: F.when(~fails(tag), F.transform(parts(tag), lambda x: x.try_cast("double")))
    floored = lambda tag: F.floor(F.when(value(tag).try_cast("double").between(-(2**31), 2**31 - 1), value(tag).try_cast("double"))).cast("int")
    typed = {"GT": value, "DP": floored}
    g = g.select("row_id", "file_id", "run_id", "chrom", "pos", "sample_id", "_t", "_v", *[typed.get(c, numbers)(c).alias(c.lower()) for c in columns])
    # A value that its column can't hold, a tag's second one, and one beyond the tags of fmt stand in other.
    held = lambda tag, i: F.coalesce(F.array_position("_t", tag) == i + 1, F.lit(False)) & F.array_contains(F.array(*[F.when(value(c).isNull() | F.col(c.lower()).isNotNull(), c) for c in columns]), tag)
    rest = F.filter(F.arrays_zip(F.coalesce("_t", F.array().cast("array<string>")).alias("tag"), F.col("_v").alias("value")), lambda p, i: ~F.coalesce(held(p["tag"], i), F.lit(False)) & ~F.coalesce(p["tag"].isin(*columns) & (p["value"].isNull() | (p["value"] == ".")), F.lit(False)))
    return g.select("row_id", "file_id", "run_id", "chrom", "pos", "sample_id", *[c.lower() for c in columns], rest.alias("other"))
