"""Variant call files as text: a header object, a typed scan and an ordered sink."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTE = re.compile(r'\s*([^=,"]+?)\s*=\s*("(?:[^"\\]|\\.)*"|[^,]*)\s*(?:,|$)')


@dataclass
class Header:
    """The lines of a header and what they declare: contigs in order, INFO, FORMAT and FILTER tags, samples."""

    lines: list[str] = field(default_factory=list)
    contigs: list[tuple[str, int | None]] = field(default_factory=list)
    info: dict[str, dict] = field(default_factory=dict)
    format: dict[str, dict] = field(default_factory=dict)
    filter: dict[str, dict] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, lines: list[str]) -> Header:
        h = cls()
        for line in lines:
            line = line.rstrip("\r\n")
            if line.startswith("#CHROM"):
                h.samples = line.split("\t")[9:]
                continue
            h.lines.append(line)
            m = re.fullmatch(r"##(INFO|FORMAT|FILTER|contig)=<(.*)>", line)
            if m:
                found = {k: v[1:-1] if v.startswith('"') else v for k, v in ATTRIBUTE.findall(m[2])}
                if m[1] == "contig":
                    h.contigs.append((found.get("ID", ""), int(found["length"]) if found.get("length", "").isdigit() else None))
                elif "ID" in found:
                    getattr(h, m[1].lower()).setdefault(found["ID"], found)
        return h

    def add(self, line: str) -> None:
        """One more line, unless its tag is declared already."""
        h = Header.parse([line])
        for kind in ("info", "format", "filter"):
            for tag, found in getattr(h, kind).items():
                if tag in getattr(self, kind):
                    return
                getattr(self, kind)[tag] = found
        self.lines.append(line)

    def info_types(self) -> dict[str, str]:
        """INFO tags with the types of the filter language."""
        names = {"Flag": "flag", "Integer": "int", "Float": "float"}
        return {tag: names.get(x.get("Type", ""), "string") for tag, x in self.info.items()}

    def text(self, samples: list[str] | None = None) -> list[str]:
        names = self.samples if samples is None else samples
        columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *names] if names else [])]
        return [*self.lines, "\t".join(columns)]


def read_header(spark: SparkSession, path: str) -> Header:
    """The header of a file or of files with one header; only lines that begin with # come to the driver."""
    lines = [r[0] for r in spark.read.text(path).where(F.col("value").startswith("#")).collect()]
    return Header.parse(list(dict.fromkeys(lines)))


def _missing(c: Column) -> Column:
    return F.nullif(c, F.lit("."))


def read_vcf(spark: SparkSession, path: str, header: Header | None = None, sites_only: bool = False) -> tuple[DataFrame, Header]:
    """chrom, rid, pos, id, ref, alts, qual, filters, info (tag to raw value), format_keys, samples; and the header.

    rid is the contig's place in the header, null for one it doesn't declare. Lines of fewer than eight fields are no
    records. Sample values stay raw, so that a plan that asks for one tag splits only that.
    """
    header = header or read_header(spark, path)
    raw = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"))
    f = lambda i: F.get("f", F.lit(i))
    pairs = F.transform(F.split(f(7), ";"), lambda kv: F.struct(F.substring_index(kv, "=", 1).alias("k"), F.when(F.contains(kv, F.lit("=")), F.substr(kv, F.instr(kv, "=") + 1)).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    order = F.create_map(*[x for i, (name, _) in enumerate(header.contigs) for x in (F.lit(name), F.lit(i))]) if header.contigs else None
    rid = F.get(F.array(order), F.lit(0))[f(0)] if order is not None else F.lit(None).cast("int")
    df = raw.where(F.size("f") >= 8).select(
        f(0).alias("chrom"),
        rid.alias("rid"),
        f(1).try_cast("int").alias("pos"),
        _missing(f(2)).alias("id"),
        f(3).alias("ref"),
        F.when(f(4) == ".", F.array().cast("array<string>")).otherwise(F.split(f(4), ",")).alias("alts"),
        f(5).try_cast("float").alias("qual"),
        F.when(f(6) == ".", F.array().cast("array<string>")).otherwise(F.split(f(6), ";")).alias("filters"),
        F.when(f(7) == ".", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(first)).alias("info"),
        F.when(F.size("f") > 8, F.split(f(8), ":")).otherwise(F.array().cast("array<string>")).alias("format_keys"),
        F.when(F.size("f") > 9, F.slice("f", 10, F.size("f"))).otherwise(F.array().cast("array<string>")).alias("_s"),
    )
    if sites_only:
        return df.drop("_s", "format_keys"), header
    names = F.array(*[F.lit(s) for s in header.samples]) if header.samples else F.array().cast("array<string>")
    samples = F.transform(F.col("_s"), lambda s, i: F.struct(F.get(names, i).alias("sample"), F.split(s, ":").alias("values")))
    return df.withColumn("samples", samples).drop("_s"), header


def sample_value(sample: Column, keys: Column, tag: str) -> Column:
    """A sample's raw value of a FORMAT tag; null if it has none or the value is missing."""
    return _missing(F.get(sample["values"], F.array_position(keys, tag) - 1))


def genotype(raw: Column) -> Column:
    """struct of alleles (null for a missing one) and phased of a GT value."""
    return F.struct(F.transform(F.split(raw, "[/|]"), lambda a: a.try_cast("int")).alias("alleles"), F.contains(raw, F.lit("|")).alias("phased"))


def record_lines(df: DataFrame) -> DataFrame:
    """rid, pos and value: each record as its line of text."""
    dot = lambda c: F.when(c.isNull() | (c == ""), F.lit(".")).otherwise(c)
    number = F.regexp_replace(F.format_string("%.6g", F.col("qual").cast("double")), r"(\.\d*?)0+(e|$)", "$1$2")
    qual = F.when(F.col("qual").isNull(), ".").otherwise(F.regexp_replace(number, r"\.(e|$)", "$1"))
    info = F.array_join(F.transform(F.map_entries("info"), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    fixed = [F.col("chrom"), F.col("pos").cast("string"), dot(F.col("id")), F.col("ref"), dot(F.array_join("alts", ",")), qual, dot(F.array_join("filters", ";")), dot(info)]
    if "samples" in df.columns:
        cells = F.concat(F.array(F.array_join("format_keys", ":")), F.transform("samples", lambda s: F.array_join(s["values"], ":", ".")))
        fixed.append(F.when(F.size("samples") > 0, F.array_join(cells, "\t")))
    return df.select("rid", "pos", F.concat_ws("\t", *fixed).alias("value"))


def write_vcf(df: DataFrame, header: Header, path: str, samples: list[str] | None = None) -> None:
    """Lines in the order of contigs and positions: ranges of (rid, pos), each sorted; the header heads the first."""
    spark = df.sparkSession
    top = spark.createDataFrame([(i, line) for i, line in enumerate(header.text(samples if "samples" in df.columns else []))], "n int, value string")
    rows = record_lines(df).select(F.coalesce("rid", F.lit(2**31 - 1)).alias("rid"), "pos", "value")
    both = top.select(F.lit(-1).alias("rid"), F.col("n").alias("pos"), "value").unionByName(rows)
    both.repartitionByRange("rid", "pos").sortWithinPartitions("rid", "pos").select("value").write.mode("overwrite").text(path)
