"""Binary alignment files as a data source: spark.read.format("stranda_bam").load(path).

One task reads one file, block by block, read by read. The files' place must be reachable as
a path from the executors. Text files (read_sam) are the way for a single large file, since the scan can cut them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "qname string, flag int, chrom string, pos int, mapq int, cigar string, mate_chrom string, mate_pos int, seq string, qual string, md string"

# Fixed values of the format: letters of packed bases, CIGAR operations, sizes of tag values.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


class BamFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _tag_md(data: bytes, at: int) -> str | None:
    """The MD tag of a record's optional fields."""
    import struct

    while at + 3 <= len(data):
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            if tag == b"MD":
                return data[at:end].decode("ascii")
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            at += 5 + n * SIZES[sub]
        else:
            at += SIZES[kind]
    return None


def bam_records(path: str) -> Iterator[tuple]:
    """The reads of a file in its order, as rows of SCHEMA; null where the format says nothing is known."""
    import gzip
    import struct

    with gzip.open(path, "rb") as f:
        if f.read(4) != b"BAM\x01":
            raise ValueError(f"{path} is no BAM file")
        f.read(struct.unpack("<i", f.read(4))[0])
        names: list[str | None] = []
        for _ in range(struct.unpack("<i", f.read(4))[0]):
            names.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode())
            f.read(4)
        name = lambda i: names[i] if i >= 0 else None
        while len(head := f.read(4)) == 4:
            d = f.read(struct.unpack("<i", head)[0])
            ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", d)
            at = 32
            qname = d[at : at + l_name - 1].decode()
            at += l_name
            cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", d, at))
            at += 4 * n_cigar
            packed = d[at : at + (l_seq + 1) // 2]
            seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
            at += len(packed)
            raw = d[at : at + l_seq]
            at += l_seq
            qual = None if not raw or raw[0] == 255 else bytes(q + 33 for q in raw).decode("latin-1")
            yield qname, flag, name(ref), pos + 1, mapq, cigar or None, name(mate), mate_pos + 1, seq or None, qual, _tag_md(d, at)


class BamReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[BamFile]:
        import glob
        import os

        path = self.path.removeprefix("file://")
        found = glob.glob(os.path.join(path, "*.bam")) if os.path.isdir(path) else glob.glob(path)
        if not found:
            raise FileNotFoundError(self.path)
        return [BamFile(p) for p in sorted(found)]

    def read(self, partition: BamFile) -> Iterator[tuple]:
        yield from bam_records(partition.path)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stranda_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"])


def read_bam(spark: SparkSession, path: str):
    """The reads of a file, of a folder of .bam files or of a pattern."""
    spark.dataSource.register(BamSource)
    return spark.read.format(BamSource.name()).load(path)
