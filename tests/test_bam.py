import gzip
import struct

import pytest

from stranda.sources.bam import BASES, OPS, read_bam


def packed(qname, flag, ref, pos, mapq, cigar, mate, mate_pos, seq, qual, tags=b""):
    codes = [BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(qname) + 1, mapq, 0, len(cigar), flag, len(seq), mate, mate_pos - 1, 0)
    body += qname.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in cigar)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + (bytes(ord(c) - 33 for c in qual) if qual else b"\xff" * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


def write(path, records):
    text = b"@HD\n"
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2)
    for name, size in ((b"1\0", 100), (b"MT\0", 50)):
        head += struct.pack("<i", len(name)) + name + struct.pack("<i", size)
    data = head + b"".join(records)
    # Several gzip members, as the blocks of the format are.
    path.write_bytes(b"".join(gzip.compress(data[i : i + 40]) for i in range(0, len(data), 40)))


def test_reads(spark, tmp_path):
    tags = b"NMC\x02" + b"XBBs" + struct.pack("<i", 2) + b"\1\0\2\0" + b"MDZ3A1\0" + b"RGZx\0"
    write(tmp_path / "a.bam", [packed("q1", 99, 0, 5, 60, [(3, "M"), (1, "I"), (2, "M")], 0, 40, "ACGTNA", "IIII5!", tags), packed("q2", 4, -1, 0, 0, [], -1, 0, "ACG", None)])
    write(tmp_path / "b.bam", [packed("q3", 0, 1, 7, 3, [(1, "M")], -1, 0, "A", "#")])
    got = sorted(tuple(r) for r in read_bam(spark, str(tmp_path)).collect())
    assert got == [
        ("q1", 99, "1", 5, 60, "3M1I2M", "1", 40, "ACGTNA", "IIII5!", "3A1"),
        ("q2", 4, None, 0, 0, None, None, 0, "ACG", None, None),
        ("q3", 0, "MT", 7, 3, "1M", None, 0, "A", "#", None),
    ]


def test_wrong_files(spark, tmp_path):
    with pytest.raises(Exception):
        read_bam(spark, str(tmp_path / "none.bam")).collect()
    (tmp_path / "c.bam").write_bytes(gzip.compress(b"text"))
    with pytest.raises(Exception, match="no BAM"):
        read_bam(spark, str(tmp_path / "c.bam")).collect()
